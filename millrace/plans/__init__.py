"""Planning: registries, configuration, artifacts and the corpus build."""
