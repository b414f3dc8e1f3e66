"""Dataflow operators over documents, tokens, passages and metrics."""
