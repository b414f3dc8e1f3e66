from __future__ import annotations

import json

from millrace.plans import corpus


def test_novelty_covers_every_source(spark, tmp_path):
    for name, rows in {"a": [(i, f"premier {i}") for i in range(4100)], "b": [(i, f"second {i}") for i in range(100)]}.items():
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / name))
    sources = [{"name": "hf", "label": name, "dataset": str(tmp_path / name), "weight": w} for name, w in (("a", 41.0), ("b", 1.0))]
    spec = {"label": "c", "sources": sources, "dedup": {"enabled": False}, "novelty": {"against": {"b": str(tmp_path / "b")}}}

    def overlap(label, **more):
        made = corpus.build(spark, str(tmp_path / "root"), {**spec, "label": label, "novelty": {**spec["novelty"], **more}})
        return json.loads(spark.read.text(f"{made.path}/report").first()[0])["novelty"][0]["overlap"]

    assert overlap("all") == round(100 / 4200, 4)
    assert overlap("bounded", limit=4000) == 0.0
