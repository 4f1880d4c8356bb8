from collections import Counter

import duckdb

import corpus_pipeline
from poolwright.llm import exact_dedup, quality
from poolwright.llm.oracle import mix_sql
from tests.llm import plain


def test_every_stage_on_its_input(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = exact_dedup.scratch(stage(spark, docs, data), f"test-stage-{k}")
        after = out.collect()
        ids = [r["doc_id"] for r in after]
        assert set(ids) <= set(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and all(r["text"] == before[r["doc_id"]] for r in after)
        if k == 0:
            wrong = [i for i in before if i in labels and (i in ids) != (labels[i] == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        if k == 1:
            groups = {}
            for i, t in before.items():
                groups.setdefault(plain.lower(t), []).append(i)
            assert sorted(ids) == sorted(max(g) for g in groups.values())
        if k == 2:
            assert sorted(ids) == sorted(i for i, c in plain.near_components(before).items() if i == c)
        if k == 3:
            given = docs.toPandas()  # noqa: F841 (read by DuckDB)
            copies = dict(duckdb.connect().execute(f"WITH {mix_sql('given')} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
            assert Counter(ids) == copies
        if k == 4:
            assert all(r["decoded_sha256"] == plain.sha(before[r["doc_id"]] or "") for r in after)
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] and quality.MAX_TRAIN == 20_000
