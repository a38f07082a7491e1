"""The pipeline over the small tables, stage by stage."""
import importlib.util
import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the generated tables")
def test_stages_keep_columns_and_decide(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids is None or now <= ids, name
        ids = now
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_every_dealt_operator_has_a_query():
    import __spark_entry__ as entry_point
    names = set(entry_point.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert importlib.util.find_spec("corpus_pipeline") is not None
