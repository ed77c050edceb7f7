"""Texts reach the pipeline's workers in batches of bounded size."""

import pyarrow as pa

import corpus_pipeline
from wavetable.llm.common import BATCH


def test_stages_bound_the_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"])

    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('a word ', 1500) as text")
    before = {name: spark.conf.get(name) for name in BATCH}
    try:
        corpus_pipeline.one_of_each(spark, docs.limit(1), "")
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        short = docs.select("doc_id").mapInArrow(sizes, "n long, size long").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(r["n"] for r in found) == 3000 and max(r["size"] for r in found) < 9 << 20 and max(r["n"] for r in short) <= 1024
