"""How often queries scan their corpus, and what they look for in it."""

import pytest
from pyspark.sql import functions as F

from corpusloom import queries as q
from corpusloom.operators import graph as g
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.markdown import parse


@pytest.mark.parametrize("name", ["cross_zone", "declared_zones"])
def test_a_corpus_is_scanned_once(spark, sf_dir, tmp_path, name):
    """The scan counts the documents that it reads, so that a second one would show."""
    made, counted = q.generated_documents, spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    def watched(spark, sf_dir):
        raw = made(spark, sf_dir).limit(100)
        return raw.mapInArrow(counting, raw.schema)

    held, q._parsed, q.generated_documents = q._parsed, {}, watched
    try:
        assert q.QUERIES[name](spark, sf_dir).count()
        assert counted.value == 100
    finally:
        for c in q._parsed.values():
            c.documents.unpersist()
        q._parsed, q.generated_documents = held, made


@pytest.mark.parametrize("name", ["generated", "blocks"])
def test_documents_of_one_row_group_are_dealt_evenly(spark, tmp_path, name):
    """One task reads a row group; the scan of its documents must not be left to it."""
    ids = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    ids.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held, q._parsed = q._parsed, {}
    try:
        q.QUERIES["parse_headings" if name == "generated" else "import_cycles"](spark, str(tmp_path))
        scanned = next(c for key, c in q._parsed.items() if key[1].endswith(name)).documents
        rows = [r["count"] for r in scanned.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(rows) == 8000
        assert len(rows) > 1
        assert max(rows) < 2000
    finally:
        for c in q._parsed.values():
            c.documents.unpersist()
        q._parsed = held


def test_edges_of_wanted_types_only(spark):
    c = Corpus.in_memory(spark, {"a.md": "[b](b.md) [h](b.md#h) ![i](i.png) @b.md", "b.md": "# H\n\n@a.md REQ-1", "i.png": ""})
    full = g.build_edges(c)
    for types in (["import"], ["link"], ["anchor", "image"], []):
        assert sorted(g.build_edges(c, types=types).collect()) == sorted(full.where(F.col("type").isin(types) if types else F.lit(False)).collect())
    assert "slug" not in g.build_edges(c, types=["import"])._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_plain_text_is_taken_in_runs():
    """A run ends where a bare link may start, and only there."""
    found = parse("plain words, how it is. " * 800 + "see http://a.b/c and www.d.e, or whttp://x.y")
    assert [x["raw_target"] for x in found["links"]] == ["http://a.b/c", "http://www.d.e"]
