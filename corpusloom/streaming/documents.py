"""Streams of documents: document-scope rules are stateless and run as they are; the others see each batch's full state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.registry import Rule
from corpusloom.plans.findings import lint
from corpusloom.sources.corpus import Corpus

SCHEMA = "path string, content string"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of (path, content) below a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def lint_stream(stream: DataFrame, bound: list[tuple[Rule, dict, str | None]], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Document-scope rules over each micro-batch; sink(findings, batch) writes them. Restarts resume from checkpoint."""
    if any(rule.scope != "document" for rule, _, _ in bound):
        raise ValueError("project-scope rules need the whole corpus: use maintain()")

    def each(batch: DataFrame, number: int) -> None:
        sink(lint(Corpus.of(batch, persist=False), bound), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def maintain(stream: DataFrame, state: str, bound: list[tuple[Rule, dict, str | None]], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the latest text of every path in `state` (one folder for each batch) and run all rules over it.

    A batch's folder is written from the one before it, so a batch that is run again gives the same state.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.dropDuplicates(["path"])
        if number:
            try:
                before = spark.read.schema(SCHEMA).parquet(f"{state}/batch={number - 1}")
                latest = before.join(latest.select("path"), "path", "left_anti").unionByName(latest)
            except Exception as error:  # the state of a stream that starts late
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        latest.write.mode("overwrite").parquet(f"{state}/batch={number}")
        sink(lint(Corpus.of(spark.read.schema(SCHEMA).parquet(f"{state}/batch={number}"), persist=False), bound), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
