"""Document profiles and context budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.globs import glob_column
from corpusloom.functions.scalars import id_family, id_tokens
from corpusloom.operators import graph as g
from corpusloom.operators.rules import closure_tokens
from corpusloom.sources.corpus import Corpus


def id_families(cells: DataFrame) -> DataFrame:
    """path, family: the one id family in a document's cells, null if there are several."""
    tokens = cells.select("path", F.explode(id_tokens(F.col("value"))).alias("t")).select("path", id_family(F.col("t")).alias("family")).where("family is not null")
    return tokens.groupBy("path").agg(F.when(F.min("family") == F.max("family"), F.min("family")).alias("family"))


def profiles(corpus: Corpus, edges: DataFrame) -> DataFrame:
    """path, role, outline, table_schemas, id_pattern, references_to, referenced_by."""
    nodes = g.roles(g.build_nodes(corpus.paths, edges)).select("path", "role")
    texts = lambda x, *f: F.transform(F.array_sort(x), lambda y: F.struct(*[y[n].alias(n) for n in f]))
    outline = corpus.headings.groupBy("path").agg(texts(F.collect_list(F.struct("pos", "depth", "text", "slug")), "depth", "text", "slug").alias("outline"))
    schemas = corpus.tables.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_pos", "section", "headers"))), lambda t: F.struct(t["section"].alias("section"), t["headers"].alias("headers"))).alias("table_schemas"))
    arc = edges.select("src", "dst", "type").distinct()
    to = arc.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("dst").alias("path"), "type"))).alias("references_to"))
    by = arc.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("path"), "type"))).alias("referenced_by"))
    out = nodes
    for part in (outline, schemas, id_families(corpus.cells).withColumnRenamed("family", "id_pattern"), to, by):
        out = out.join(part, "path", "left")
    return out


def budget(corpus: Corpus, edges: DataFrame, entries: list[dict]) -> DataFrame:
    """path, total, limit: entry points over the strictest matching budget. entries: entrypoints (globs), maxTokensPerEntrypoint."""
    patterns = [p for e in entries for p in e["entrypoints"]]
    if not patterns:
        return corpus.paths.where("false").select("path", F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("limit"))
    limit = F.least(*[F.when(glob_column(F.col("path"), e["entrypoints"]), F.lit(e["maxTokensPerEntrypoint"])) for e in entries], F.lit(None).cast("int")) if len(entries) > 1 else F.when(glob_column(F.col("path"), entries[0]["entrypoints"]), F.lit(entries[0]["maxTokensPerEntrypoint"]))
    totals = closure_tokens(corpus, edges.where("type = 'import'"), patterns).withColumn("limit", limit.cast("long"))
    return totals.where("limit is not null and total > limit").select("path", "total", "limit")
