"""Fill-in-the-middle transformation over relational units.

A text's units are the matches of `[A-Za-z]+|[^A-Za-z]`, left to right over code points. Units become rows (posexplode), a
window's running sum of their lengths gives the offset behind each unit, the documents' cut requests meet it by ordinal,
two offsets are aggregated per document, and substrings of the text are put together again. All of it is built-in
functions.

Texts move once: rows are dealt by a 128-bit hash of (doc_id, text) into partitions of bounded size, and grouping, window
and both joins use that partitioning. Equal rows are worked on once and repeated at the end. Units behind a document's
later cut, and those of plain documents, go before the sort.

Null text is empty, and empty texts are plain; a null doc_id counts as an empty string where it is hashed. Ties and
repeated rows: each row of the input gives one. Other columns are ignored, whatever their names. Very long texts are
whole; a text's units stream through one task. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import shuffle_parts

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of the table for each partition: its units are sorted in memory.
PART_BYTES = 6 << 20
MAX_PARTS = 200_000
_KEY = ["h1", "h2"]


def partitions(df: DataFrame, bytes_each: int) -> int:
    """Partitions of about bytes_each, by the optimiser's estimate of the table's size; no job. Without an estimate, the session's number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_parts(df.sparkSession), 0 if size >= 2**60 else min(MAX_PARTS, -(-size // bytes_each)))


def _request(n: Column, seed: str, plain_from: int, spm_below: int) -> dict[str, Column]:
    """form and the two cuts (in units) of a document of n units."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    control = F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE)
    form = F.when((F.col("t") == "") | control | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return {"form": form, "lo": F.least(a, b), "hi": F.greatest(a, b)}


def infill(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h1", F.xxhash64("doc_id", "t")).withColumn("h2", F.xxhash64(F.lit(7), "t", "doc_id"))
    dealt = rows.repartition(partitions(docs, PART_BYTES), *_KEY)
    texts = dealt.groupBy("doc_id", *_KEY).agg(F.first("t").alias("t"), F.count("*").alias("copies"))

    asked = lambda n: _request(n, seed, plain_from, spm_below)
    split = texts.select("doc_id", *_KEY, "t", F.regexp_extract_all("t", F.lit(UNIT), F.lit(0)).alias("units"))
    wanted = asked(F.size("units").cast("long"))
    units = split.select(*_KEY, "units", wanted["form"].alias("form"), wanted["hi"].alias("hi")).where("form <> 'plain'").select(*_KEY, F.posexplode(F.slice("units", F.lit(1), F.col("hi").cast("int"))).alias("pos", "unit"))
    units = units.select(*_KEY, (F.col("pos") + 1).alias("ordinal"), F.length("unit").alias("chars"))
    running = units.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), "ordinal", F.sum("chars").over(W.partitionBy(*_KEY).orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)).alias("behind"))

    counted = texts.withColumn("n", F.regexp_count("t", F.lit(UNIT)).cast("long"))
    requests = counted.select(*_KEY, "n", *(c.alias(k) for k, c in asked(F.col("n")).items()))
    # The requests are the side that is held: one small row for each document of the partition.
    met = running.join(requests.hint("shuffle_hash"), (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2")) & ((F.col("ordinal") == F.col("lo")) | (F.col("ordinal") == F.col("hi"))), "right")
    cut = lambda which: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(which), F.col("behind"))), F.lit(0)).cast("long").alias(f"{which}_chars")
    offsets = met.groupBy(*_KEY).agg(F.first("n").alias("n"), F.first("form").alias("form"), cut("lo"), cut("hi"))

    whole = texts.join(offsets, _KEY)
    t, lo, hi = F.col("t"), F.col("lo_chars"), F.col("hi_chars")
    prefix, middle, suffix = F.substring(t, F.lit(1), lo), F.substring(t, lo + 1, hi - lo), F.substring(t, hi + 1, F.length(t))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t)
    cutting = F.col("form") != "plain"
    out = whole.select("doc_id", t.alias("text"), "n", "form", F.when(cutting, lo).alias("prefix_chars"), F.when(cutting, hi - lo).alias("middle_chars"), output.alias("output"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def restore(output: Column, form: Column) -> Column:
    """The text of an output and its form: control strings of a cut output are its first ones, as the text has none."""
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring(front, 4, 2**31 - 1), SUFFIX, 1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring_index(F.substring(front, 4, 2**31 - 1), PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
