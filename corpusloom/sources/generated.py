"""A Markdown corpus generated from the ids of a table, for tests and registered queries.

Every value follows from doc_id by modular arithmetic, so the expected relations can be computed without any parsing.
With n rows (doc_ids 0 .. n-1), document i is z{i % 5}/doc-{i}.md and holds, from line 1:

  1 `# Doc i`, 3 a link to (i + 1) % n unless i % 7 = 3, in the same folder style (`../z{..}/doc-{..}.md`);
  5 `## Items`, 7 the table ID | Owner | Status | Depends with one row on line 9: REQ-i, a blank Owner if i % 7 = 0,
  Status `bad` if i % 11 = 0 else `open` or `done` by parity, Depends REQ-{(i * 3 + 1) % (n + 5)};
  11 `## Notes`, 13 an anchored link to `#items` (`#nope` if i % 13 = 0) of document (i * 7 + 2) % n;
  15 a dangling link if i % 17 = 0; 17 `@../z{..}/doc-{..}.md` of document i // 2 if i % 3 = 0;
  19 a done check item, 20 one that is done if i is even; 22 a directive `disable TBL-002` if i % 19 = 0;
  24 `## Later`, 26 an image that is missing if i % 23 = 0; 28 `TODO` alone if i % 29 = 0, else prose;
  30 the source and lang of the row (commas and blanks only, nothing that Markdown reads).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def path_of(i: Column) -> Column:
    return F.concat(F.lit("z"), (i % 5).cast("string"), F.lit("/doc-"), i.cast("string"), F.lit(".md"))


def dealt(table: DataFrame, rows: int, key: str = "i") -> DataFrame:
    """So many narrow rows, dealt evenly to the tasks that make and scan texts of them: a file with one row group is read by one task.

    Few rows stay together.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(1, min(rows // 1024, 4 * cores), rows // 8192), key)


def generated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw(path, content), one document for each row of `documents`."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("i"), "lang", "source")
    count = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    table = dealt(table, count)
    n = F.lit(count).cast("long")
    i = F.col("i")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    when = lambda test, a, b="": F.when(test, a if isinstance(a, Column) else F.lit(a)).otherwise(b if isinstance(b, Column) else F.lit(b))
    up = lambda k: text("../", path_of(k))
    lines = [
        text("# Doc ", i), F.lit(""),
        when(i % 7 != 3, text("See [next](", up((i + 1) % n), ") for more."), "No link here."), F.lit(""),
        F.lit("## Items"), F.lit(""),
        F.lit("| ID | Owner | Status | Depends |"), F.lit("| --- | --- | --- | --- |"),
        text("| REQ-", i, " | ", when(i % 7 == 0, "", text("owner", i % 4)), " | ", when(i % 11 == 0, "bad", when(i % 2 == 0, "open", "done")), " | REQ-", (i * 3 + 1) % (n + 5), " |"), F.lit(""),
        F.lit("## Notes"), F.lit(""),
        text("An [anchor](", up((i * 7 + 2) % n), when(i % 13 == 0, "#nope", "#items"), ") in text."), F.lit(""),
        when(i % 17 == 0, text("Lost [link](missing-", i, ".md)."), "Nothing lost."), F.lit(""),
        when(i % 3 == 0, text("Import @", up(F.floor(i / 2)), " here."), "No import."), F.lit(""),
        F.lit("- [x] first"), text("- [", when(i % 2 == 0, "x", " "), "] second ", i), F.lit(""),
        when(i % 19 == 0, "<!-- corpusloom-disable TBL-003 -->", "Plain."), F.lit(""),
        F.lit("## Later"), F.lit(""),
        when(i % 23 == 0, text("![picture](pic-", i, ".png)"), "No picture."), F.lit(""),
        F.lit("## End"), when(i % 29 == 0, "TODO", "Prose."),
        text("source ", F.col("source"), " lang ", F.col("lang")),
    ]
    body = F.when(i % 29 == 0, F.array_join(F.array(*lines[:-1]), "\n")).otherwise(F.array_join(F.array(*lines), "\n"))
    # A directive must come before the table to matter to it: every 38th document starts with one.
    return table.select(path_of(i).alias("path"), F.when(i % 38 == 0, F.concat(F.lit("<!-- corpusloom-disable TBL-002, TBL-003 -->\n"), body)).otherwise(body).alias("content"))
