"""The thirteen assertion primitives: relations in, findings out.

Each works on any DataFrame of the stated shape, so the same predicates serve parsed documents and plain tables. A
finding is (path, line, col, message, data); line 0 stands for the whole file.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.globs import glob_column
from corpusloom.functions.patterns import check, to_python
from corpusloom.functions.scalars import candidates, file_part, has_scheme, trim_all

#: What alone in a section counts as a placeholder.
PLACEHOLDERS = ("TBD", "TODO", "WIP", "FIXME", "N/A")


def findings(df: DataFrame, message: Column, line: Column | None = None, col: Column | None = None, severity: Column | None = None, **data: Column) -> DataFrame:
    pairs = [x for k, v in data.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        "path",
        (F.col("line") if line is None else line).cast("int").alias("line"),
        (F.lit(None) if col is None else col).cast("int").alias("col"),
        (F.lit(None) if severity is None else severity).cast("string").alias("severity"),
        message.alias("message"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).cast("map<string,string>").alias("data"),
    )


def say(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def in_section(df: DataFrame, section: str | None) -> DataFrame:
    return df if section is None else df.where(F.col("section") == section)


def required_columns(tables: DataFrame, columns: list[str], section: str | None = None) -> DataFrame:
    """tables: path, line, headers, section. A finding for each absent column."""
    missing = F.array_except(F.array(*[F.lit(c) for c in columns]), F.col("headers"))
    df = in_section(tables, section).select("path", "line", F.explode(missing).alias("column"))
    return findings(df, say("Table lacks the column '%s'.", F.col("column")), column=F.col("column"))


def column_not_empty(cells: DataFrame, columns: list[str] | None = None, section: str | None = None) -> DataFrame:
    """cells: path, line, section, header, value. Blank cells of the columns (default: all)."""
    df = in_section(cells, section).where(trim_all(F.col("value")) == "")
    if columns is not None:
        df = df.where(F.col("header").isin(columns))
    return findings(df, say("Cell in column '%s' is empty.", F.col("header")), column=F.col("header"))


def _cells_of(cells: DataFrame, column: str, section: str | None) -> DataFrame:
    return in_section(cells, section).where(F.col("header") == column).withColumn("v", trim_all(F.col("value")))


def column_in_set(cells: DataFrame, column: str, values: list[str], section: str | None = None, ignore_case: bool = False) -> DataFrame:
    """Trimmed values outside the set; an empty cell is tested too."""
    own = F.lower("v") if ignore_case else F.col("v")
    df = _cells_of(cells, column, section).where(~own.isin([v.lower() if ignore_case else v for v in values]))
    return findings(df, say("'%s' is not allowed in column '%s'.", F.col("v"), F.col("header")), column=F.col("header"), value=F.col("v"))


def column_matches(cells: DataFrame, column: str, pattern: str, flags: str = "", section: str | None = None) -> DataFrame:
    """Trimmed values in which the pattern is not found; an empty cell is tested too."""
    df = _cells_of(cells, column, section).where(~F.col("v").rlike(check(pattern, flags)))
    return findings(df, say("'%s' in column '%s' does not match.", F.col("v"), F.col("header")), column=F.col("header"), value=F.col("v"))


def column_unique(cells: DataFrame, column: str, id_pattern: str | None = None, section: str | None = None) -> DataFrame:
    """Second and later occurrences in path order, with where the first stands.

    The first place comes from a grouped minimum that is joined back, so a value that fills a third of all cells is
    combined before the shuffle and a skewed join can be split.
    """
    df = _cells_of(cells, column, section).where(F.col("v") != "")
    if id_pattern is not None:
        df = df.where(F.col("v").rlike(check(id_pattern)))
    place = F.struct("path", "table_pos", "row_pos", "line")
    df = df.withColumn("place", place)
    first = df.groupBy("v").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    df = df.join(first, "v").where(F.col("place") > F.col("first"))
    return findings(df, say("'%s' in column '%s' was used before, in %s:%d.", F.col("v"), F.col("header"), F.col("first.path"), F.col("first.line")), value=F.col("v"), first_path=F.col("first.path"), first_line=F.col("first.line"))


def condition(value: Column, equals: str | None = None, matches: str | None = None, flags: str = "", not_empty: bool | None = None) -> Column:
    """All given tests on a trimmed value."""
    v = trim_all(value)
    out = F.lit(True)
    if equals is not None:
        out = out & (v == equals)
    if matches is not None:
        out = out & v.rlike(check(matches, flags))
    if not_empty is not None:
        out = out & ((v != "") == F.lit(not_empty))
    return out


def cross_column(rows: DataFrame, when: dict, then: dict, section: str | None = None) -> DataFrame:
    """rows: path, line, section, headers, cells (map). when/then: column and condition() arguments."""
    a, b = when["column"], then["column"]
    df = in_section(rows, section).where(F.array_contains("headers", a) & F.array_contains("headers", b))
    test = [condition(F.coalesce(F.col("cells")[o["column"]], F.lit("")), **{k: v for k, v in o.items() if k != "column"}) for o in (when, then)]
    return findings(df.where(test[0] & ~test[1]), F.lit(f"The condition on '{a}' holds but that on '{b}' does not."), when=F.lit(a), then=F.lit(b))


def section_present(paths: DataFrame, headings: DataFrame, sections: list[str]) -> DataFrame:
    """paths: path; headings: path, text. A whole-file finding for each absent section."""
    have = headings.where(F.col("text").isin(sections)).groupBy("path").agg(F.collect_set("text").alias("have"))
    missing = F.array_except(F.array(*[F.lit(s) for s in sections]), F.coalesce("have", F.array().cast("array<string>")))
    df = paths.join(have, "path", "left").select("path", F.explode(missing).alias("name"))
    return findings(df, say("Section '%s' is missing.", F.col("name")), line=F.lit(0), section=F.col("name"))


def section_order(headings: DataFrame, order: list[str], level: int | None = None, section: str | None = None) -> DataFrame:
    """headings: path, pos, text, depth, line. First occurrences must stand in the given order."""
    df = headings
    if section is not None:
        start = df.where(F.col("text") == section).groupBy("path").agg(F.min(F.struct("pos", "depth")).alias("s"))
        df = df.join(start, "path").where(F.col("pos") > F.col("s.pos"))
        end = df.where(F.col("depth") <= F.col("s.depth")).groupBy("path").agg(F.min("pos").alias("end"))
        df = df.join(end, "path", "left").where(F.col("end").isNull() | (F.col("pos") < F.col("end")))
    if level is not None:
        df = df.where(F.col("depth") == level)
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("text"))
    first = df.where(F.col("text").isin(order)).groupBy("path", "text").agg(F.min(F.struct("pos", "line")).alias("p")).select("path", "text", "p.*", rank.alias("rank"))
    before = W.partitionBy("path").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    late = first.withColumn("mark", F.max("pos").over(before)).where(F.col("pos") < F.col("mark"))
    return findings(late, say("Section '%s' stands too early.", F.col("text")), section=F.col("text"))


def content_not_match(documents: DataFrame, pattern: str, flags: str = "") -> DataFrame:
    """documents: path, content. A finding for each match, with its line; also for matches of nothing.

    The JVM finds the documents that match at all; the places of matches, which its functions do not tell, come from one
    pass over each of their texts in Arrow batches.
    """
    compiled = to_python(pattern, flags)
    sticky = "y" in flags

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line, at = 1, 0
                for m in compiled.finditer(text):
                    if sticky and m.start() != at:
                        break
                    line, at = line + text.count("\n", 0 if line == 1 and not at else at, m.start()), m.start()
                    rows.append((path, m.group(), line))
                    if sticky:
                        line, at = line + text.count("\n", at, m.end()), m.end()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.string()), (2, pa.int32()))], ["path", "match", "line"])

    df = documents.where(F.col("content").rlike(check(pattern, flags))).select("path", "content").mapInArrow(run, "path string, match string, line int")
    return findings(df, say("Forbidden text: '%s'.", F.col("match")), match=F.col("match"))


def no_placeholders(bodies: DataFrame, extra: list[str] = (), section: str | None = None) -> DataFrame:
    """bodies: path, text, line, body (Corpus.section_bodies). Sections that are empty or hold a placeholder alone."""
    words = [w.lower() for w in (*PLACEHOLDERS, *extra)]
    df = bodies if section is None else bodies.where(F.col("text") == section)
    body = F.lower(trim_all(F.col("body")))
    df = df.where((body == "") | F.regexp_replace(body, ":\\z", "").isin(words))
    return findings(df, say("Section '%s' has no content.", F.col("text")), section=F.col("text"))


def all_checked(items: DataFrame, section: str | None = None) -> DataFrame:
    """items: path, text, checked, section, line."""
    df = in_section(items, section).where(~F.col("checked"))
    return findings(df, say("Not done: '%s'.", F.col("text")), text=F.col("text"))


def resolved_targets(links: DataFrame, router: dict | None = None) -> DataFrame:
    """links with `candidates`: ordered paths its target may mean (empty for none)."""
    return links.withColumn("candidates", candidates(F.col("path"), file_part(F.col("raw_target")), router))


def first_existing(links: DataFrame, files: DataFrame, router: dict | None = None) -> DataFrame:
    """links with `target`, the first candidate that exists, or null. links need a unique (path, pos)."""
    known = files.select(F.col("path").alias("candidate")).distinct()
    if not router:  # one candidate at most: a single join
        df = links.withColumn("candidate", F.get(candidates(F.col("path"), file_part(F.col("raw_target"))), F.lit(0)))
        return df.join(known.withColumn("target", F.col("candidate")), "candidate", "left").drop("candidate")
    tried = resolved_targets(links, router).select("path", "pos", F.posexplode("candidates").alias("ord", "candidate"))
    best = tried.join(known, "candidate").groupBy("path", "pos").agg(F.min_by("candidate", "ord").alias("target"))
    return links.join(best, ["path", "pos"], "left")


def link_resolves(links: DataFrame, files: DataFrame, router: dict | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Local links none of whose candidates exists; targets of which any candidate matches `exclude` are skipped."""
    df = links.where((F.col("kind") == "local-file") & (file_part(F.col("raw_target")) != ""))
    if exclude:
        skip = F.exists(candidates(F.col("path"), file_part(F.col("raw_target")), router), lambda c: glob_column(c, exclude))
        df = df.where(~skip)
    df = first_existing(df, files, router).where(F.col("target").isNull())
    return findings(df, say("Link target '%s' does not exist.", F.col("raw_target")), col=F.col("col"), target=F.col("raw_target"))


def image_resolves(images: DataFrame, files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Images without a scheme whose file does not exist; targets that match `exclude` are skipped."""
    df = images.where(~has_scheme(F.col("raw_target")) & (file_part(F.col("raw_target")) != ""))
    if exclude:
        df = df.where(~F.exists(candidates(F.col("path"), file_part(F.col("raw_target"))), lambda c: glob_column(c, exclude)))
    df = first_existing(df, files).where(F.col("target").isNull())
    return findings(df, say("Image '%s' does not exist.", F.col("raw_target")), target=F.col("raw_target"))
