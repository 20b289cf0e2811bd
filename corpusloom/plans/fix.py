"""Fixes: text edits as a relation, folded per document, written by the executors in two phases.

All edits of all rules are computed on the documents as they are, folded once per document, and staged by tasks as hidden
files beside their targets. Only if every document could be staged are they renamed, by tasks again. Both phases can be
repeated: a staged file is named by its content, and one that is gone while its target holds the content was renamed by an
attempt that died later. No text reaches the driver; what it gets is the report of paths.
"""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import primitives as p
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.tables import Tables

FILL = " TODO "


def newline_of(text: str) -> str:
    """The first line end decides."""
    m = re.search(r"\r\n|\n|\r", text)
    return m.group() if m else "\n"


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Half-open (start, end, new text) edits, by start and then the longer first; one that overlaps an earlier is skipped."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if start < at:
            continue
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def fold_edits(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """documents(path, content), edits(path, start, end, new_text) -> path, content of the documents that change.

    The edits of a document travel with it as an array; each row is folded where it lies.
    """
    listed = edits.groupBy("path").agg(F.collect_list(F.struct("start", "end", "new_text")).alias("edits"))

    def run(frames):
        for frame in frames:
            made = []
            for c, es in zip(frame["content"], frame["edits"], strict=True):
                end = newline_of(c)  # whatever a rule hands back takes on the document's line ends
                made.append(apply_edits(c, [(e["start"], e["end"], re.sub(r"\r\n|\n|\r", lambda _, end=end: end, e["new_text"])) for e in es]))
            new = pd.DataFrame({"path": frame["path"], "content": made})
            yield new[new["content"] != frame["content"]]

    return documents.join(listed, "path").select("path", "content", "edits").mapInPandas(run, "path string, content string")


def empty_cell_edits(content: str, lines: set[int], columns: list[str] | None = None) -> list[tuple[int, int, str]]:
    """Edits that fill blank cells of the table rows on the given lines (1-based)."""
    out, at, header = [], 0, []
    rows = content.split("\n")
    for number, line in enumerate(rows, 1):
        cuts = [m.start() for m in re.finditer(r"(?<!\\)\|", line)]
        if len(cuts) > 1:
            spans = list(zip(cuts, cuts[1:], strict=False)) if line.lstrip().startswith("|") else list(zip([-1, *cuts], [*cuts, len(line)], strict=False))
            if number < len(rows) and re.match(r"\s*\|?[\s:|-]*-[\s:|-]*$", rows[number]):
                header = [line[a + 1 : b].strip() for a, b in spans]
            elif number in lines:
                for k, (a, b) in enumerate(spans):
                    if not line[a + 1 : b].strip() and (columns is None or k < len(header) and header[k] in columns):
                        out.append((at + a + 1, at + b, FILL))
        at += len(line) + 1
    return out


EDIT = "path string, start long, end long, new_text string"
REPORT = "path string, written boolean, error string"


def _first_newline(content: Column) -> Column:
    found = F.regexp_extract(content, "\r\n|\n|\r", 0)
    return F.when(found == "", F.lit("\n")).otherwise(found)


def _scoped(df: DataFrame, options: dict) -> DataFrame:
    from corpusloom.operators.rules import scoped

    return scoped(df, options)


def cell_edits(corpus: Corpus, options: dict | None = None) -> DataFrame:
    """EDIT: filling the blank cells that TBL-002 reports under these options."""
    o = options or {}
    columns = o.get("columns")
    found = p.column_not_empty(_scoped(corpus.cells, o), columns, o.get("section")).groupBy("path").agg(F.collect_set("line").alias("lines"))

    def run(frames):
        for frame in frames:
            rows = [(path, *e) for path, c, ls in zip(frame["path"], frame["content"], frame["lines"], strict=True) for e in empty_cell_edits(c, set(map(int, ls)), columns)]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "new_text"])

    return corpus.documents.select("path", "content").join(found, "path").mapInPandas(run, EDIT)


def section_edits(corpus: Corpus, sections: list[str], options: dict | None = None) -> DataFrame:
    """EDIT: a scaffold at the end for each section that SEC-001 misses, in the document's own line ends."""
    o = options or {}
    missing = p.section_present(_scoped(corpus.paths, o), _scoped(corpus.headings, o), sections).groupBy("path").agg(F.collect_set(F.col("data")["section"]).alias("lost"))
    end = _first_newline(F.col("content"))
    wanted = F.filter(F.array(*[F.lit(s) for s in sections]), lambda s: F.array_contains("lost", s))
    added = F.array_join(F.transform(wanted, lambda s: F.concat(F.col("end_of_line"), F.lit("## "), s, F.col("end_of_line"))), "")
    gap = F.when(F.col("content").endswith("\n") | (F.col("content") == ""), F.lit("")).otherwise(F.col("end_of_line"))
    df = corpus.documents.select("path", "content").join(missing, "path").withColumn("end_of_line", end)
    at = F.length("content").cast("long")
    return df.select("path", at.alias("start"), at.alias("end"), F.concat(gap, added).alias("new_text"))


def rule_edits(corpus: Corpus, bound: list) -> DataFrame | None:
    """EDIT of all active fixable rules of a configuration, on the documents as they are; None if there are no such rules."""
    parts = []
    for rule, options, severity in bound:
        if severity == "off" or not rule.fixable:
            continue
        parts.append(cell_edits(corpus, options) if rule.id == "TBL-002" else section_edits(corpus, options["sections"], options))
    return reduce(DataFrame.unionByName, parts) if parts else None


def fix_empty_cells(corpus: Corpus, columns: list[str] | None = None) -> DataFrame:
    """path, content after filling the blank cells that TBL-002 reports."""
    return fold_edits(corpus.documents, cell_edits(corpus, {"columns": columns}))


def fix_missing_sections(corpus: Corpus, sections: list[str]) -> DataFrame:
    """path, content with the scaffolds of section_edits()."""
    return fold_edits(corpus.documents, section_edits(corpus, sections))


class Target:
    """Files below a root that executors see: a folder or any URI that pyarrow opens (file, hdfs, s3, gs)."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.local = "://" not in root
        self.files, self.root = (fs.LocalFileSystem(), os.path.realpath(root)) if self.local else fs.FileSystem.from_uri(root)

    def place(self, path: str) -> str:
        name = f"{self.root.rstrip('/')}/{path}"
        return os.path.realpath(name) if self.local else name  # a link is written through, not replaced

    def staged(self, path: str, content: bytes) -> str:
        folder, _, name = self.place(path).rpartition("/")
        return f"{folder}/.{name}.{hashlib.sha256(content).hexdigest()[:16]}.tmp"

    def stage(self, path: str, content: bytes) -> str:
        name = self.staged(path, content)
        with self.files.open_output_stream(name) as out:
            out.write(content)
        if self.local and os.path.exists(self.place(path)):
            shutil.copymode(self.place(path), name)
        return name

    def exists(self, name: str) -> bool:
        return self.files.get_file_info(name).is_file

    def commit(self, path: str, name: str, digest: str) -> None:
        if self.exists(name):
            self.files.move(name, self.place(path))
            return
        with self.files.open_input_stream(self.place(path)) as data:
            if hashlib.sha256(data.read()).hexdigest() != digest:
                raise OSError(f"the staged text of {path} is gone")

    def discard(self, name: str) -> None:
        if self.exists(name):
            self.files.delete_file(name)


def _reason(error: OSError) -> str:
    """Without names of temporary files, so that reports are the same everywhere."""
    return os.strerror(error.errno) if error.errno else str(error)


def stage_changes(changed: DataFrame, root: str, tables: Tables) -> DataFrame:
    """changed: path, content. path, name, digest, error: every text staged beside its target; a table, so the phase is over."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = Target(root)
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["content"], strict=True):
                data = text.encode()
                try:
                    rows.append((path, target.stage(path, data), hashlib.sha256(data).hexdigest(), None))
                except OSError as error:
                    rows.append((path, target.staged(path, data), None, _reason(error)))
            yield pd.DataFrame(rows, columns=["path", "name", "digest", "error"])

    return tables.keep(changed.select("path", "content").mapInPandas(run, "path string, name string, digest string, error string"), "staged")


def commit_changes(staged: DataFrame, root: str, tables: Tables) -> DataFrame:
    """REPORT: renames, if all was staged; otherwise nothing is written and what was staged goes."""
    whole = staged.where("error is not null").isEmpty()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target = Target(root)
        for frame in frames:
            rows = []
            for path, name, digest, error in frame.itertuples(index=False, name=None):
                try:
                    if whole:
                        target.commit(path, name, digest)
                    else:
                        target.discard(name)
                    rows.append((path, whole, error))
                except OSError as failed:
                    rows.append((path, False, error or _reason(failed)))
                    target.discard(name)
            yield pd.DataFrame(rows, columns=["path", "written", "error"])

    return tables.keep(staged.select("path", "name", "digest", "error").mapInPandas(run, REPORT), "report")


def write_changes(changed: DataFrame, root: str) -> DataFrame:
    """REPORT of writing changed(path, content) below root, by tasks; see the module's text."""
    tables = Tables(changed.sparkSession, "fix")
    return commit_changes(stage_changes(changed, root, tables), root, tables)


def apply_fixes(corpus: Corpus, bound: list, root: str) -> DataFrame | None:
    """REPORT of the fixes of all active fixable rules; None if there are no such rules."""
    edits = rule_edits(corpus, bound)
    return None if edits is None else write_changes(fold_edits(corpus.documents, edits), root)


def write_files(files: dict[str, str]) -> tuple[list[str], list[str]]:
    """Write several files: all are staged beside their targets first, then renamed in order. (written, not written)."""
    staged: list[tuple[str, str]] = []
    written: list[str] = []
    try:
        for path, text in files.items():
            target = os.path.realpath(path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            handle, name = tempfile.mkstemp(dir=os.path.dirname(target))
            staged.append((name, target))
            with os.fdopen(handle, "w", encoding="utf-8", newline="") as out:
                out.write(text)
            if os.path.exists(target):
                shutil.copymode(target, name)
        for (name, target), path in zip(staged, files, strict=True):
            os.replace(name, target)
            written.append(path)
    except OSError:
        for name, _ in staged[len(written) :]:
            if os.path.exists(name):
                os.unlink(name)
    return written, [p for p in files if p not in written]
