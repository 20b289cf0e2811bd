"""A collection of Markdown documents as a small star schema of DataFrames.

The scanner runs once per document (Arrow batches in, one nested row out); every relation is an explode of that row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scalars import estimate_tokens

SCHEMA = (
    "path string, content string, "
    "headings array<struct<text:string,depth:int,slug:string,line:int>>, "
    "tables array<struct<headers:array<string>,section:string,line:int,rows:array<struct<line:int,cells:map<string,string>>>>>, "
    "check_items array<struct<text:string,checked:boolean,section:string,line:int>>, "
    "links array<struct<raw_target:string,text:string,anchor:string,kind:string,line:int,col:int>>, "
    "images array<struct<raw_target:string,line:int>>, "
    "imports array<struct<raw_target:string,line:int,col:int>>, "
    "directives array<struct<kind:string,rule_ids:array<string>,line:int>>"
)
_S, _I = pa.string(), pa.int32()
_TYPES = {
    "headings": pa.struct([("text", _S), ("depth", _I), ("slug", _S), ("line", _I)]),
    "tables": pa.struct([("headers", pa.list_(_S)), ("section", _S), ("line", _I), ("rows", pa.list_(pa.struct([("line", _I), ("cells", pa.map_(_S, _S))])))]),
    "check_items": pa.struct([("text", _S), ("checked", pa.bool_()), ("section", _S), ("line", _I)]),
    "links": pa.struct([("raw_target", _S), ("text", _S), ("anchor", _S), ("kind", _S), ("line", _I), ("col", _I)]),
    "images": pa.struct([("raw_target", _S), ("line", _I)]),
    "imports": pa.struct([("raw_target", _S), ("line", _I), ("col", _I)]),
    "directives": pa.struct([("kind", _S), ("rule_ids", pa.list_(_S)), ("line", _I)]),
}


def parse_documents(raw: DataFrame) -> DataFrame:
    """raw(path, content) -> one nested row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from corpusloom.sources.markdown import parse

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                parsed = [parse(c or "") for c in part.column(1).to_pylist()]
                for p in parsed:
                    for t in p["tables"]:
                        t["rows"] = [{"line": r["line"], "cells": list(r["cells"].items())} for r in t["rows"]]
                arrays = [pa.array([p[n] for p in parsed], pa.list_(t)) for n, t in _TYPES.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], ["path", "content", *_TYPES])

    return raw.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInArrow(run, SCHEMA)


@dataclass
class Corpus:
    """Relations of a parsed corpus. files(path): everything on disk that a target may point at (default: the documents); root: its folder."""

    documents: DataFrame
    files: DataFrame | None = None
    router: dict | None = None
    root: str | None = None

    @classmethod
    def of(cls, raw: DataFrame, files: DataFrame | None = None, router: dict | None = None, persist: bool = True, root: str | None = None) -> Corpus:
        """persist: keep parsed rows (memory, then disk), so that the scanner runs once for all relations."""
        parsed = parse_documents(raw)
        return cls(parsed.persist() if persist else parsed, files, router, root)

    @classmethod
    def in_memory(cls, spark: SparkSession, documents: dict[str, str], files: list[str] = (), router: dict | None = None) -> Corpus:
        raw = spark.createDataFrame(list(documents.items()), "path string, content string")
        listing = spark.createDataFrame([(f,) for f in {*documents, *files}], "path string")
        return cls.of(raw, listing, router)

    def single_file(self, path: str) -> DataFrame | None:
        """path, content of one file below the root, in the corpus or not; None if there is no root or no such file inside it.

        Hadoop is asked for this one name, so the root may be any address that Spark reads; executors read the text.
        """
        from corpusloom.sources.listing import escape_path, inside

        if self.root is None or path.startswith(("/", "../")) or path in ("", "..") or not inside(self.root, path):
            return None
        spark = self.documents.sparkSession
        name = f"{self.root.rstrip('/')}/{path}"
        place = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(place) or not files.getFileStatus(place).isFile():
            return None
        text = spark.read.format("binaryFile").load(escape_path(name))
        return text.select(F.lit(path).alias("path"), F.decode("content", "UTF-8").alias("content"))

    def _children(self, name: str, ordinal: str = "pos") -> DataFrame:
        # Only the exploded array is read, so a persisted or Parquet corpus is pruned to one column.
        return self.documents.select("path", F.posexplode(name).alias(ordinal, "x")).select("path", ordinal, "x.*")

    @cached_property
    def headings(self) -> DataFrame:
        return self._children("headings")

    @cached_property
    def tables(self) -> DataFrame:
        return self._children("tables", "table_pos").select("path", "table_pos", "headers", "section", "line")

    @cached_property
    def rows(self) -> DataFrame:
        """path, table_pos, row_pos, line, cells, headers, section."""
        t = self._children("tables", "table_pos")
        return t.select("path", "table_pos", "headers", "section", F.posexplode("rows").alias("row_pos", "r")).select("path", "table_pos", "row_pos", "r.line", "r.cells", "headers", "section")

    @cached_property
    def cells(self) -> DataFrame:
        """One row for each cell: path, table_pos, row_pos, line, section, header, value."""
        return self.rows.select("path", "table_pos", "row_pos", "line", "section", F.explode("cells").alias("header", "value"))

    @cached_property
    def check_items(self) -> DataFrame:
        return self._children("check_items")

    @cached_property
    def links(self) -> DataFrame:
        return self._children("links")

    @cached_property
    def images(self) -> DataFrame:
        return self._children("images")

    @cached_property
    def imports(self) -> DataFrame:
        return self._children("imports")

    @cached_property
    def directives(self) -> DataFrame:
        return self._children("directives")

    @cached_property
    def paths(self) -> DataFrame:
        return self.documents.select("path")

    @cached_property
    def on_disk(self) -> DataFrame:
        return self.paths if self.files is None else self.files.select("path").union(self.paths).distinct()

    @cached_property
    def tokens(self) -> DataFrame:
        return self.documents.select("path", estimate_tokens(F.col("content")).alias("tokens"))

    @cached_property
    def section_bodies(self) -> DataFrame:
        """Each heading with its body: the lines behind it up to the next heading of no greater depth.

        path, pos, text, depth, line, body. A per-document array transform: no self join of headings.
        """
        h = F.col("headings")
        ends = F.transform(h, lambda x: F.array_min(F.transform(F.filter(h, lambda y: (y["line"] > x["line"]) & (y["depth"] <= x["depth"])), lambda y: y["line"])))
        lines = self.documents.select("path", F.split(F.replace(F.col("content"), F.lit("\r"), F.lit("")), "\n", -1).alias("lines"), F.arrays_zip(h.alias("h"), ends.alias("e")).alias("z"))
        # Bodies are cut out before the rows are multiplied, so no row carries another section's lines.
        body = lambda z: F.array_join(F.slice("lines", z["h"]["line"] + 1, F.coalesce(z["e"] - z["h"]["line"] - 1, F.size("lines"))), "\n")
        cut = lines.select("path", F.posexplode(F.transform("z", lambda z: F.struct(z["h"].alias("h"), body(z).alias("body")))).alias("pos", "s"))
        return cut.select("path", "pos", "s.h.text", "s.h.depth", "s.h.line", "s.body")
