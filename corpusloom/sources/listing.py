"""Finding and reading files: directory walks with pruning, ignore files, link containment, config discovery."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.globs import matches, to_regex
from corpusloom.sources.corpus import Corpus

#: Folders that are noise at any depth.
NOISE = ("node_modules", ".git", "dist", "build", "out", "coverage", "vendor", ".next", ".cache", ".venv", ".yarn", "target")
INCLUDE = ["**/*.md"]
CONFIG_NAME = "corpusloom.config.json"


@dataclass(frozen=True)
class Scope:
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    gitignore: bool = False

    @classmethod
    def of(cls, include: list[str] | None = None, exclude: list[str] | None = None, gitignore: bool = False) -> Scope:
        """Excludes extend the default ones, in order and without repeats."""
        every = [f"**/{n}/**" for n in NOISE] + list(exclude or [])
        return cls(tuple(include or INCLUDE), tuple(dict.fromkeys(every)), gitignore)


@lru_cache(maxsize=4096)
def _ignore_rule(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """(negated, folders only, pattern of paths relative to the ignore file's folder)."""
    text = line.rstrip("\n")
    text = re.sub(r"(?<!\\)[ \t]+$", "", text)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text.removeprefix("!").replace("\\#", "#").replace("\\!", "!").replace("\\ ", " ")
    only = text.endswith("/")
    text = text.rstrip("/")
    if not text:
        return None
    anchored = "/" in text
    body = text.lstrip("/")
    return negated, only, re.compile((r"" if anchored else r"(?:.*/)?") + to_regex(body) + r"\Z", re.DOTALL)


class IgnoreLayers:
    """Ignore files by folder. The deepest folder with a verdict wins; a folder that is ignored takes its subtree."""

    def __init__(self, layers: dict[str, str]):
        self.layers = {d.strip("/"): [r for r in map(_ignore_rule, text.splitlines()) if r] for d, text in layers.items()}

    def _verdict(self, path: str, is_dir: bool) -> bool:
        parts = path.split("/")
        for k in range(len(parts) - 1, -1, -1):
            folder, rest = "/".join(parts[:k]), "/".join(parts[k:])
            for negated, only, pattern in reversed(self.layers.get(folder, [])):
                if (is_dir or not only) and pattern.match(rest):
                    return not negated
        return False

    def ignored(self, path: str, is_dir: bool = False) -> bool:
        parts = path.split("/")
        return any(self._verdict("/".join(parts[:k]), True) for k in range(1, len(parts))) or self._verdict(path, is_dir)


def list_files(root: str, scope: Scope) -> tuple[list[str], list[str]]:
    """(documents in scope, all files): relative paths, sorted. Excluded folders are never entered; links must stay inside."""
    top, chosen, everything, layers = os.path.realpath(root), [], [], {}
    pending = [""]
    while pending:
        rel = pending.pop()
        if scope.gitignore and (ignore := Path(top, rel, ".gitignore")).is_file():
            layers[rel] = ignore.read_text(encoding="utf-8", errors="replace")
        ignoring = IgnoreLayers(layers)
        with os.scandir(os.path.join(top, rel)) as found:
            for entry in sorted(found, key=lambda e: e.name):
                path = f"{rel}/{entry.name}".lstrip("/")
                if entry.is_symlink() and os.path.commonpath([top, os.path.realpath(entry.path)]) != top:
                    continue
                if entry.is_dir(follow_symlinks=False):
                    if not matches(f"{path}/x", list(scope.exclude)) and not (scope.gitignore and ignoring.ignored(path, True)):
                        pending.append(path)
                elif entry.is_file():
                    everything.append(path)
                    inside = matches(path, list(scope.include)) and not matches(path, list(scope.exclude))
                    if inside and not (scope.gitignore and ignoring.ignored(path)):
                        chosen.append(path)
    return sorted(chosen), sorted(everything)


def read_corpus(spark: SparkSession, root: str, scope: Scope | None = None, router: dict | None = None) -> Corpus:
    """The documents below a local folder. The driver lists, the executors read and scan."""
    chosen, everything = list_files(root, scope or Scope.of())
    top = os.path.realpath(root)
    listing = spark.createDataFrame([(f,) for f in everything], "path string")
    if not chosen:
        return Corpus.of(spark.createDataFrame([], "path string, content string"), listing, router, root=top)
    # Paths go in by name: file names may hold characters that a glob would read.
    text = spark.read.format("binaryFile").load([f"file://{escape_path(os.path.join(top, f))}" for f in chosen])
    return Corpus.of(_relative(text, top).withColumn("content", F.decode("content", "UTF-8")), listing, router, root=top)


def inside(root: str, path: str) -> bool:
    """Whether a path stays below a root once local links are followed."""
    if "://" in root:
        return True  # no links that lead out in stores that are no local folder
    top = os.path.realpath(root.removeprefix("file:"))
    return os.path.commonpath([top, os.path.realpath(os.path.join(top, path))]) == top


def escape_path(path: str) -> str:
    """A path as Spark's readers take it literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _relative(frame: DataFrame, top: str) -> DataFrame:
    return frame.select(F.substring(F.regexp_replace("path", "^file:/*", "/"), len(top) + 2, 1_000_000).alias("path"), "content")


def read_tree(spark: SparkSession, uri: str, scope: Scope | None = None, router: dict | None = None) -> Corpus:
    """The documents below any folder that Spark can list (object stores, HDFS), listed and read by executors.

    Paths are relative to the folder, however its address is written; only documents in scope are read.
    """
    from corpusloom.functions.globs import in_scope

    scope = scope or Scope.of()
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(uri)
    top = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(uri)
    # What stands before the path is the scheme and perhaps an authority.
    own = F.regexp_replace(F.col("path"), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    path = F.substring(own, len(top) + 2, 1 << 20)
    raw = files.where(in_scope(path, list(scope.include), list(scope.exclude))).select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))
    return Corpus.of(raw, files.select(path.alias("path")), router, root=uri)


def read_table(frame: DataFrame, path: str = "path", content: str = "content", router: dict | None = None) -> Corpus:
    """A corpus held in a table (Parquet or any other source)."""
    return Corpus.of(frame.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content")), None, router)


def find_config(start: str) -> str | None:
    """The nearest config file in start or above, not beyond the home folder."""
    at, home = Path(start).resolve(), Path.home()
    while True:
        if (at / CONFIG_NAME).is_file():
            return str(at / CONFIG_NAME)
        if at == home or at.parent == at:
            return None
        at = at.parent
