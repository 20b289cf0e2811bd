"""Path globs: ordered lists in which '!' subtracts and the last matching entry decides."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: str) -> str:
    return re.sub(r"^(\./+)+", "", path.replace("\\", "/"))


def _negations(pattern: str) -> int:
    n = 0
    while pattern[n : n + 1] == "!" and pattern[n + 1 : n + 2] != "(":
        n += 1
    return 0 if n == len(pattern) else n


def expand(pattern: str) -> str:
    """A pattern without a slash matches at any depth; a leading run of '!' stays in front."""
    pattern = pattern.replace("\\", "/")
    n = _negations(pattern)
    head, body = pattern[:n], pattern[n:]
    return pattern if "/" in body else f"{head}**/{body}"


def escape_glob(path: Column) -> Column:
    """A path as a glob that matches nothing else: special characters become classes of one."""
    return F.regexp_replace(path, r"[\\\\*?\[\]{}()!+@|]", "[$0]")


def is_glob(pattern: str) -> bool:
    return bool(re.search(r"[*?\[\]{}]|[!@+]\(|^!", pattern.replace("\\", "/")))


@lru_cache(maxsize=4096)
def to_regex(glob: str) -> str:
    """A whole-path regular expression, valid for Java and Python alike, for one glob without negation."""
    body = normalize(glob)
    out, i, depth = [], 0, 0
    closers: list[str] = []
    while i < len(body):
        c = body[i]
        if body.startswith("**", i) and (i == 0 or body[i - 1] == "/"):
            j = i
            while body[j : j + 1] == "*":
                j += 1
            if body[j : j + 1] == "/":
                out.append("(?:.*/)?")
                i = j + 1
                continue
            if j == len(body):
                out.append(".*")
                i = j
                continue
        if c in "?*+@!" and body[i + 1 : i + 2] == "(":
            out.append("(?:" if c != "!" else "(?:(?!(?:")
            closers.append({"?": ")?", "*": ")*", "+": ")+", "@": ")", "!": ")(?:/|$))[^/]*)"}[c])
            i += 2
            continue
        if c == ")" and closers:
            out.append(closers.pop())
        elif c == "|" and closers:
            out.append("|")
        elif c == "*":
            while body[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : end]
            negated = inner[0] in "!^" and len(inner) > 1
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&])", r"\\\1", inner[negated:]) + "]")
            i = end
        elif c == "{" and "}" in body[i:]:
            inner = body[i + 1 : body.index("}", i)]
            if (m := re.fullmatch(r"(-?\d+)\.\.(-?\d+)", inner)) is not None:
                a, b = int(m[1]), int(m[2])
                out.append("(?:" + "|".join(map(str, range(min(a, b), max(a, b) + 1))) + ")")
                i = body.index("}", i)
            elif "," in inner:
                out.append("(?:")
                depth += 1
            else:
                out.append("\\{")
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", c))
        i += 1
    return "".join(out)


def _split(patterns: list[str]) -> list[tuple[bool, str]]:
    out = []
    for p in map(expand, patterns):
        n = _negations(p)
        out.append((n % 2 == 1, to_regex(p[n:])))
    return out


def matches(path: str, patterns: list[str]) -> bool:
    """The same verdict as glob_column, for one path on the driver."""
    rules, path = _split(patterns), normalize(path)
    kept = bool(rules) and all(neg for neg, _ in rules)
    for negated, regex in rules:
        if re.fullmatch(regex, path, re.DOTALL):
            kept = not negated
    return kept


def glob_column(path: Column, patterns: list[str]) -> Column:
    """Whether a path is selected; no pattern selects nothing, negated ones alone subtract from everything."""
    rules = _split(patterns)
    out = F.lit(bool(rules) and all(neg for neg, _ in rules))
    for negated, regex in rules:
        out = F.when(path.rlike(f"^(?s:{regex})\\z"), F.lit(not negated)).otherwise(out)
    return out


def in_scope(path: Column, files: list[str] | None, exclude: list[str] | None = None) -> Column:
    """In files (if any are given) and not in exclude."""
    out = glob_column(path, files) if files is not None else F.lit(True)
    return out & ~glob_column(path, exclude) if exclude else out
