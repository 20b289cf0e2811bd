"""Scalar functions as Columns; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(s: Column) -> Column:
    """Strip all Unicode white space and the byte order mark."""
    return F.regexp_replace(s, "(?U)^[\\s\\uFEFF]+|[\\s\\uFEFF]+\\z", "")


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def estimate_tokens(s: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.ceil(utf16_length(s) / 4).cast("long")


def count_lines(s: Column) -> Column:
    """Line feeds."""
    return (F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))).cast("long")


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def file_part(target: Column) -> Column:
    return F.split(target, "#")[0]


def anchor_part(target: Column) -> Column:
    """What stands between the first and second '#', percent-decoded if it can be; null without '#'."""
    raw = F.get(F.split(target, "#"), F.lit(1))
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def has_scheme(target: Column) -> Column:
    return target.rlike("(?i)^[a-z][a-z0-9+.-]*:")


def normalize_path(path: Column) -> Column:
    """Backslashes become slashes; leading './' goes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./+)+", "")


def fold_path(path: Column) -> Column:
    """'.' and '..' resolved lexically; '..' beyond the root stays visible."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        pops = (p == "..") & (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last).otherwise(F.lit("..")) != "..")
        return F.when(pops, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(parts, empty, step), "/")


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolve_relative(source: Column, target: Column) -> Column:
    """target relative to the folder of source."""
    return fold_path(F.concat_ws("/", dirname(source), target))


def relative_path(path: Column, base: str) -> Column:
    """path as seen from the folder base ('' is the root)."""
    own = [x for x in base.split("/") if x]
    parts = F.split(path, "/")
    out = path
    # From the root down: the more folders agree, the fewer are climbed.
    for k in range(len(own) + 1):
        same = F.slice(parts, 1, k) == F.array(*[F.lit(x) for x in own[:k]]) if k else F.lit(True)
        rest = F.array_join(F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0))), "/")
        out = F.when(same & (F.size(parts) > k), F.concat(F.lit("../" * (len(own) - k)), rest)).otherwise(out)
    return out


def escapes_root(path: Column) -> Column:
    return (path == "..") | path.startswith("../") | path.startswith("/")


def candidates(source: Column, target: Column, router: dict | None = None) -> Column:
    """Ordered paths that a link target may mean. router: preset, contentDir, defaultLocale."""
    relative = F.array(resolve_relative(source, target))
    stripped = F.regexp_replace(target, "^/+", "")
    if not router:
        rooted = F.array(fold_path(stripped))
    elif router.get("preset") != "starlight":
        rooted = F.array(F.regexp_replace(stripped, "/+$", ""))
    else:
        base = router.get("contentDir") or "src/content/docs"
        route = F.regexp_replace(stripped, "/+$", "")

        def pages(r: Column) -> Column:
            index = F.array(F.lit(f"{base}/index.md"), F.lit(f"{base}/index.mdx"))
            ends = [".md", ".mdx", "/index.md", "/index.mdx"]
            return F.when(r == "", index).otherwise(F.array(*[F.concat(F.lit(f"{base}/"), r, F.lit(e)) for e in ends]))

        default = router.get("defaultLocale")
        locale = F.nullif(F.regexp_extract(source, f"^{_quote(base)}/([^/]+)/", 1), F.lit(""))
        first = F.split(route, "/")[0]
        explicit = (first != "") & (first == F.coalesce(locale, F.lit(default)))
        local = locale.isNotNull() & (locale != F.lit(default or "")) & ~F.coalesce(explicit, F.lit(False))
        rooted = F.when(local, F.concat(pages(F.concat_ws("/", locale, route)), pages(route))).otherwise(pages(route))
    out = F.when(target.startswith("/"), rooted).otherwise(relative)
    return F.when(F.coalesce(target, F.lit("")) == "", F.array().cast("array<string>")).otherwise(out)


def _quote(text: str) -> str:
    import re

    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def id_tokens(s: Column) -> Column:
    """Non-empty tokens between blanks and commas."""
    return F.filter(F.split(s, "[\\s,]+"), lambda t: t != "")


def prose_tokens(s: Column) -> Column:
    """The same for running text, without punctuation at either end."""
    return F.transform(id_tokens(s), lambda t: F.regexp_replace(t, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+\\z", ""))


def id_family(token: Column) -> Column:
    """'REQ-12' -> 'REQ-NN'; null if the token is no such id."""
    digits = F.regexp_extract(token, "^[A-Z][A-Z0-9]*-(\\d+)\\z", 1)
    prefix = F.regexp_extract(token, "^([A-Z][A-Z0-9]*)-\\d+\\z", 1)
    return F.when(digits != "", F.concat(prefix, F.lit("-"), F.rpad(F.lit("N"), F.length(digits), F.lit("N"))))


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substr(content, F.lit(1), offset)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def short_hash(s: Column) -> Column:
    return F.substring(F.sha2(s, 256), 1, 16)
