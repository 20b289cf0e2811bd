import posixpath

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalars as s
from corpusloom.functions.globs import glob_column, matches
from corpusloom.functions.patterns import check, to_java


def values(spark, column, rows, names="a"):
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names.split()))
    return [r[0] for r in frame.select(column).collect()]


def test_lengths_and_trims(spark):
    assert values(spark, s.utf16_length(F.col("a")), ["a😀é", ""]) == [4, 0]
    assert values(spark, s.estimate_tokens(F.col("a")), ["", "abcd", "abcde", "😀😀😀"]) == [0, 1, 2, 2]
    assert values(spark, s.count_lines(F.col("a")), ["", "a", "a\n", "a\nb\n\n"]) == [0, 0, 1, 3]
    assert values(spark, s.trim_all(F.col("a")), ["\u00a0 x\u3000\n", "\ufeffy"]) == ["x", "y"]
    assert values(spark, s.id_family(F.col("a")), ["REQ-12", "A1-7", "req-1", "REQ-1x"]) == ["REQ-NN", "A1-N", None, None]


def test_paths(spark):
    pairs = [("docs/a/b.md", "c.md"), ("docs/a/b.md", "../c.md"), ("a.md", "../../x/./y.md"), ("a.md", "b//c.md"), ("d/e.md", "..")]
    want = [posixpath.normpath(posixpath.join(posixpath.dirname(a), b)) for a, b in pairs]
    assert values(spark, s.resolve_relative(F.col("a"), F.col("b")), pairs, "a b")[:4] == want[:4]
    assert values(spark, s.anchor_part(F.col("a")), ["x", "x#a%20b+c#d", "x#%zz", "#"]) == [None, "a b+c", "%zz", ""]


def test_router_candidates(spark):
    router = {"preset": "starlight", "contentDir": "c", "defaultLocale": "en"}
    column = s.candidates(F.col("a"), F.col("b"), router)
    got = values(spark, column, [("c/de/x.md", "/g/h"), ("c/x.md", "/g/"), ("c/en/x.md", "/"), ("c/de/x.md", "/de/g"), ("c/x.md", "y.md"), ("c/x.md", "")], "a b")
    assert got[0][:2] == ["c/de/g/h.md", "c/de/g/h.mdx"] and got[0][4] == "c/g/h.md" and len(got[0]) == 8
    assert got[1] == ["c/g.md", "c/g.mdx", "c/g/index.md", "c/g/index.mdx"]
    assert got[2] == ["c/index.md", "c/index.mdx"] and len(got[3]) == 4 and got[4] == ["c/y.md"] and got[5] == []


GLOBS = [
    (["*.md"], {"a.md": True, "x/y/a.md": True, ".a.md": True, "a.mdx": False}),
    (["docs/**"], {"docs/a.md": True, "docs/x/.y/z.md": True, "adocs/a.md": False}),
    (["docs/*.md"], {"docs/a.md": True, "docs/x/a.md": False}),
    (["**/*.md", "!docs/private/**"], {"a.md": True, "docs/private/a.md": False, "docs/a.md": True}),
    (["!x/**"], {"x/a.md": False, "y/a.md": True}),
    (["!x/**", "x/keep.md"], {"x/keep.md": True, "x/a.md": False}),
    ([], {"a.md": False}),
    (["{a,b}/c?.md"], {"a/c1.md": True, "b/c2.md": True, "c/c1.md": False, "a/c.md": False}),
    (["a/[!x]*.md"], {"a/y.md": True, "a/x.md": False}),
    (["./a.md"], {"a.md": True, "b/a.md": False}),
    (["a/@(b|c).md"], {"a/b.md": True, "a/d.md": False}),
]


@pytest.mark.parametrize(("patterns", "wanted"), GLOBS)
def test_globs_on_driver_and_in_spark(spark, patterns, wanted):
    assert {p: matches(p, patterns) for p in wanted} == wanted
    assert values(spark, glob_column(F.col("a"), patterns), list(wanted)) == list(wanted.values())


def test_patterns(spark):
    assert values(spark, F.col("a").rlike(to_java("c$")), ["abc", "abc\n"]) == [True, False]
    assert values(spark, F.col("a").rlike(to_java("[^]b", "i")), ["\nB", "b"]) == [True, False]
    assert values(spark, F.col("a").rlike(to_java("b", "y")), ["ba", "ab"]) == [True, False]
    with pytest.raises(ValueError):
        check("(", "")
    with pytest.raises(ValueError):
        to_java("a", "q")
