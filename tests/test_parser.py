from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.sources.markdown import canonical_rule_id, link_kind, parse, slug_of

SAMPLE = """# Title *em* `co_de`

Intro [a](b.md#x%20y "t") and ![img](i.png) see @other.md and (@x/y.md).
Second line @third.md here `@no.md`.

## Title em co_de
<!-- corpusloom-disable tbl001, REF-002 -->

| A | B |
|---|---|
| 1 | x \\| y |
| only |

- [ ] todo [l](l.md)
  - [x] nested
- [x] done

Setext
===

```
[no](no.md) @no.md
```

> quoted [q](q.md)

[ref]: target.md
[text][ref] [ref] [dangling][zip] <http://a.b> https://c.d.
"""


def test_headings_and_slugs():
    assert [(h["text"], h["depth"], h["slug"], h["line"]) for h in parse(SAMPLE)["headings"]] == [("Title em co_de", 1, "title-em-co_de", 1), ("Title em co_de", 2, "title-em-co_de-1", 6), ("Setext", 1, "setext", 18)]


def test_slugs_keep_scripts_and_avoid_generated_ones():
    assert slug_of("Größe & Код 日本") == "größe--код-日本"
    text = "# a\n# a-1\n# a\n# a\n"
    assert [h["slug"] for h in parse(text)["headings"]] == ["a", "a-1", "a-2", "a-3"]


def test_tables_pad_and_drop_cells():
    (t,) = parse(SAMPLE)["tables"]
    assert t["headers"] == ["A", "B"] and t["line"] == 9 and t["section"] == "Title em co_de"
    assert [(r["line"], r["cells"]) for r in t["rows"]] == [(11, {"A": "1", "B": "x | y"}), (12, {"A": "only", "B": ""})]
    assert parse("a | b\n--- | ---\n1 | 2 | 3\n")["tables"][0]["rows"][0]["cells"] == {"a": "1", "b": "2"}
    assert parse("a | a\n--- | ---\n1 | 2\n")["tables"][0]["rows"][0]["cells"] == {"a": "2"}
    assert parse("a | b\n---\ntext\n")["tables"] == []


def test_links_images_imports():
    p = parse(SAMPLE)
    assert [(x["raw_target"], x["kind"], x["anchor"], x["line"]) for x in p["links"]] == [("b.md#x%20y", "local-file", "x y", 3), ("l.md", "local-file", None, 14), ("q.md", "local-file", None, 25), ("target.md", "local-file", None, 28), ("target.md", "local-file", None, 28), ("http://a.b", "external", None, 28), ("https://c.d", "external", None, 28)]
    assert p["links"][0]["col"] == 7 and p["links"][2]["col"] == 10
    assert [(x["raw_target"], x["line"]) for x in p["images"]] == [("i.png", 3)]
    assert [(x["raw_target"], x["line"], x["col"]) for x in p["imports"]] == [("@other.md", 3, 49), ("@x/y.md", 3, 64), ("@third.md", 4, 13)]


def test_check_items_exclude_nested_text():
    assert [(c["text"], c["checked"], c["line"]) for c in parse(SAMPLE)["check_items"]] == [("todo l", False, 14), ("nested", True, 15), ("done", True, 16)]


def test_directives_and_rule_ids():
    assert parse(SAMPLE)["directives"] == [{"kind": "disable", "rule_ids": ["TBL-001", "REF-002"], "line": 7}]
    assert parse("text <!-- corpusloom-disable-next-line --> more\n")["directives"] == [{"kind": "disable-next-line", "rule_ids": [], "line": 1}]
    assert parse("<!-- corpusloom-nothing -->\n```\n<!-- corpusloom-disable -->\n```\n")["directives"] == []
    assert canonical_rule_id("ref1") == "REF-1" and canonical_rule_id("Ref-001") == "REF-001"


def test_link_kinds():
    assert [link_kind(t) for t in ("#a", "http://x", "HTTPS://x", "mailto:a@b", "c:/x", "docs:foo", "a/b.md", "/a")] == ["same-file-anchor", "external", "external", "mailto", "other", "other", "local-file", "local-file"]


def test_code_masks_everything():
    p = parse("`[a](b.md)` ``@x.md``\n\n    [c](d.md)\n\n~~~\n# no\n~~~\n")
    assert not p["links"] and not p["imports"] and not p["headings"]


def test_later_definition_wins_and_escapes():
    p = parse("[x]: one.md\n\n[x]: two.md\n\n[a][x] \\[b](c.md) [d](<e f.md>) [g](h\\(i.md)\n")
    assert [x["raw_target"] for x in p["links"]] == ["two.md", "e f.md", "h(i.md"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# ", "a", "\n", "|", "---", "- ", "[x](y)", "[ ] ", "`", "```", "> ", "<!--", "-->", "*", "\\", "![", "]", "(", ")", "  ", "1. ", "@z.md", "<a>", "&amp;", "===", "\t", "é"]), max_size=40).map("".join))
def test_any_text_parses_with_lines_in_range(text):
    p = parse(text)
    lines = text.count("\n") + 1
    assert all(1 <= r["line"] <= lines for rows in p.values() for r in rows)
    slugs = [h["slug"] for h in p["headings"]]
    assert len(set(slugs)) == len(slugs)
