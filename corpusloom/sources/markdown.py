"""A Markdown scanner: one document in, one nested record out.

CommonMark blocks (ATX and setext headings, paragraphs, fenced and indented code, block quotes, lists, HTML blocks) with
GFM tables, task lists and bare links, and the inline constructs that matter to the relations below: code spans,
escapes, links and images (inline and by reference), autolinks, inline HTML. Lines are 1-based; lengths and columns are
in code points. Frontmatter has no meaning of its own.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

#: Inline directives are HTML comments that start with this and one of the three verbs.
DIRECTIVE_PREFIX = "corpusloom"
_DIRECTIVE = re.compile(rf"<!--\s*{DIRECTIVE_PREFIX}-(disable-next-line|disable|enable)(?:\s+(.*?))?\s*-->", re.DOTALL)
#: Fixed value: what counts as an import in running text.
_IMPORT = re.compile(r"(?:^|(?<=[\s(]))@(/?[^\s@]+?\.md)\b", re.MULTILINE)
_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"(`{3,}(?!.*`)|~{3,})(.*)$")
_BREAK = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
_ITEM = re.compile(r"([-+*]|\d{1,9}[.)])([ \t]+|$)")
_TASK = re.compile(r"\[([ xX])\][ \t]+(?=\S)")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_HTML_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<[!?][^>]*>", re.DOTALL)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]+[^\s<?!.,:*_~'\")\]]")
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")
RULE_ID = re.compile(r"([A-Za-z]+)-?(\d+)$")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_PIPE = re.compile(r"(?<!\\)\|")
_TICKS = re.compile(r"`+")
_DESTINATION = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);")
#: A character and what follows it up to the next one that may start an inline construct.
_RUN = re.compile(r".(?:[^\\`<\[!hw*_~&]|h(?!ttps?://)|w(?!ww\.))*", re.DOTALL)
#: What running text holds if it is more than plain text.
_MARKED = re.compile(r"[\\`<\[*_~&]|https?://|www\.")


def canonical_rule_id(token: str) -> str:
    """`tbl1` style ids become `TBL-1`; anything else is only upper-cased."""
    m = RULE_ID.match(token)
    return f"{m[1].upper()}-{m[2]}" if m else token.upper()


@dataclass(slots=True)
class Span:
    """A piece of running text: its raw string, and line and column of each physical line in it."""

    text: str
    places: list[tuple[int, int]]

    def at(self, offset: int) -> tuple[int, int]:
        before = self.text.count("\n", 0, offset)
        line, column = self.places[min(before, len(self.places) - 1)]
        return line, column + offset - (self.text.rfind("\n", 0, offset) + 1)


@dataclass(slots=True)
class Block:
    kind: str  # heading, text, table, html
    span: Span
    line: int
    depth: int = 0
    rows: list[tuple[int, Span]] = field(default_factory=list)
    item: int | None = None  # the list item it is the own content of


@dataclass(slots=True)
class Item:
    line: int
    checked: bool | None
    section_blocks: list[Block] = field(default_factory=list)
    order: int = 0


@dataclass(slots=True)
class _Line:
    number: int
    text: str
    column: int  # 1-based column of text[0]


class _Blocks:
    """Block structure. Containers are opened recursively on their inner lines."""

    def __init__(self, content: str):
        self.blocks: list[Block] = []
        self.items: list[Item] = []
        lines = [x.removesuffix("\r") for x in content.split("\n")]
        self.walk([_Line(n, x, 1) for n, x in enumerate(lines, 1)], None)

    def walk(self, lines: list[_Line], item: int | None) -> None:
        i, n = 0, len(lines)
        paragraph: list[_Line] = []

        def close() -> None:
            if paragraph:
                self.blocks.append(Block("text", _span(paragraph), paragraph[0].number, item=item))
                paragraph.clear()

        while i < n:
            raw = lines[i]
            body = raw.text.lstrip(" ")
            indent = len(raw.text) - len(body)
            if not body.strip():
                close()
                i += 1
                continue
            here = _Line(raw.number, body, raw.column + indent)
            if indent >= 4 and not paragraph or body.startswith("\t") and not paragraph:
                i += 1  # indented code
                continue
            # No pattern is tried on a line that its first character excludes.
            first = body[0]
            if indent < 4:
                if first in "`~" and (m := _FENCE.match(body)) is not None:
                    close()
                    i = self._skip_fence(lines, i + 1, m[1])
                    continue
                if first == "#" and (m := _ATX.match(body)) is not None:
                    close()
                    start = m.start(2) if m[2] is not None else len(body)
                    self.blocks.append(Block("heading", Span(m[2] or "", [(raw.number, here.column + start)]), raw.number, len(m[1])))
                    i += 1
                    continue
                if paragraph and first in "=-" and _UNDERLINE.match(body):
                    text = list(paragraph)
                    paragraph.clear()
                    self.blocks.append(Block("heading", _span(text), text[0].number, 1 if body[0] == "=" else 2))
                    i += 1
                    continue
                if first in "*-_" and _BREAK.match(body):
                    close()
                    i += 1
                    continue
                if first == ">":
                    close()
                    inner = []
                    while i < n and lines[i].text.lstrip(" ").startswith(">"):
                        x = lines[i]
                        cut = len(x.text) - len(x.text.lstrip(" ")) + 1
                        cut += x.text[cut : cut + 1] == " "
                        inner.append(_Line(x.number, x.text[cut:], x.column + cut))
                        i += 1
                    while i < n and inner and inner[-1].text.strip() and lines[i].text.strip() and not self._starts_block(lines[i].text):
                        inner.append(lines[i])  # lazy continuation
                        i += 1
                    self.walk(inner, item)
                    continue
                m = _ITEM.match(body) if first in "-+*" or first.isdecimal() else None
                # Only a non-empty item that starts at 1, or a bullet, may interrupt a paragraph.
                if m and not (paragraph and (not body[m.end() :].strip() or m[1][0].isdigit() and m[1][:-1] != "1")):
                    close()
                    i = self._item(lines, i, indent, m)
                    continue
                if first == "<" and _HTML_START.match(body) and (not paragraph or body.startswith("<!--")) and not _AUTOLINK.match(body):
                    close()
                    i = self._html(lines, i, item)
                    continue
                if not paragraph and i + 1 < n and ("|" in body or "|" in lines[i + 1].text) and _DELIMITER.match(lines[i + 1].text.strip()):
                    head, rule = _cells(here), lines[i + 1].text.strip()
                    if len(head) == len(_cells(_Line(0, rule, 1))) and ("|" in rule or len(head) == 1 and "|" in body):
                        i = self._table(lines, i, item)
                        continue
            paragraph.append(_Line(raw.number, body if paragraph or indent else raw.text, here.column if paragraph or indent else raw.column))
            i += 1
        close()

    @staticmethod
    def _starts_block(text: str) -> bool:
        body = text.lstrip(" ")
        if not body or not (body[0] in "`~#*-_>+" or body[0].isdecimal()):
            return False
        return bool(_FENCE.match(body) or _ATX.match(body) or _BREAK.match(body) or body.startswith(">") or _ITEM.match(body))

    @staticmethod
    def _skip_fence(lines: list[_Line], i: int, fence: str) -> int:
        end = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        while i < len(lines) and not end.match(lines[i].text):
            i += 1
        return i + 1

    def _html(self, lines: list[_Line], i: int, item: int | None) -> int:
        body = lines[i].text.lstrip(" ")
        start, held = i, []
        until = "-->" if body.startswith("<!--") else None
        while i < len(lines):
            text = lines[i].text
            if until is None and not text.strip():
                break
            held.append(lines[i])
            i += 1
            if until and until in (text[text.find("<!--") + 4 :] if i - 1 == start else text):
                break
        self.blocks.append(Block("html", _span(held), held[0].number, item=item))
        return i

    def _item(self, lines: list[_Line], i: int, indent: int, m: re.Match) -> int:
        first = lines[i]
        rest = first.text.lstrip(" ")[m.end() :]
        pad = len(m[2].expandtabs(4))
        width = indent + len(m[1]) + (pad if 1 <= pad <= 4 and rest.strip() else 1)
        skip = indent + m.end() if 1 <= pad <= 4 and rest.strip() else indent + len(m[1]) + 1
        number = len(self.items)
        self.items.append(Item(first.number, None))
        head = _Line(first.number, first.text[skip:], first.column + skip)
        task = _TASK.match(head.text)
        if task:
            self.items[number].checked = task[1] != " "
            head = _Line(head.number, head.text[task.end() :], head.column + task.end())
        inner = [head]
        i += 1
        while i < len(lines):
            text = lines[i].text
            lead = len(text) - len(text.lstrip(" "))
            if not text.strip():
                following = next((x.text for x in lines[i + 1 :] if x.text.strip()), "")
                if len(following) - len(following.lstrip(" ")) < width:
                    break
                inner.append(_Line(lines[i].number, "", 1))
            elif lead >= width:
                inner.append(_Line(lines[i].number, text[width:], lines[i].column + width))
            elif inner[-1].text.strip() and not self._starts_block(text) and not inner[-1].text.lstrip().startswith(("#", "```", "~~~")):
                inner.append(_Line(lines[i].number, text.lstrip(" "), lines[i].column + lead))  # lazy continuation
            else:
                break
            i += 1
        before = len(self.blocks)
        self.walk(inner, number)
        self.items[number].order = before
        return i

    def _table(self, lines: list[_Line], i: int, item: int | None) -> int:
        head = lines[i]
        lead = len(head.text) - len(head.text.lstrip(" "))
        block = Block("table", Span("", [(head.number, 1)]), head.number, item=item)
        block.rows.append((head.number, Span(head.text.lstrip(" "), [(head.number, head.column + lead)])))
        i += 2
        while i < len(lines) and lines[i].text.strip() and not (self._starts_block(lines[i].text) and not lines[i].text.lstrip(" ").startswith("|")):
            x = lines[i]
            lead = len(x.text) - len(x.text.lstrip(" "))
            block.rows.append((x.number, Span(x.text.lstrip(" "), [(x.number, x.column + lead)])))
            i += 1
        self.blocks.append(block)
        return i


def _span(lines: list[_Line]) -> Span:
    return Span("\n".join(x.text for x in lines).rstrip(), [(x.number, x.column) for x in lines])


def _cells(line: _Line) -> list[Span]:
    """Cells of a table row; an escaped pipe does not separate."""
    text = line.text.rstrip()
    cuts = [m.start() for m in _PIPE.finditer(text)]
    if cuts and not text[: cuts[0]].strip():
        start, cuts = cuts[0] + 1, cuts[1:]
    else:
        start = 0
    out = []
    for cut in cuts:
        out.append((start, cut))
        start = cut + 1
    if text[start:].strip() or not cuts:
        out.append((start, len(text)))
    spans = []
    for a, b in out:
        raw = text[a:b]
        lead = len(raw) - len(raw.lstrip())
        spans.append(Span(raw.strip().replace("\\|", "|"), [(line.number, line.column + a + lead)]))
    return spans


@dataclass(slots=True)
class Inline:
    """What a span of running text holds."""

    text: str = ""
    links: list[tuple[int, str, str]] = field(default_factory=list)  # offset, target, text
    images: list[tuple[int, str]] = field(default_factory=list)
    html: list[tuple[int, str]] = field(default_factory=list)
    plain: list[tuple[int, str]] = field(default_factory=list)  # runs of text outside code and HTML


def _unescape(text: str) -> str:
    return html.unescape(_ESCAPED.sub(r"\1", text))


def _closing(text: str, start: int) -> int:
    """Index of the bracket that closes text[start], or -1; code spans and escapes do not count."""
    depth, i = 0, start
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            run = len(text) - i - len(text[i:].lstrip("`"))
            end = _code_end(text, i, run)
            i = end if end > 0 else i + run
            continue
        if c == "[":
            depth += 1
        elif c == "]":
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _code_end(text: str, start: int, run: int) -> int:
    """Index behind the code span that starts with `run` backticks, or -1."""
    for m in _TICKS.finditer(text[start + run :]):
        if len(m.group()) == run:
            return start + run + m.end()
    return -1


def _destination(text: str, i: int) -> tuple[str, int] | None:
    """Target and end of `(target "title")` that starts at text[i]."""
    m = _DESTINATION.match(text, i)
    return (_unescape(m[1] if m[1] is not None else m[2]), m.end()) if m else None


def parse_inline(text: str, definitions: dict[str, str]) -> Inline:
    if _MARKED.search(text) is None:
        return Inline(text, plain=[(0, text)] if text else [])
    out, i, run = Inline(), 0, 0
    parts: list[str] = []

    def plain(end: int) -> None:
        if end > run:
            out.plain.append((run, text[run:end]))

    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            parts.append(text[i + 1] if _ESCAPED.match(text, i) else text[i : i + 2])
            i += 2
        elif c == "`":
            n = len(text) - i - len(text[i:].lstrip("`"))
            end = _code_end(text, i, n)
            if end < 0:
                parts.append(text[i : i + n])
                i += n
                continue
            plain(i)
            code = text[i + n : end - n].replace("\n", " ")
            if len(code) > 2 and code[0] == code[-1] == " " and code.strip():
                code = code[1:-1]
            parts.append(code)
            i = run = end
        elif c == "<" and (m := _AUTOLINK.match(text, i)):
            plain(i)
            target = m[1] if _SCHEME.match(m[1]) else f"mailto:{m[1]}"
            out.links.append((i, target, m[1]))
            parts.append(m[1])
            i = run = m.end()
        elif c == "<" and (m := _HTML_TAG.match(text, i)):
            plain(i)
            out.html.append((i, m.group()))
            parts.append(m.group())
            i = run = m.end()
        elif c in "[!" and (c == "[" or text[i : i + 2] == "!["):
            image = c == "!"
            open_ = i + image
            close = _closing(text, open_)
            found = _link_at(text, open_, close, definitions) if close > 0 else None
            if found is None:
                parts.append(text[i : open_ + 1])
                i = open_ + 1
                continue
            target, end = found
            inner = parse_inline(text[open_ + 1 : close], definitions)
            plain(i)
            if image:
                out.images.append((i, target))
            else:
                out.links.append((i, target, inner.text))
                out.images += [(open_ + 1 + k, t) for k, t in inner.images]
                out.plain += [(open_ + 1 + k, t) for k, t in inner.plain]
                parts.append(inner.text)
            i = run = end
        elif c in "hwHW" and (not i or not text[i - 1].isalnum()) and (m := _BARE.match(text, i)):
            plain(i)
            target = m.group()
            out.links.append((i, target if target[0] == "h" else f"http://{target}", target))
            parts.append(target)
            i = run = m.end()
        elif c in "*_~":
            n = len(text) - i - len(text[i:].lstrip(c))
            before, after = text[i - 1 : i], text[i + n : i + n + 1]
            inside = c == "_" and before.isalnum() and after.isalnum()
            lone = (not before or before.isspace()) and (not after or after.isspace())
            if inside or lone or c == "~" and n > 2 or text.count(c) < 2:
                parts.append(text[i : i + n])
            i += n
        elif c == "&" and (m := _ENTITY.match(text, i)):
            parts.append(html.unescape(m.group()))
            i = m.end()
        else:
            m = _RUN.match(text, i)
            parts.append(m.group())
            i = m.end()
    plain(len(text))
    out.text = "".join(parts)
    return out


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def _link_at(text: str, open_: int, close: int, definitions: dict[str, str]) -> tuple[str, int] | None:
    """Target and end of the link whose text stands between the brackets, or None."""
    if text[close + 1 : close + 2] == "(" and (found := _destination(text, close + 1)):
        return found
    label, end = text[open_ + 1 : close], close + 1
    if text[end : end + 1] == "[":
        stop = _closing(text, end)
        if stop > 0:
            label, end = text[end + 1 : stop] or label, stop + 1
    target = definitions.get(_label(label))
    return None if target is None else (target, end)


def slug_of(text: str) -> str:
    """Lower case, without what is neither letter, mark, digit, connector, hyphen nor blank; blanks become hyphens."""
    kept = [c for c in text.lower() if c in " -" or c == "_" or unicodedata.category(c)[0] in "LMN" or unicodedata.category(c) == "Pc"]
    return "".join(kept).replace(" ", "-")


class Slugger:
    """Slugs unique within a document; generated ones count as taken."""

    def __init__(self) -> None:
        self.taken: dict[str, int] = {}

    def slug(self, text: str) -> str:
        base = slug_of(text)
        out = base
        while out in self.taken:
            self.taken[base] += 1
            out = f"{base}-{self.taken[base]}"
        self.taken[out] = 0
        return out


def link_kind(target: str) -> str:
    if target.startswith("#"):
        return "same-file-anchor"
    m = _SCHEME.match(target)
    if not m:
        return "local-file"
    scheme = m.group().lower()
    return {"http:": "external", "https:": "external", "mailto:": "mailto"}.get(scheme, "other")


def decode_anchor(text: str) -> str:
    """Percent escapes decoded as UTF-8, or the text as it is if they are malformed."""
    from urllib.parse import unquote

    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return text
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return text


def _anchor(target: str) -> str | None:
    parts = target.split("#")
    return decode_anchor(parts[1]) if len(parts) > 1 else None


def directives_in(text: str) -> Iterator[tuple[int, str, list[str]]]:
    for m in _DIRECTIVE.finditer(text):
        yield m.start(), m[1], [canonical_rule_id(t) for t in re.split(r"[\s,]+", m[2] or "") if t]


def parse(content: str) -> dict[str, list[dict[str, Any]]]:
    """The relations of one document; see corpus.SCHEMA for their fields."""
    structure = _Blocks(content)
    definitions: dict[str, str] = {}
    for block in structure.blocks:
        if block.kind == "text" and "]:" in block.span.text:
            lines = block.span.text.split("\n")
            count = 0
            while count < len(lines) and (m := _REFERENCE.match(lines[count])):
                definitions[_label(m[1])] = _unescape(m[2] if m[2] is not None else m[3])  # the last of equal labels counts
                count += 1
            block.span = Span("\n".join(lines[count:]), block.span.places[count:] or block.span.places)
    out: dict[str, list] = {k: [] for k in ("headings", "tables", "check_items", "links", "images", "imports", "directives")}
    slugger, section = Slugger(), None
    item_text: dict[int, list[str]] = {}
    item_section: dict[int, str | None] = {}
    tasks: dict[int, list[int]] = {}
    for k, item in enumerate(structure.items):
        if item.checked is not None:
            tasks.setdefault(item.order, []).append(k)
    for n, block in enumerate(structure.blocks):
        for k in tasks.get(n, ()):
            item_section.setdefault(k, section)
        if block.kind == "html":
            for offset, kind, ids in directives_in(block.span.text):
                out["directives"].append({"kind": kind, "rule_ids": ids, "line": block.span.at(offset)[0]})
            if block.item is not None:
                item_text.setdefault(block.item, []).append(block.span.text)
            continue
        spans = [block.span]
        if block.kind == "table":
            rows = [(line, _cells(_Line(line, span.text, span.places[0][1]))) for line, span in block.rows]
            parsed = [(line, [(c, parse_inline(c.text, definitions)) for c in cells]) for line, cells in rows]
            headers = [i.text.strip() for _, i in parsed[0][1]]
            table_rows = []
            for line, cells in parsed[1:]:
                values = [i.text.strip() for _, i in cells][: len(headers)]
                values += [""] * (len(headers) - len(values))
                table_rows.append({"line": line, "cells": dict(zip(headers, values, strict=True))})
            out["tables"].append({"headers": headers, "section": section, "line": block.line, "rows": table_rows})
            found = [(c, i) for _, cells in parsed for c, i in cells[: len(headers)]]
        else:
            found = [(s, parse_inline(s.text, definitions)) for s in spans]
        if block.kind == "heading":
            text = found[0][1].text.replace("\n", " ").strip()
            section = text
            out["headings"].append({"text": text, "depth": block.depth, "slug": slugger.slug(text), "line": block.line})
        elif block.item is not None and block.kind == "text":
            item_text.setdefault(block.item, []).append(found[0][1].text)
        for span, inline in found:
            for offset, target, text in inline.links:
                line, column = span.at(offset)
                out["links"].append({"raw_target": target, "text": text, "anchor": _anchor(target), "kind": link_kind(target), "line": line, "col": column})
            for offset, target in inline.images:
                out["images"].append({"raw_target": target, "line": span.at(offset)[0]})
            for offset, tag in inline.html:
                for more, kind, ids in directives_in(tag):
                    out["directives"].append({"kind": kind, "rule_ids": ids, "line": span.at(offset + more)[0]})
            for offset, text in inline.plain:
                for m in _IMPORT.finditer(text) if "@" in text else ():
                    if m.start() or not offset or span.text[offset - 1] in " \t\n(":
                        line, column = span.at(offset + m.start())
                        out["imports"].append({"raw_target": f"@{m[1]}", "line": line, "col": column})
    for k, item in enumerate(structure.items):
        if item.checked is not None:
            out["check_items"].append({"text": " ".join(item_text.get(k, [])).strip(), "checked": item.checked, "section": item_section.get(k, section), "line": item.line})
    for name in ("links", "images", "imports", "directives", "check_items"):
        out[name].sort(key=lambda r: (r["line"], r.get("col", 0)))
    return out
