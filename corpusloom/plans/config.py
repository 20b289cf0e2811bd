"""Configuration: JSON with comments, strict keys, rules bound to options; its JSON Schema."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from corpusloom.operators import rules as _builtin  # noqa: F401  (registers the rules)
from corpusloom.operators.registry import SEVERITIES, ConfigError, Option, Rule, check_fields, fields_schema, registry
from corpusloom.operators.rules import ASSERTIONS, custom_rule
from corpusloom.sources.listing import Scope

_TEXT, _TEXTS, _FLAG = Option("str"), Option("list", items=Option("str")), Option("bool")
_ROUTER = Option("dict", fields={"preset": Option("str", True), "contentDir": _TEXT, "defaultLocale": _TEXT})
_ID_REF = Option("dict", fields={"id_pattern": Option("str", True), "definitions": _TEXTS, "column": _TEXT})
_ENTRY = Option("dict", fields={"rule": Option("str", True), "severity": Option("str", choices=SEVERITIES), "options": Option("dict"), "assert": Option("dict"), "files": _TEXTS, "exclude": _TEXTS})
FIELDS = {
    "$schema": _TEXT, "include": _TEXTS, "exclude": _TEXTS, "respectGitignore": _FLAG,
    "settings": Option("dict", fields={"siteRouter": _ROUTER, "idRef": _ID_REF}),
    "rules": Option("list", items=_ENTRY),
    "compile": Option("dict", fields={"name": _TEXT, "description": _TEXT, "outFile": _TEXT}),
}


@dataclass
class Config:
    scope: Scope = field(default_factory=Scope.of)
    router: dict | None = None
    id_ref: dict | None = None
    bound: list[tuple[Rule, dict, str | None]] = field(default_factory=list)
    entries: list[dict] = field(default_factory=list)
    compile: dict = field(default_factory=dict)


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas -> JSON; strings are left alone."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[\]}])', re.DOTALL)
    return token.sub(lambda m: m.group() if m.group()[0] == '"' else "", text)


def load(text: str) -> Config:
    try:
        data = json.loads(strip_comments(text.removeprefix("﻿")))
    except json.JSONDecodeError as error:
        raise ConfigError([f"config is not valid JSON: {error.msg} at line {error.lineno}"]) from error
    return from_dict(data)


def from_dict(data: Any) -> Config:
    """Shape first, then each rule's options; all issues are reported together. Rules that are off are checked too."""
    if not isinstance(data, dict):
        raise ConfigError(["config: expected an object"])
    issues = check_fields(data, FIELDS, "config")
    if issues:
        raise ConfigError(issues)
    settings = data.get("settings", {})
    out = Config(Scope.of(data.get("include"), data.get("exclude"), data.get("respectGitignore", False)), settings.get("siteRouter"), settings.get("idRef"), [], data.get("rules", []), data.get("compile", {}))
    for k, entry in enumerate(out.entries):
        where = f"config.rules[{k}]"
        if "assert" in entry:
            found, rule = custom_rule(entry["rule"], entry["assert"], entry.get("files"), entry.get("exclude"))
            issues += [f"{where}: {x}" for x in found]
            if rule:
                out.bound.append((rule, {}, entry.get("severity")))
            continue
        if "files" in entry or "exclude" in entry:
            issues.append(f"{where}: files and exclude belong into options")
        try:
            rule = registry.get(entry["rule"])
        except ConfigError as error:
            issues += [f"{where}: {x}" for x in error.issues]
            continue
        options = dict(entry.get("options", {}))
        found = check_fields(options, rule.options, f"{where}.options")
        found += [f"{where}.options: {x}" for x in rule.validate(options)] if rule.validate and not found else []
        issues += found
        if "idRef" in rule.options and out.id_ref:
            options.setdefault("idRef", out.id_ref)
        if not found:
            out.bound.append((rule, options, entry.get("severity")))
    if issues:
        raise ConfigError(issues)
    return out


def json_schema() -> dict:
    """Draft 2020-12 schema of the configuration."""
    schema = fields_schema(FIELDS)
    builtin = [{"properties": {"rule": {"const": r.id}, "options": fields_schema(r.options)}} for r in sorted(registry.rules.values(), key=lambda r: r.id)]
    custom = {"properties": {"assert": {"oneOf": [{"type": "object", "properties": {"kind": {"const": k}} | {n: o.schema() for n, o in f.items()}, "required": ["kind", *[n for n, o in f.items() if o.required]], "additionalProperties": False} for k, (f, _) in ASSERTIONS.items()]}}, "required": ["assert"]}
    schema["properties"]["rules"]["items"]["anyOf"] = [*builtin, custom]
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **schema}


def write(config: dict, comments: dict[int, str] | None = None) -> str:
    """Canonical text: known keys in order, unknown ones after them sorted, one rule a line, with its comment above."""
    keys = [k for k in FIELDS if k in config] + sorted(k for k in config if k not in FIELDS)
    parts = []
    for k in keys:
        if k == "rules":
            lines = []
            for n, entry in enumerate(config[k]):
                note = f"    // {comments[n]}\n" if comments and n in comments else ""
                lines.append(f"{note}    {json.dumps(entry, ensure_ascii=False)}{',' if n < len(config[k]) - 1 else ''}")
            parts.append('  "rules": [\n' + "\n".join(lines) + "\n  ]")
        else:
            parts.append(f"  {json.dumps(k)}: {json.dumps(config[k], ensure_ascii=False)}")
    return "{\n" + ",\n".join(parts) + "\n}\n"


def merge_rules(existing: list[dict], proposed: list[dict]) -> list[dict]:
    """existing and those proposed rules whose id and options it does not hold yet."""
    seen = {(r["rule"], json.dumps(r.get("options", {}), sort_keys=True)) for r in existing}
    return existing + [r for r in proposed if (r["rule"], json.dumps(r.get("options", {}), sort_keys=True)) not in seen]


_TOKEN = re.compile(r'(?P<skip>\s+|//[^\r\n]*|/\*.*?\*/)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<mark>[\[\]{},:])|(?P<word>[^\s\[\]{},:"/]+)', re.DOTALL)


def _places(text: str) -> dict[tuple, tuple[int, int, int, bool]]:
    """For each object and array by its keys: (start, end of its last entry or -1, place of its closing mark, comma behind the last entry)."""
    found: dict[tuple, tuple[int, int, int, bool]] = {}
    open_: list[list] = []  # path, start, end of the last entry, comma, key or index
    key: Any = None
    for m in _TOKEN.finditer(text):
        if m["skip"] is not None:
            continue
        mark = m["mark"]
        if mark and mark in "]}":
            path, start, last, comma, _ = open_.pop()
            found[path] = (start, last, m.start(), comma)
        elif mark and mark in "[{":
            path = (*open_[-1][0], key if isinstance(open_[-1][4], str) else open_[-1][4]) if open_ else ()
            open_.append([path, m.start(), -1, False, "" if mark == "{" else 0])
            continue
        elif mark == ",":
            open_[-1][3] = True
            if not isinstance(open_[-1][4], str):
                open_[-1][4] += 1
            continue
        elif mark == ":":
            continue
        elif m["text"] is not None:
            key = json.loads(m["text"])
        if open_:
            open_[-1][2], open_[-1][3] = m.end(), False
    return found


def _added(text: str, place: tuple[int, int, int, bool], entries: list[str]) -> str:
    """text with entries behind the last one of an object or array; every other character stays."""
    start, last, close, comma = place
    line = text.rfind("\n", 0, close) + 1
    outer = re.match(r"[ \t]*", text[line:])[0]
    end = "\r\n" if "\r\n" in text else "\n"
    if last < 0:
        body = text[start + 1 : close]
        lines = f",{end}".join(f"{outer}  {e}" for e in entries)
        gap = "" if "\n" in body and not body.rsplit("\n", 1)[1].strip() else end
        kept = body.rsplit("\n", 1)[0].rstrip("\r") + end if gap == "" else body + gap
        return text[: start + 1] + kept + lines + end + outer + text[close:]
    if "\n" not in text[start:close]:
        return text[:last] + ", " + ", ".join(entries) + text[last:]
    inner = re.match(r"[ \t]*", text[text.rfind("\n", 0, last) + 1 :])[0]
    stop = _line_end(text, last)
    new = "".join(f"{end}{inner}{e}," for e in entries)
    return text[:last] + "," * (not comma) + text[last:stop] + (new if comma else new[:-1]) + text[stop:]


def _line_end(text: str, at: int) -> int:
    """The end of the line of an entry that ends at `at`: a comment there belongs to it."""
    while m := _TOKEN.match(text, at):
        if m["skip"] is None and m["mark"] != ",":
            break
        if m["skip"] and m["skip"].isspace() and "\n" in m["skip"]:
            return at + re.search(r"\r?\n", m["skip"]).start()
        at = m.end()
    return at


def merge_into(text: str, proposed: list[dict], notes: dict[int, str] | None = None) -> str:
    """A configuration's text with the proposed rules it does not hold yet, edited in place: comments, order and layout stay."""
    mark = "\ufeff" if text.startswith("\ufeff") else ""
    text = text.removeprefix(mark)
    data = json.loads(strip_comments(text))
    new = merge_rules(data.get("rules", []), proposed)[len(data.get("rules", [])) :]
    if not new:
        return mark + text
    entries = [json.dumps(e, ensure_ascii=False) for e in new]
    places = _places(text)
    if "rules" in data:
        return mark + _added(text, places[("rules",)], entries)
    return mark + _added(text, places[()], ['"rules": [' + ", ".join(entries) + "]"])
