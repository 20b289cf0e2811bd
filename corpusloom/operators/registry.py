"""Rule metadata, option checks and lookup; user rules register here as well."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from corpusloom.errors import EngineError
from corpusloom.sources.corpus import Corpus

SEVERITIES = ("error", "warning", "off")


class ConfigError(EngineError):
    """A configuration that cannot be used; `issues` lists every problem, the first one is the hint."""

    def __init__(self, issues: list[str]):
        super().__init__("CONFIG_INVALID", "; ".join(issues), issues[0] if issues else None)
        self.issues = issues


@dataclass(frozen=True)
class Option:
    """Type of one option. kind: str, int, bool, list, dict; choices, items and fields narrow it."""

    kind: str
    required: bool = False
    items: Option | None = None
    fields: dict[str, Option] | None = None
    choices: tuple | None = None
    least: int | None = None

    def check(self, value: Any, where: str) -> list[str]:
        python = {"str": str, "int": int, "bool": bool, "list": list, "dict": dict}[self.kind]
        if not isinstance(value, python) or self.kind == "int" and isinstance(value, bool):
            return [f"{where}: expected {self.kind}"]
        if self.choices and value not in self.choices:
            return [f"{where}: expected one of {', '.join(map(str, self.choices))}"]
        if self.least is not None and (value if self.kind == "int" else len(value)) < self.least:
            return [f"{where}: must be at least {self.least}" if self.kind == "int" else f"{where}: needs at least {self.least} item(s)"]
        out = []
        if self.kind == "list" and self.items:
            for k, v in enumerate(value):
                out += self.items.check(v, f"{where}[{k}]")
        if self.kind == "dict" and self.fields is not None:
            out += check_fields(value, self.fields, where)
        return out

    def schema(self) -> dict:
        """JSON Schema of the option."""
        out: dict[str, Any] = {"type": {"str": "string", "int": "integer", "bool": "boolean", "list": "array", "dict": "object"}[self.kind]}
        if self.choices:
            out["enum"] = list(self.choices)
        if self.least is not None:
            out[{"int": "minimum", "str": "minLength"}.get(self.kind, "minItems")] = self.least
        if self.items:
            out["items"] = self.items.schema()
        if self.fields is not None:
            out |= fields_schema(self.fields)
        return out


def check_fields(value: dict, fields: dict[str, Option], where: str) -> list[str]:
    out = [f"{where}: unknown key '{k}'{suggestion(k, list(fields))}" for k in value if k not in fields]
    out += [f"{where}.{k}: required" for k, o in fields.items() if o.required and k not in value]
    for k, o in fields.items():
        if k in value:
            out += o.check(value[k], f"{where}.{k}")
    return out


def fields_schema(fields: dict[str, Option]) -> dict:
    return {"type": "object", "properties": {k: o.schema() for k, o in fields.items()}, "required": [k for k, o in fields.items() if o.required], "additionalProperties": False}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(name: str, known: list[str]) -> str:
    """' (did you mean ...?)' for the nearest known name within 0.4 of the length, or nothing."""
    best = min(known, key=lambda k: (edit_distance(name.lower(), k.lower()), k), default=None)
    near = best is not None and edit_distance(name.lower(), best.lower()) <= math.ceil(0.4 * len(name))
    return f" (did you mean '{best}'?)" if near else ""


#: (corpus, options) -> findings with path, line, col, severity (null: the rule's), message, data.
Check = Callable[[Corpus, dict], DataFrame]


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    description: str
    severity: str
    scope: str  # document or project
    options: dict[str, Option]
    check: Check
    fixable: bool = False
    #: Checks that the option types cannot express.
    validate: Callable[[dict], list[str]] | None = None


_ID = re.compile(r"[A-Z]{2,10}-\d{3}$")


class Registry:
    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def add(self, rule: Rule) -> Rule:
        if not _ID.match(rule.id):
            raise ValueError(f"'{rule.id}' is no rule id")
        if rule.id in self.rules:
            raise ValueError(f"rule '{rule.id}' is registered already")
        if rule.severity not in SEVERITIES[:2] or rule.scope not in ("document", "project"):
            raise ValueError(f"rule '{rule.id}': severity or scope is unknown")
        self.rules[rule.id] = rule
        return rule

    def prefixes(self) -> set[str]:
        """Prefixes that user-defined rule ids may not take."""
        return {r.split("-")[0] for r in self.rules}

    def get(self, rule_id: str) -> Rule:
        from corpusloom.sources.markdown import canonical_rule_id

        rule = self.rules.get(canonical_rule_id(rule_id))
        if rule is None:
            near = difflib.get_close_matches(rule_id.upper(), list(self.rules), 1, 0.6)
            raise ConfigError([f"unknown rule '{rule_id}'" + (f" (did you mean '{near[0]}'?)" if near else suggestion(rule_id, list(self.rules)))])
        return rule

    def metadata(self) -> list[dict]:
        return [{"id": r.id, "category": r.category, "description": r.description, "severity": r.severity, "scope": r.scope, "fixable": r.fixable} for r in sorted(self.rules.values(), key=lambda r: r.id)]

    def table(self) -> str:
        """The rules as a Markdown table."""
        lines = ["| Rule | Category | Severity | Scope | Fixable | Description |", "| --- | --- | --- | --- | --- | --- |"]
        lines += [f"| {m['id']} | {m['category']} | {m['severity']} | {m['scope']} | {'yes' if m['fixable'] else 'no'} | {m['description']} |" for m in self.metadata()]
        return "\n".join(lines)


registry = Registry()
