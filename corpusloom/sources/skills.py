"""Static skill files: a `---` fenced header of JSON scalars, with one nested map, checked without raising."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

#: Header fields: whether each must be there. `metadata` holds one level of string entries.
FIELDS = {"name": True, "description": True, "license": False, "metadata": False}
_ENTRY = re.compile(r"(?P<indent>\s*)(?P<key>[A-Za-z][\w-]*):[ \t]*(?P<value>.*?)[ \t]*$")


@dataclass
class Skill:
    id: str
    path: str
    kind: str = "static"
    frontmatter: dict[str, Any] = field(default_factory=dict)


def path_problem(path: str) -> str | None:
    """Why a path is not a plain repository path, or None."""
    segments = path.split("/")
    if "\\" in path or re.match(r"[A-Za-z]:", path) or any(s in ("", ".", "..") for s in segments):
        return "not a plain path below the root"
    return None if len(segments) >= 2 else "no folder to name the skill"


def read_skill(path: str, text: str) -> tuple[Skill | None, list[tuple[str, str]]]:
    """(skill, issues as (place, message) in order); a skill only without issues."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0] != "---" or "---" not in lines[1:]:
        return None, [("frontmatter", "the header must stand between two '---' lines")]
    header = lines[1 : lines.index("---", 1)]
    issues: list[tuple[str, str]] = []
    top: dict[str, Any] = {}
    scopes: dict[str, dict[str, Any]] = {"": top}
    inside = ""
    for line in filter(str.strip, header):
        m = _ENTRY.match(line)
        if m is None or m["indent"] not in ("", "  ") or m["indent"] and not inside:
            issues.append(("frontmatter", f"cannot read '{line.strip()}' here"))
            continue
        scope = inside if m["indent"] else ""
        key, place = m["key"], ".".join(filter(None, ("frontmatter", scope, m["key"])))
        if not m["indent"]:
            inside = ""
        if key in scopes[scope]:
            issues.append((place, "given twice"))
        elif not scope and key == "metadata" and not m["value"]:
            inside = "metadata"
            scopes[inside] = top[key] = {}
        else:
            try:
                scopes[scope][key] = json.loads(m["value"])
            except json.JSONDecodeError:
                scopes[scope][key] = None
                issues.append((place, "expected a double-quoted value"))
    if not issues:
        issues += [(f"frontmatter.{k}", "unknown key") for k in top if k not in FIELDS]
        issues += [(f"frontmatter.{k}", "required") for k, needed in FIELDS.items() if needed and k not in top]
        flat = [(f"frontmatter.{k}", v) for k, v in top.items() if k != "metadata"] + [(f"frontmatter.metadata.{k}", v) for k, v in (top.get("metadata") or {}).items()]
        issues += [(where, "expected text") for where, v in flat if not isinstance(v, str) or not v]
        if problem := path_problem(path):
            issues.append(("path", problem))
    return (None, sorted(issues)) if issues else (Skill(path.split("/")[-2], path, frontmatter=top), [])
