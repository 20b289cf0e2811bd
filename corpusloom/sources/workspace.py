"""Workspace packages and the package manager of a checkout, from its own files only."""

from __future__ import annotations

import json
import re
from pathlib import Path

from corpusloom.functions.globs import matches
from corpusloom.sources.listing import NOISE

#: Lock files in order of precedence.
LOCK_FILES = {"bun.lockb": "bun", "bun.lock": "bun", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "package-lock.json": "npm"}


def package_manager(start: str) -> str | None:
    """By the nearest lock file in start or above; not above a repository's root and not from the home folder."""
    here, home = Path(start).resolve(), Path.home().resolve()
    for at in (here, *here.parents):
        if at == home and at != here:
            return None
        found = next((name for file, name in LOCK_FILES.items() if (at / file).is_file()), None)
        if found or (at / ".git").exists():
            return found
    return None


def _json(path: Path) -> dict:
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return data if isinstance(data, dict) else {}


def declared_globs(root: str) -> list[str] | None:
    """Globs of workspace packages, or None if nothing declares any."""
    given = _json(Path(root) / "package.json").get("workspaces")
    if isinstance(given, dict):
        given = given.get("packages")
    if isinstance(given, list):
        return [g for g in given if isinstance(g, str)]
    listing = Path(root) / "pnpm-workspace.yaml"
    if not listing.is_file():
        return None
    block = re.search(r"^packages:[ \t]*(?:#.*)?\n((?:[ \t]*(?:-.*|#.*)?\n)*)", listing.read_text(encoding="utf-8") + "\n", re.MULTILINE)
    items = re.findall(r"^[ \t]*-[ \t]*(?:'([^']*)'|\"([^\"]*)\"|([^\s#][^#\n]*?))[ \t]*(?:#.*)?$", block[1] if block else "", re.MULTILINE)
    return [a or b or c for a, b, c in items]


def workspace_packages(root: str) -> list[dict]:
    """path and name of each package; without a declaration, of folders one level down that hold a package.json."""
    top = Path(root)
    globs = declared_globs(root)
    found = []
    for file in sorted(top.rglob("package.json")):
        path = file.parent.relative_to(top).as_posix()
        if path == "." or any(p in NOISE for p in path.split("/")):
            continue
        if matches(path, [g.strip("/").removeprefix("./") if not g.startswith("!") else g.rstrip("/") for g in globs]) if globs is not None else path.count("/") <= 1 and path.split("/")[0] in ("packages", "apps"):
            found.append({"path": path, "name": _json(file).get("name")})
    return found
