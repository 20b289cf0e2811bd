import json

from corpusloom.sources.skills import read_skill
from corpusloom.sources.workspace import declared_globs, package_manager, workspace_packages


def test_skill_headers():
    good = '---\nname: "a"\ndescription: "b"\nmetadata:\n  homepage: "c"\n---\nbody\n'
    skill, issues = read_skill("skills/one/SKILL.md", good)
    assert not issues and skill.id == "one" and skill.frontmatter["metadata"] == {"homepage": "c"}
    places = lambda text, path="skills/one/SKILL.md": [p for p, _ in read_skill(path, text)[1]]
    assert places("no header") == ["frontmatter"]
    assert places('---\nname: "a"\nname: "b"\ndescription: bare\n   x: "1"\n---\n') == ["frontmatter", "frontmatter.description", "frontmatter.name"]
    assert places('---\nname: "a"\ndescription: "b"\n  stray: "c"\n---\n') == ["frontmatter"]
    assert places('---\nname: "a"\nextra: "b"\n---\n') == ["frontmatter.description", "frontmatter.extra"]
    assert places(good, "../x/SKILL.md") == ["path"] and places(good, "SKILL.md") == ["path"]


def test_workspaces(tmp_path):
    for p in ("packages/a", "packages/b", "tools/c", "node_modules/d"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "package.json").write_text(json.dumps({"name": p}))
    assert declared_globs(str(tmp_path)) is None
    assert [w["path"] for w in workspace_packages(str(tmp_path))] == ["packages/a", "packages/b"]
    (tmp_path / "pnpm-workspace.yaml").write_text("packages:\n  - 'packages/*' # all\n  - \"!packages/b\"\n  - tools/c\n")
    assert declared_globs(str(tmp_path)) == ["packages/*", "!packages/b", "tools/c"]
    assert [w["path"] for w in workspace_packages(str(tmp_path))] == ["packages/a", "tools/c"]
    (tmp_path / "package.json").write_text(json.dumps({"workspaces": []}))
    assert workspace_packages(str(tmp_path)) == []
    (tmp_path / ".git").mkdir()
    assert package_manager(str(tmp_path / "packages" / "a")) is None
    (tmp_path / "yarn.lock").write_text("")
    assert package_manager(str(tmp_path / "packages" / "a")) == "yarn"
