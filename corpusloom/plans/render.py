"""Reports as text, JSON, Mermaid and DOT. Inputs are collected results, already bounded by what is reported."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import graph as g
from corpusloom.plans.findings import ordered

HOPS = 8


def _rows(findings: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in ordered(findings).collect()]


def findings_text(findings: DataFrame, files: int) -> str:
    """Grouped by file; place is '-', line or line:col."""
    rows, out, path = _rows(findings), [], None
    for r in rows:
        if r["path"] != path:
            path = r["path"]
            out += ([""] if out else []) + [path]
        place = "-" if not r["line"] else str(r["line"]) if r["col"] is None else f"{r['line']}:{r['col']}"
        out.append(f"  {place}  {r['severity']}  {r['rule_id']}  {r['message']}")
    errors = sum(r["severity"] == "error" for r in rows)
    return "\n".join([*out, *([""] if out else []), f"{files} file(s), {errors} error(s), {len(rows) - errors} warning(s)"])


def findings_json(findings: DataFrame, files: list[str]) -> str:
    rows = _rows(findings)
    errors = sum(r["severity"] == "error" for r in rows)
    return json.dumps({"summary": {"files": len(files), "errors": errors, "warnings": len(rows) - errors}, "messages": rows, "files": files}, ensure_ascii=False, indent=2)


def elide(walk: list[str], hops: int = HOPS) -> str:
    """A walk, its middle left out beyond `hops` steps."""
    if len(walk) - 1 <= hops:
        return " -> ".join(walk)
    half = hops // 2
    return " -> ".join([*walk[:half], f"... {len(walk) - 2 * half} more ...", *walk[-half:]])


def graph_tables(paths: DataFrame, edges: DataFrame) -> tuple[list[dict], list[dict]]:
    nodes = [r.asDict() for r in g.build_nodes(paths, edges).orderBy("path").collect()]
    arcs = [r.asDict() for r in edges.orderBy("src", "dst", "type", "line").collect()]
    return nodes, arcs


def graph_json(paths: DataFrame, edges: DataFrame, cycles: list[list[str]]) -> str:
    nodes, arcs = graph_tables(paths, edges)
    return json.dumps({"nodes": nodes, "edges": arcs, "cycles": cycles}, ensure_ascii=False, indent=2)


def graph_mermaid(paths: DataFrame, edges: DataFrame) -> str:
    nodes, arcs = graph_tables(paths, edges)
    name = {n["path"]: f"n{k}" for k, n in enumerate(nodes)}
    label = lambda t: t.replace("#", "#35;").replace('"', "#quot;")
    pairs = dict.fromkeys((a["src"], a["dst"], a["type"]) for a in arcs)
    return "\n".join(["graph LR", *[f'  {name[n["path"]]}["{label(n["path"])}"]' for n in nodes], *[f"  {name[a]} -->|{t}| {name[b]}" for a, b, t in pairs]]) + "\n"


def graph_dot(paths: DataFrame, edges: DataFrame) -> str:
    nodes, arcs = graph_tables(paths, edges)
    name = {n["path"]: f"n{k}" for k, n in enumerate(nodes)}
    label = lambda t: t.replace("\\", "\\\\").replace('"', '\\"')
    pairs = dict.fromkeys((a["src"], a["dst"], a["type"]) for a in arcs)
    return "\n".join(["digraph corpus {", "  rankdir=LR;", *[f'  {name[n["path"]]} [label="{label(n["path"])}"];' for n in nodes], *[f'  {name[a]} -> {name[b]} [label="{t}"];' for a, b, t in pairs], "}"]) + "\n"


def summary(paths: DataFrame, edges: DataFrame, outside: list[str] = ()) -> dict:
    """Counts, entry points, hubs, components, what cycles exclude, cycles and files outside the corpus."""
    analysis = g.analyze(paths, edges).persist()
    nodes = analysis.select("path", "in_degree", "out_degree")
    split = g.exclusion_counts(analysis).first()
    parts = g.components(paths, edges).groupBy("component").count().agg(F.count("*").alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("largest")).first()
    out = {
        "nodes": nodes.count(), "edges": edges.count(),
        "entryPoints": [r["path"] for r in nodes.where("in_degree = 0").orderBy("path").collect()],
        "hubs": [{"path": r["path"], "degree": r["degree"]} for r in g.hubs(nodes).collect()],
        "components": {"count": parts["n"], "largest": parts["largest"]},
        "ordered": split["placed"], "inCycle": split["in_cycle"], "behindCycle": split["behind"],
        "excluded": [r["path"] for r in analysis.where("cause <> 'placed'").orderBy("path").collect()], "cycles": g.cycles(paths, edges), "outsideCorpus": list(outside),
    }
    analysis.unpersist()
    return out


def summary_text(s: dict) -> str:
    out = [f"{s['nodes']} document(s), {s['edges']} reference(s), {s['components']['count']} component(s), the largest with {s['components']['largest']}"]
    out += [f"entry points: {', '.join(s['entryPoints'][:10]) or 'none'}" + (f" and {len(s['entryPoints']) - 10} more" if len(s["entryPoints"]) > 10 else "")]
    out += [f"hub: {h['path']} ({h['degree']})" for h in s["hubs"]]
    out += [f"cycle: {elide(c)}" for c in s["cycles"]]
    if s["excluded"]:
        out.append(f"{len(s['excluded'])} document(s) have no place in a reading order: {s['inCycle']} on cycles, {s['behindCycle']} behind them")
    return "\n".join(out + [f"outside the corpus: {f}" for f in s["outsideCorpus"]])


def visits_text(kind: str | None, visits: DataFrame) -> str:
    rows = visits.orderBy("path").collect()
    head = f"match: {kind or 'none'}, {len(rows)} document(s)"
    return "\n".join([head, *[f"  {r['depth']}  {r['path']}" + (f"  via {r['via']}" if r["via"] else "") for r in rows]])


def impact_text(target: str, parts: dict[str, DataFrame], order: list[str], excluded: list[str]) -> str:
    out = [f"impact of {target}", "directly:"] + [f"  {r['path']} ({r['references']})" for r in parts["directly"].orderBy("path").collect()]
    out += ["transitively:"] + [f"  {r['path']}  depth {r['depth']} via {r['via']}" for r in parts["transitively"].orderBy("depth", "path").collect()]
    out += ["reading order:"] + [f"  {x}" for x in order]
    return "\n".join(out + ([f"excluded by cycles: {', '.join(excluded)}"] if excluded else []))
