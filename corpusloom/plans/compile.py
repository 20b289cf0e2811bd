"""The compiled artifact: one deterministic Markdown document that describes a corpus, with a content hash."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.functions.globs import glob_column
from corpusloom.operators import graph as g
from corpusloom.operators.profile import budget, profiles
from corpusloom.plans.config import Config
from corpusloom.plans.render import elide
from corpusloom.sources.corpus import Corpus

#: How many of the most referenced documents, and of each one's references, are shown.
DOCUMENTS, REFERENCES = 25, 10


def one_line(text: str) -> str:
    return re.sub(r"\r\n|\r|\n", " ", text)


def code(text: str) -> str:
    """A code span that holds any text: its fence is longer than each run of backticks inside."""
    text = one_line(text)
    fence = "`" * (max(map(len, re.findall("`+", text)), default=0) + 1)
    pad = " " if not text or text[0] == "`" or text[-1] == "`" else ""
    return f"{fence}{pad}{text}{pad}{fence}"


def cell(text: str) -> str:
    """A text inside one cell of a table."""
    return re.sub(r"([\\|])", r"\\\1", one_line(text))


def phrase(value: object) -> str:
    """An option's value in words: lists end in 'and', texts are code."""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, dict):
        return "; ".join(f"{k} {phrase(v)}" for k, v in sorted(value.items()))
    if isinstance(value, list):
        said = [phrase(v) for v in value]
        return " and ".join([", ".join(said[:-1]), said[-1]] if len(said) > 1 else said) if said else "none"
    return code(value) if isinstance(value, str) else str(value)


def describe_rules(config: Config) -> list[str]:
    """Active rules by category: what each asks for, in the order of ids and, within one, of the configuration."""
    groups: dict[str, list[tuple[str, str]]] = {}
    for rule, options, severity in config.bound:
        if severity != "off":
            said = "".join(f" {n}: {phrase(v)}." for n, v in sorted(options.items()))
            groups.setdefault(rule.category, []).append((rule.id, f"- {code(rule.id)} ({severity or rule.severity}): {one_line(rule.description)}{said}"))
    return [line for c in sorted(groups) for line in (f"### {c}", "", *[said for _, said in sorted(groups[c], key=lambda x: x[0])], "")]


def kind_of(profile: Row) -> str:
    """reference (its cells hold one family of ids), tabular (it has a table) or narrative."""
    return "reference" if profile["id_pattern"] else "tabular" if profile["table_schemas"] else "narrative"


def budget_lines(corpus: Corpus, edges: DataFrame, entries: list[dict], tokens: int) -> tuple[list[str], list[str]]:
    """(lines of the budget's section, entry points over budget). entries: options of each active LLM-001."""
    out, over = [f"The corpus has about {tokens} tokens.", ""], []
    if not entries:
        return [*out, "No rule sets a budget for entry points."], over
    if corpus.paths.where(glob_column(F.col("path"), [p for e in entries for p in e["entrypoints"]])).isEmpty():
        return [*out, "No document is an entry point of the rule that sets a budget."], over
    for r in budget(corpus, edges, entries).orderBy("path").collect():
        over.append(r["path"])
        out.append(f"- {code(r['path'])}: {r['total']} of {r['limit']} tokens ({(r['total'] - r['limit']) * 100 / r['limit']:.1f}% over)")
    return out if over else [*out, "All entry points are within budget."], over


def compile_corpus(corpus: Corpus, config: Config) -> tuple[str, dict]:
    """(artifact, metadata). Two runs over the same corpus give the same bytes."""
    edges = g.build_edges(corpus, config.id_ref).persist()
    nodes = g.roles(g.build_nodes(corpus.paths, edges)).persist()
    order, excluded = g.topological_order(corpus.paths, edges)
    tokens = corpus.tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    histogram = {r["role"]: r["count"] for r in nodes.groupBy("role").count().orderBy("role").collect()}
    loops = g.cycles(corpus.paths, edges)
    entries = [o for rule, o, sev in config.bound if rule.id == "LLM-001" and sev != "off"]
    spent, over = budget_lines(corpus, edges, entries, tokens["t"])
    top = nodes.orderBy(F.desc("in_degree"), "path").limit(DOCUMENTS).select("path")
    shown = profiles(corpus, edges).join(F.broadcast(top), "path", "left_semi").orderBy("path").collect()
    name = config.compile.get("name", "corpus")
    about = config.compile.get("description", "What this collection of documents holds and how it hangs together.")
    # Texts in double quotes of JSON are such texts in YAML too.
    out = ["---", f"name: {json.dumps(name, ensure_ascii=False)}", f"description: {json.dumps(about, ensure_ascii=False)}", "---", "", f"# {one_line(name)}", ""]
    out += ["## Overview", "", f"{tokens['n']} documents, about {tokens['t']} tokens.", "", *[f"- {k}: {v}" for k, v in histogram.items()], ""]
    out += ["## Rules", "", *(describe_rules(config) or ["No rules.", ""])]
    out += ["## Documents", ""]
    if shown:
        out += ["| Path | Role | Kind | References in | out |", "| --- | --- | --- | --- | --- |"]
        out += [f"| {cell(p['path'])} | {p['role']} | {kind_of(p)} | {len(p['referenced_by'] or [])} | {len(p['references_to'] or [])} |" for p in shown]
        out += ["", *([f"{tokens['n'] - len(shown)} documents that fewer refer to are left out.", ""] if tokens["n"] > len(shown) else [])]
    for p in shown:
        out += [f"### {code(p['path'])}", "", f"Role: {p['role']}." + (f" Ids: {code(p['id_pattern'])}." if p["id_pattern"] else ""), ""]
        out += [f"{'  ' * (h['depth'] - 1)}- {one_line(h['text'])}" for h in p["outline"] or []]
        out += [f"- table: {', '.join(code(h) for h in t['headers'])}" for t in p["table_schemas"] or []]
        for label, refs in (("refers to", p["references_to"]), ("referenced by", p["referenced_by"])):
            refs = refs or []
            out += [f"- {label} {code(r['path'])} ({r['type']})" for r in refs[:REFERENCES]]
            out += [f"- {label} {len(refs) - REFERENCES} more"] if len(refs) > REFERENCES else []
        out.append("")
    out += ["## Reading order", "", *[f"{k}. {code(x)}" for k, x in enumerate(order[:DOCUMENTS], 1)], *([f"... and {len(order) - DOCUMENTS} more"] if len(order) > DOCUMENTS else []), ""]
    if excluded:
        out += [f"{len(excluded)} documents lie on cycles or behind them.", "", *[f"- {elide(c)}" for c in loops], ""]
    out += ["## Context budget", "", *spent, ""]
    body = "\n".join(out)
    digest = hashlib.sha256(body.encode()).hexdigest()[:16]
    edges.unpersist()
    nodes.unpersist()
    return f"{body}\n<!-- sha256 {digest} -->\n", {"hash": digest, "documents": tokens["n"], "tokens": tokens["t"], "roles": histogram, "overBudget": over, "excluded": len(excluded)}
