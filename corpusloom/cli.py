"""Command line: lint (default), graph, slice, impact, compile, schema, init, rules."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from corpusloom.errors import EngineError, said
from corpusloom.operators import graph as g
from corpusloom.operators.infer import clusters, propose
from corpusloom.operators.registry import registry
from corpusloom.plans import config as conf
from corpusloom.plans import findings as plan
from corpusloom.plans import fix, render
from corpusloom.plans.compile import compile_corpus
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.listing import CONFIG_NAME, find_config, read_corpus

OK, FOUND, FAILED = 0, 1, 2
COMMANDS = ("lint", "graph", "slice", "impact", "compile", "schema", "init", "rules")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corpusloom")
    sub = out.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        if name in ("slice", "impact"):
            p.add_argument("target")
        if name not in ("schema", "rules"):
            p.add_argument("path", nargs="?", default=".")
            p.add_argument("--config")
        if name in ("lint", "graph", "slice", "impact"):
            p.add_argument("--format", default="text", choices=["text", "json", *(["mermaid", "dot"] if name == "graph" else [])])
        if name == "lint":
            p.add_argument("--fix", action="store_true")
            p.add_argument("--fail-on", default="error", choices=["off", "warning", "error"])
        if name == "slice":
            p.add_argument("--depth", type=int, default=2)
            p.add_argument("--types", nargs="*", choices=g.EDGE_TYPES)
        if name in ("compile", "schema"):
            p.add_argument("--out")
        if name == "init":
            p.add_argument("--yes", action="store_true")
    return out


def load(spark: SparkSession, args: argparse.Namespace) -> tuple[conf.Config, Corpus, str]:
    file = args.config or find_config(args.path)
    if args.config and not Path(args.config).is_file():
        raise EngineError("CONFIG_NOT_FOUND", f"there is no configuration '{args.config}'")
    config = conf.load(Path(file).read_text(encoding="utf-8")) if file else conf.Config()
    root = str(Path(file).parent) if file and not args.config else args.path
    return config, read_corpus(spark, root, config.scope, config.router), root


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv = ["lint", *argv]
    args = parser().parse_args(argv)
    try:
        if args.command == "schema":
            return _emit(json.dumps(conf.json_schema(), indent=2), args.out)
        if args.command == "rules":
            return _emit(registry.table(), None)
        return _run(spark or SparkSession.builder.appName("corpusloom").getOrCreate(), args)
    except EngineError as error:
        print("\n".join(getattr(error, "issues", None) or [said({"message": str(error), "hint": error.hint or ""})]), file=sys.stderr)
        return FAILED
    except (OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return FAILED


def _emit(text: str, out: str | None) -> int:
    if out:
        return OK if not fix.write_files({out: text})[1] else FAILED
    print(text)
    return OK


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    config, corpus, root = load(spark, args)
    files = [r["path"] for r in corpus.paths.orderBy("path").collect()]
    if args.command == "lint":
        if args.fix:
            fix_files(corpus, config, root)
            corpus = read_corpus(spark, root, config.scope, config.router)
        found = plan.lint(corpus, config.bound).persist()
        print(render.findings_json(found, files) if args.format == "json" else render.findings_text(found, len(files)))
        c = plan.counts(found).first()
        return plan.exit_code(c["errors"], c["warnings"], args.fail_on)
    if args.command == "init":
        rules = propose(corpus)
        data = {"include": [r["include"] for r in clusters(corpus.paths).collect()] or ["**/*.md"], "rules": [{k: r[k] for k in ("rule", "options") if r[k]} for r in rules]}
        target = Path(root) / CONFIG_NAME
        if target.exists():
            text = conf.merge_into(target.read_text(encoding="utf-8"), data["rules"])
        else:
            text = conf.write(data, {k: r["evidence"] for k, r in enumerate(rules)})
        return _emit(text, str(target) if args.yes else None)
    edges = g.build_edges(corpus, config.id_ref).persist()
    if args.command == "graph":
        outside = [r["path"] for r in g.coverage(corpus).orderBy("path").collect()]
        made = {
            "text": lambda: render.summary_text(render.summary(corpus.paths, edges, outside)), "json": lambda: render.graph_json(corpus.paths, edges, g.cycles(corpus.paths, edges)),
            "mermaid": lambda: render.graph_mermaid(corpus.paths, edges), "dot": lambda: render.graph_dot(corpus.paths, edges),
        }
        return _emit(made[args.format](), None)
    if args.command == "slice":
        kind, visits = g.context_slice(corpus, edges, args.target, config.id_ref, args.depth, args.types)
        rows = [r.asDict() for r in visits.orderBy("path").collect()]
        print(json.dumps({"match": kind, "visited": rows}, indent=2) if args.format == "json" else render.visits_text(kind, visits))
        return OK if kind else FAILED
    if args.command == "impact":
        if args.target not in files:
            raise EngineError("TARGET_NOT_FOUND", f"'{args.target}' is no document of the corpus", f"paths are relative to {root}")
        parts = g.impact(args.target, edges)
        order, excluded = g.reading_order(parts["affected"], edges)
        found = plan.within(plan.lint(corpus, config.bound), parts["affected"])
        if args.format == "json":
            print(json.dumps({"directly": [r.asDict() for r in parts["directly"].orderBy("path").collect()], "transitively": [r.asDict() for r in parts["transitively"].orderBy("path").collect()], "readingOrder": order, "excluded": excluded, "findings": json.loads(render.findings_json(found, files))["messages"]}, indent=2))
        else:
            print(render.impact_text(args.target, parts, order, excluded))
            print(render.findings_text(found, parts["affected"].count()))
        return OK
    text, _ = compile_corpus(corpus, config)
    return _emit(text, args.out or config.compile.get("outFile"))


def fix_files(corpus: Corpus, config: conf.Config, root: str) -> int:
    """Apply the fixes of active fixable rules; tasks write the files. The number of files; OSError if some could not be written."""
    report = fix.apply_fixes(corpus, config.bound, root)
    if report is None:
        return 0
    done = report.where("written").count()
    failed = report.where("error is not null").orderBy("path").first()
    if failed:
        raise OSError(f"--fix could not write {failed['path']} ({failed['error']}); {done} files were changed")
    return done


if __name__ == "__main__":
    sys.exit(main())
