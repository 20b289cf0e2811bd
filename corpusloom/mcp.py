"""A read-only stdio server (JSON-RPC, one message a line) with six tools over the same functions as the command line."""

from __future__ import annotations

import json
import sys
from pathlib import Path
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import SparkSession

from corpusloom.errors import CODES, EngineError, describe, said
from corpusloom.functions.globs import in_scope
from corpusloom.operators import graph as g
from corpusloom.plans import config as conf
from corpusloom.plans import findings as plan
from corpusloom.plans import render
from corpusloom.plans.compile import compile_corpus
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.listing import find_config, read_corpus

_TEXT = {"type": "string"}
_WHERE = {"path": {"type": "string", "description": "folder of the corpus"}, "configPath": {"type": "string", "description": "configuration, relative to the folder"}}
TOOLS = {
    "lint": ("Findings for one text.", {"content": _TEXT, "rules": {"type": "array"}}, ["content"]),
    "lint-files": ("Findings for a folder, or for those of its documents that match the patterns.", _WHERE | {"patterns": {"type": "array", "items": _TEXT}}, ["path"]),
    "context-graph": ("The reference graph or its summary.", _WHERE | {"summary": {"type": "boolean"}}, ["path"]),
    "context-slice": ("What a path, id or heading reaches.", _WHERE | {"query": _TEXT, "depth": {"type": "integer", "minimum": 0}}, ["path", "query"]),
    "impact-analysis": ("What a change to a document affects.", _WHERE | {"target": _TEXT}, ["path", "target"]),
    "compile-context": ("The compiled description of a corpus.", _WHERE, ["path"]),
}
_LINTED = {"summary": {"files": 0, "errors": 0, "warnings": 0}, "messages": [], "files": []}
#: A tool's result when it has none: errors carry these fields too, so that they match what a client expects of the tool.
EMPTY: dict[str, dict] = {
    "lint": _LINTED, "lint-files": _LINTED, "context-graph": {"nodes": [], "edges": [], "cycles": []}, "context-slice": {"match": None, "visited": []},
    "impact-analysis": {"directly": [], "transitively": [], "readingOrder": [], "excluded": []}, "compile-context": {},
}
_KINDS = {"string": str, "array": list, "boolean": bool, "integer": int}


def check_arguments(tool: str, arguments: dict) -> None:
    """INVALID_INPUT unless the required arguments are there and all have the types of the tool's schema."""
    _, known, required = TOOLS[tool]
    lost = [k for k in required if k not in arguments]
    if lost:
        raise EngineError("INVALID_INPUT", f"missing argument(s): {', '.join(lost)}")
    for name, value in arguments.items():
        if name not in known:
            raise EngineError("INVALID_INPUT", f"unknown argument '{name}'", f"known ones: {', '.join(known)}")
        shape = known[name]
        wrong = not isinstance(value, _KINDS[shape["type"]]) or shape["type"] == "integer" and isinstance(value, bool)
        wrong = wrong or "items" in shape and not all(isinstance(v, _KINDS[shape["items"]["type"]]) for v in value)
        if wrong or "minimum" in shape and value < shape["minimum"]:
            raise EngineError("INVALID_INPUT", f"argument '{name}' is not as its schema says: {json.dumps(shape)}")


class Server:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.calls: dict[str, Callable[[dict], Any]] = {"lint": self.lint, "lint-files": self.lint_files, "context-graph": self.graph, "context-slice": self.slice, "impact-analysis": self.impact, "compile-context": self.compile}

    def _load(self, a: dict) -> tuple[conf.Config, Corpus]:
        if not Path(a["path"]).is_dir():
            raise EngineError("INVALID_INPUT", f"'{a['path']}' is no folder")
        file = Path(a["path"], a["configPath"]) if "configPath" in a else find_config(a["path"])
        if "configPath" in a and not file.exists():
            raise EngineError("CONFIG_NOT_FOUND", f"there is no configuration '{a['configPath']}'", "it is looked up from the folder of the corpus")
        config = conf.load(Path(file).read_text(encoding="utf-8")) if file else conf.Config()
        return config, read_corpus(self.spark, a["path"], config.scope, config.router)

    def lint(self, a: dict) -> dict:
        config = conf.from_dict({"rules": a.get("rules", [])})
        corpus = Corpus.in_memory(self.spark, {"content.md": a["content"]})
        # A corpus of one has no graph.
        bound = [b for b in config.bound if b[0].category != "GRP"]
        return json.loads(render.findings_json(plan.lint(corpus, bound), ["content.md"]))

    def lint_files(self, a: dict) -> dict:
        config, corpus = self._load(a)
        found, paths = plan.lint(corpus, config.bound), corpus.paths
        if a.get("patterns"):
            paths = paths.where(in_scope(paths["path"], a["patterns"], [])).persist()
            for name in a["patterns"]:
                if not set(name) & set("*?[{") and paths.where(in_scope(paths["path"], [name], [])).isEmpty():
                    raise EngineError("FILE_NOT_IN_CORPUS", f"'{name}' is no document of the corpus", "its configuration may leave the file out")
            found = plan.within(found, paths)
        return json.loads(render.findings_json(found, [r["path"] for r in paths.orderBy("path").collect()]))

    def graph(self, a: dict) -> dict:
        config, corpus = self._load(a)
        edges = g.build_edges(corpus, config.id_ref)
        if a.get("summary"):
            return render.summary(corpus.paths, edges, [r["path"] for r in g.coverage(corpus).orderBy("path").collect()])
        return json.loads(render.graph_json(corpus.paths, edges, g.cycles(corpus.paths, edges)))

    def slice(self, a: dict) -> dict:
        config, corpus = self._load(a)
        kind, visits = g.context_slice(corpus, g.build_edges(corpus, config.id_ref), a["query"], config.id_ref, a.get("depth", 2))
        if kind is None:
            raise EngineError("TARGET_NOT_FOUND", f"'{a['query']}' is no path, id or heading of the corpus")
        return {"match": kind, "visited": [r.asDict() for r in visits.orderBy("path").collect()]}

    def impact(self, a: dict) -> dict:
        config, corpus = self._load(a)
        if corpus.paths.where(corpus.documents["path"] == a["target"]).isEmpty():
            raise EngineError("TARGET_NOT_FOUND", f"'{a['target']}' is no document of the corpus", "paths are relative to the folder of the corpus")
        edges = g.build_edges(corpus, config.id_ref)
        parts = g.impact(a["target"], edges)
        order, excluded = g.reading_order(parts["affected"], edges)
        return {"directly": [r.asDict() for r in parts["directly"].orderBy("path").collect()], "transitively": [r.asDict() for r in parts["transitively"].orderBy("path").collect()], "readingOrder": order, "excluded": excluded}

    def compile(self, a: dict) -> dict:
        config, corpus = self._load(a)
        if not config.compile:
            raise EngineError("COMPILE_CONFIG_MISSING", "the configuration has no 'compile' entry", "add one, with a name and a description")
        text, metadata = compile_corpus(corpus, config)
        return {"artifact": text, "metadata": metadata}

    def handle(self, message: dict) -> dict | None:
        if "id" not in message:
            return None
        reply = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params", {})
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "corpusloom", "version": "1"}}}
        if method == "tools/list":
            error = {"code": {"enum": list(CODES)}, "message": _TEXT, "hint": _TEXT}
            return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}, "outputSchema": {"type": "object", "properties": {k: {} for k in EMPTY[n]} | error}, "annotations": {"readOnlyHint": True}} for n, (d, p, r) in TOOLS.items()]}}
        if method == "tools/call" and params.get("name") in TOOLS:
            tool, arguments = params["name"], params.get("arguments", {})
            try:
                check_arguments(tool, arguments)
                result, failed = self.calls[tool](arguments), False
                text = json.dumps(result, ensure_ascii=False)
            except Exception as error:  # whatever it is, the client gets one of the codes
                problem = describe(error, arguments.get("path") if isinstance(arguments.get("path"), str) else None)
                result, failed, text = EMPTY[tool] | problem, True, said(problem)
            return reply | {"result": {"content": [{"type": "text", "text": text}], "structuredContent": result, "isError": failed}}
        return reply | {"error": {"code": -32601, "message": f"unknown method '{method}'"}}


def serve(spark: SparkSession, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    server = Server(spark)
    for line in source:
        if line.strip():
            try:
                reply = server.handle(json.loads(line))
            except json.JSONDecodeError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=sink, flush=True)
