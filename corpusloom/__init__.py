"""corpusloom: a PySpark-native analytics engine for collections of Markdown documents."""

from __future__ import annotations

from importlib import import_module
from typing import Any

from pyspark.sql import SparkSession

#: The public names and where they are; each module is imported when one of its names is first used.
_PUBLIC = {
    "errors": ("CODES", "EngineError"),
    "sources.corpus": ("Corpus",),
    "sources.listing": ("Scope", "find_config", "read_corpus", "read_table", "read_tree"),
    "operators.registry": ("ConfigError", "Option", "Rule", "registry"),
    "operators.graph": ("analyze", "build_edges", "build_nodes", "components", "context_slice", "coverage", "cycles", "impact", "reading_order", "search_index", "strong_components", "topological_levels", "traverse"),
    "operators.infer": ("clusters", "propose", "scan_repository"),
    "operators.profile": ("budget", "profiles"),
    "plans.compile": ("compile_corpus", "describe_rules"),
    "plans.config": ("Config", "from_dict", "json_schema", "load", "merge_into", "write"),
    "plans.findings": ("counts", "exit_code", "lint", "ordered", "within"),
    "plans.fix": ("apply_fixes",),
    "plans.render": ("findings_json", "findings_text", "graph_dot", "graph_json", "graph_mermaid", "summary"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = ["ship", *_HOME]


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module '{__name__}' has no attribute '{name}'")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__() -> list[str]:
    return sorted(__all__)


_shipped_to: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session, once, so that they need no installation or path of their own."""
    import tempfile
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(here.rglob("*.py")):
            archive.write(source, Path("corpusloom") / source.relative_to(here))
    context.addPyFile(str(target))
    _shipped_to.add(context.applicationId)
