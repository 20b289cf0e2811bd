"""From rules to a result: union, severity, suppression, total order, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.registry import Rule
from corpusloom.sources.corpus import Corpus

COLUMNS = ["rule_id", "severity", "message", "path", "line", "col", "fixable", "data"]


def evaluate(corpus: Corpus, bound: list[tuple[Rule, dict, str | None]]) -> DataFrame:
    """Findings of all (rule, options, configured severity); rules that are off are never built."""
    parts = []
    for rule, options, severity in bound:
        if severity == "off":
            continue
        own = rule.check(corpus, options)
        level = F.lit(severity) if severity else F.coalesce("severity", F.lit(rule.severity))
        parts.append(own.select(F.lit(rule.id).alias("rule_id"), level.alias("severity"), "message", "path", "line", "col", F.lit(rule.fixable).alias("fixable"), "data"))
    if not parts:
        return corpus.documents.sparkSession.createDataFrame([], "rule_id string, severity string, message string, path string, line int, col int, fixable boolean, data map<string,string>")
    return reduce(DataFrame.unionByName, parts)


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """findings without those that directives (path, pos, kind, rule_ids, line) switch off.

    disable-next-line counts for the line below it; of block directives up to the finding's line that name its rule (or
    none) the last decides. The directives of a path travel as one small array, so findings are neither multiplied nor
    grouped: one join.
    """
    own = directives.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "pos", "kind", "rule_ids"))).alias("directives"))
    df = findings.join(own, "path", "left")
    applies = lambda d: (F.size(d["rule_ids"]) == 0) | F.array_contains(d["rule_ids"], F.col("rule_id"))
    block = F.filter("directives", lambda d: (d["kind"] != "disable-next-line") & (d["line"] <= F.col("line")) & applies(d))
    last = F.element_at(block, -1)["kind"] == "disable"
    following = F.exists("directives", lambda d: (d["kind"] == "disable-next-line") & (d["line"] + 1 == F.col("line")) & applies(d))
    off = (F.col("line") > 0) & F.col("directives").isNotNull() & ((F.when(F.size(block) > 0, last).otherwise(F.lit(False))) | following)
    return df.where(~F.coalesce(off, F.lit(False))).drop("directives")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", F.coalesce("col", F.lit(0)), "rule_id", "message")


def counts(findings: DataFrame) -> DataFrame:
    """errors, warnings."""
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def lint(corpus: Corpus, bound: list[tuple[Rule, dict, str | None]]) -> DataFrame:
    """All findings that stand, in no particular order; see ordered()."""
    return suppress(evaluate(corpus, bound), corpus.directives)


def within(findings: DataFrame, affected: DataFrame) -> DataFrame:
    """Findings in affected(path) only; every rule has seen the whole corpus."""
    return findings.join(affected.select("path"), "path", "left_semi")


def exit_code(errors: int, warnings: int, fail_on: str = "error") -> int:
    """off: 0; error: errors count; warning: anything counts."""
    return int(fail_on != "off" and (errors > 0 or fail_on == "warning" and warnings > 0))
