"""The built-in rules and the declarative custom rule, as compositions of primitives, joins and graph operators."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.globs import glob_column, in_scope, is_glob, normalize
from corpusloom.functions.patterns import check as java
from corpusloom.functions.patterns import literal
from corpusloom.functions.scalars import byte_length, count_lines, estimate_tokens, file_part, id_tokens, resolve_relative, trim_all
from corpusloom.operators import graph as g
from corpusloom.operators import primitives as p
from corpusloom.operators.primitives import findings, say
from corpusloom.operators.registry import Option, Rule, registry
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.tables import Tables

TEXT, NUMBER, FLAG = Option("str"), Option("int", least=1), Option("bool")
TEXTS = Option("list", items=TEXT)
SCOPE = {"files": TEXTS, "exclude": TEXTS}
METRICS = ("bytes", "lines", "tokens")
#: How many aliases of a glossary are searched as patterns; a plan with thousands of them would not compile.
FEW_ALIASES = 32
_WORD = re.compile("[A-Za-z0-9_]")


def need(option: Option) -> Option:
    return Option(option.kind, True, option.items, option.fields, option.choices, option.least)


def scoped(df: DataFrame, o: dict) -> DataFrame:
    if o.get("files") is None and not o.get("exclude"):
        return df
    return df.where(in_scope(F.col("path"), o.get("files"), o.get("exclude")))


def rule(id: str, description: str, severity: str, scope: str, options: dict[str, Option], fixable: bool = False, validate=None):
    def add(f):
        registry.add(Rule(id, id.split("-")[0], description, severity, scope, options, f, fixable, validate))
        return f

    return add


# --- size ---------------------------------------------------------------------------------------------------------

_BUDGET = Option("dict", fields={"warn": NUMBER, "error": NUMBER})


def _size_issues(o: dict) -> list[str]:
    budgets = [x[m] for x in (o, *o.get("overrides", [])) for m in METRICS if m in x]
    if not budgets:
        return ["at least one budget for bytes, lines or tokens is needed"]
    return ["a budget needs warn or error"] if any(not b for b in budgets) else []


def size_findings(documents: DataFrame, o: dict) -> DataFrame:
    """documents: path, content. A finding for each metric strictly over its budget; error supersedes warn."""
    measured = documents.select("path", byte_length(F.col("content")).alias("bytes"), count_lines(F.col("content")).alias("lines"), estimate_tokens(F.col("content")).alias("tokens"))
    parts = []
    for m in METRICS:

        def limit(kind: str, m: str = m) -> Column:
            out = F.lit(o.get(m, {}).get(kind)).cast("long")
            for x in reversed([x for x in o.get("overrides", []) if m in x]):
                out = F.when(glob_column(F.col("path"), [x["pattern"]]), F.lit(x[m].get(kind)).cast("long")).otherwise(out)
            return out

        parts.append(F.struct(F.lit(m).alias("metric"), F.col(m).alias("actual"), limit("warn").alias("warn"), limit("error").alias("error")))
    df = measured.select("path", F.explode(F.array(*parts)).alias("x")).select("path", "x.*")
    df = df.withColumn("level", F.when(F.col("actual") > F.col("error"), "error").when(F.col("actual") > F.col("warn"), "warning")).where(F.col("level").isNotNull())
    limit = F.when(F.col("level") == "error", F.col("error")).otherwise(F.col("warn"))
    return findings(df, say("%d %s exceed the budget of %d.", F.col("actual"), F.col("metric"), limit), line=F.lit(0), severity=F.col("level"), metric=F.col("metric"), actual=F.col("actual"), limit=limit)


@rule("SIZE-001", "Documents stay within byte, line and token budgets.", "warning", "document", {m: _BUDGET for m in METRICS} | {"overrides": Option("list", items=Option("dict", fields={"pattern": need(TEXT)} | {m: _BUDGET for m in METRICS}))}, validate=_size_issues)
def size(c: Corpus, o: dict) -> DataFrame:
    return size_findings(c.documents.select("path", "content"), o)


@rule("LLM-001", "Each entry point with everything it imports stays within a token budget.", "warning", "project", {"entrypoints": need(Option("list", items=TEXT, least=1)), "maxTokensPerEntrypoint": need(NUMBER)})
def import_budget(c: Corpus, o: dict) -> DataFrame:
    # Resolved once for the budget, what is reached, and the cycles.
    edges = Tables(c.documents.sparkSession, "imports").keep(g.build_edges(c, types=["import"]), "edges")
    budget = closure_tokens(c, edges, o["entrypoints"])
    limit = o["maxTokensPerEntrypoint"]
    over = budget.where(F.col("total") > limit)
    percent = F.format_string("%.1f", (F.col("total") - limit) * 100 / limit)
    said = say("Entry point needs %d estimated tokens, over the budget of " + str(limit) + " (%s%% over).", F.col("total"), percent)
    big = findings(over, said, line=F.lit(0), totalTokens=F.col("total"), maxTokens=F.lit(limit), importedFiles=F.col("imported"), percentOver=percent)
    # Only what entry points reach is reported.
    starts = c.paths.where(glob_column(F.col("path"), o["entrypoints"]))
    reached = g.traverse(starts, edges).select("path")
    asked = p.first_existing(c.imports.join(reached, "path", "left_semi").withColumn("full", F.col("raw_target")).withColumn("raw_target", F.expr("substring(raw_target, 2)")), c.paths, c.router)
    missing = findings(asked.where(F.col("target").isNull()), say("Imported file '%s' does not exist.", F.col("full")), col=F.col("col"), rawTarget=F.col("full"))
    loops = import_cycles(c, edges, asked, o["entrypoints"])
    cyclic = findings(loops, say("Import closes the cycle %s.", F.array_join("cycle", " -> ")), cycle=F.array_join("cycle", " -> "))
    return big.unionByName(missing).unionByName(cyclic).dropDuplicates(["path", "line", "col", "message"])


def import_cycles(c: Corpus, edges: DataFrame, asked: DataFrame, entrypoints: list[str]) -> DataFrame:
    """path, line, cycle: imports that lead back to a document of the chain that led to them, from an entry point.

    asked: imports with path, pos, line and target (null: missing). Documents are visited depth-first, imports in the order of the
    text, each document once for each entry point; an import of a document on the current chain closes a cycle, which is
    the chain from there. Each chain is named once for an entry point, at its first import.

    Only entry points that reach a cycle are walked, each by one task, which gets the imports of its closure in order.
    """
    own = asked.where("target = path").select("path")
    looping = g.strong_components(c.paths, edges).select("path").union(own).distinct()
    reach = closure(c, edges, entrypoints)
    roots = reach.join(looping, "path", "left_semi").select("root").distinct()
    hops = reach.join(roots, "root", "left_semi").join(asked.where("target is not null").select("path", "pos", "line", "target"), "path")
    return hops.select("root", "path", "pos", "line", "target").groupBy("root").applyInArrow(_walk_imports, "path string, line int, cycle array<string>").distinct()


def _walk_imports(group: pa.Table) -> pa.Table:
    hops = group.sort_by([("path", "ascending"), ("pos", "ascending")])
    out: dict[str, list[tuple[str, int]]] = {}
    for path, target, line in zip(*(hops.column(c).to_pylist() for c in ("path", "target", "line")), strict=True):
        out.setdefault(path, []).append((target, line))
    root = group.column("root")[0].as_py()
    chain, place, visited, found = [root], {root: 0}, {root}, {}
    following = [iter(out.get(root, ()))]
    while chain:
        target, line = next(following[-1], (None, 0))
        if target is None:
            following.pop()
            del place[chain.pop()]
        elif target in place:
            found.setdefault((*chain[place[target] :], target), (chain[-1], line))
        elif target not in visited:
            visited.add(target)
            place[target] = len(chain)
            chain.append(target)
            following.append(iter(out.get(target, ())))
    paths, lines = zip(*found.values(), strict=True) if found else ((), ())
    return pa.table([pa.array(paths, pa.string()), pa.array(lines, pa.int32()), pa.array([list(k) for k in found], pa.list_(pa.string()))], names=["path", "line", "cycle"])


def closure(c: Corpus, edges: DataFrame, entrypoints: list[str]) -> DataFrame:
    """root, path: each matching entry point with itself and all that it imports, each once."""
    tables = Tables(edges.sparkSession, "closure")
    hop = tables.keep(g.arcs(edges), "arcs")
    seen = tables.keep(c.paths.where(glob_column(F.col("path"), entrypoints)).select(F.col("path").alias("root"), "path"), "0")
    frontier, step = seen, 0
    while not frontier.isEmpty():
        step += 1
        new = frontier.select("root", F.col("path").alias("src")).join(hop, "src").select("root", F.col("dst").alias("path")).distinct()
        frontier = tables.keep(new.join(seen, ["root", "path"], "left_anti"), f"new{step}")
        seen = tables.keep(seen.unionByName(frontier), f"seen{step}")
    return seen


def closure_tokens(c: Corpus, edges: DataFrame, entrypoints: list[str]) -> DataFrame:
    """path, total, imported: tokens of each matching entry point and of all that it imports, each file once."""
    return closure(c, edges, entrypoints).join(c.tokens, "path").groupBy(F.col("root").alias("path")).agg(F.sum("tokens").alias("total"), (F.count("*") - 1).alias("imported"))


# --- tables -------------------------------------------------------------------------------------------------------

_CONDITION = Option("dict", fields={"column": need(TEXT), "equals": TEXT, "matches": TEXT, "flags": TEXT, "notEmpty": FLAG})


def _condition(o: dict) -> dict:
    return {"not_empty" if k == "notEmpty" else k: v for k, v in o.items()}


@rule("TBL-001", "Tables have the required columns.", "error", "document", SCOPE | {"columns": need(TEXTS), "section": TEXT})
def table_columns(c: Corpus, o: dict) -> DataFrame:
    return p.required_columns(scoped(c.tables, o), o["columns"], o.get("section"))


@rule("TBL-002", "Table cells are filled in.", "warning", "document", SCOPE | {"columns": TEXTS, "section": TEXT}, fixable=True)
def table_not_empty(c: Corpus, o: dict) -> DataFrame:
    return p.column_not_empty(scoped(c.cells, o), o.get("columns"), o.get("section"))


@rule("TBL-003", "Column values come from a set.", "error", "document", SCOPE | {"column": need(TEXT), "values": need(TEXTS), "section": TEXT, "caseSensitive": FLAG})
def table_in_set(c: Corpus, o: dict) -> DataFrame:
    return p.column_in_set(scoped(c.cells, o), o["column"], o["values"], o.get("section"), not o.get("caseSensitive", True))


@rule("TBL-004", "Column values match a pattern.", "error", "document", SCOPE | {"column": need(TEXT), "pattern": need(TEXT), "flags": TEXT, "section": TEXT})
def table_matches(c: Corpus, o: dict) -> DataFrame:
    return p.column_matches(scoped(c.cells, o), o["column"], o["pattern"], o.get("flags", ""), o.get("section"))


@rule("TBL-005", "A condition on one column implies one on another.", "error", "document", SCOPE | {"when": need(_CONDITION), "then": need(_CONDITION), "section": TEXT})
def table_cross(c: Corpus, o: dict) -> DataFrame:
    return p.cross_column(scoped(c.rows, o), _condition(o["when"]), _condition(o["then"]), o.get("section"))


@rule("TBL-006", "Column values are unique in the corpus.", "error", "project", SCOPE | {"column": need(TEXT), "idPattern": TEXT, "section": TEXT})
def table_unique(c: Corpus, o: dict) -> DataFrame:
    return p.column_unique(scoped(c.cells, o), o["column"], o.get("idPattern"), o.get("section"))


# --- sections -----------------------------------------------------------------------------------------------------


@rule("SEC-001", "Documents have the required sections.", "error", "document", SCOPE | {"sections": need(TEXTS)}, fixable=True)
def sections_present(c: Corpus, o: dict) -> DataFrame:
    return p.section_present(scoped(c.paths, o), scoped(c.headings, o), o["sections"])


@rule("SEC-002", "Sections stand in order.", "error", "document", SCOPE | {"order": need(TEXTS), "level": NUMBER, "section": TEXT})
def sections_ordered(c: Corpus, o: dict) -> DataFrame:
    return p.section_order(scoped(c.headings, o), o["order"], o.get("level"), o.get("section"))


@rule("SEC-003", "Documents have the headings of a template.", "error", "project", SCOPE | {"template": need(TEXT), "level": NUMBER})
def sections_of_template(c: Corpus, o: dict) -> DataFrame:
    """The template is a document of the corpus or a file below its root; one that lies elsewhere or is missing is a finding."""
    template = normalize(o["template"])
    spark = c.documents.sparkSession
    if template.startswith(("..", "/")):
        return findings(spark.createDataFrame([(template,)], "path string"), F.lit("The template lies outside the corpus."), line=F.lit(0))
    # The corpus first, then the disk: a frame of one row at most.
    beside = c.single_file(template)
    beside = None if beside is None else beside.join(c.paths, "path", "left_anti")
    heads = c.headings.where(F.col("path") == template).select("pos", "text", "depth")
    if beside is not None:
        heads = heads.unionByName(Corpus.of(beside, persist=False).headings.select("pos", "text", "depth"))
    # Distinct headings of one document: few, and a one-row frame carries them to every document.
    wanted = (heads if o.get("level") is None else heads.where(F.col("depth") == o["level"])).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])).alias("wanted"))
    have = c.headings.groupBy("path").agg(F.collect_set("text").alias("have"))
    docs = scoped(c.paths, o).where(F.col("path") != template).join(have, "path", "left")
    absent = docs.join(F.broadcast(wanted)).select("path", F.explode(F.array_except("wanted", F.coalesce("have", F.array().cast("array<string>")))).alias("name"))
    lost = spark.createDataFrame([(template,)], "path string").join(c.paths if beside is None else c.paths.union(beside.select("path")), "path", "left_anti")
    return findings(absent, say("Heading '%s' of the template is missing.", F.col("name")), line=F.lit(0), section=F.col("name")).unionByName(findings(lost, F.lit("The template does not exist."), line=F.lit(0)))


@rule("STR-001", "Required files exist.", "error", "project", {"files": need(TEXTS)})
def required_files(c: Corpus, o: dict) -> DataFrame:
    """Literal entries may be any file on disk; globs look at the corpus only."""
    spark = c.documents.sparkSession
    plain = [normalize(f) for f in o["files"] if not is_glob(f)]
    globs = [f for f in o["files"] if is_glob(f)]
    lost = spark.createDataFrame([(f,) for f in plain], "path string").join(c.on_disk, "path", "left_anti")
    if globs:
        hits = c.paths.agg(*[F.coalesce(F.bool_or(glob_column(F.col("path"), [f])), F.lit(False)).alias(f"g{k}") for k, f in enumerate(globs)])
        pairs = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f"g{k}").alias("hit")) for k, f in enumerate(globs)])
        lost = lost.unionByName(hits.select(F.explode(pairs).alias("x")).where("not x.hit").select("x.path"))
    return findings(lost, say("Required file '%s' does not exist.", F.col("path")), line=F.lit(0), file=F.col("path"))


# --- references ---------------------------------------------------------------------------------------------------


_ROUTER = Option("dict", fields={"preset": TEXT, "contentDir": TEXT, "defaultLocale": TEXT})


@rule("REF-001", "Links to files resolve.", "error", "document", {"files": TEXTS, "exclude": TEXTS, "siteRouter": _ROUTER})
def links_resolve(c: Corpus, o: dict) -> DataFrame:
    """exclude: targets that are not looked for; siteRouter: instead of the settings' one."""
    return p.link_resolves(scoped(c.links, {"files": o.get("files")}), c.on_disk, o.get("siteRouter", c.router), o.get("exclude"))


@rule("REF-002", "Anchors match a heading.", "error", "document", SCOPE | {"siteRouter": _ROUTER})
def anchors_match(c: Corpus, o: dict) -> DataFrame:
    """Same-file anchors and anchors of links whose target is in the corpus; others and empty anchors are skipped."""
    links = scoped(c.links, o).where(F.col("anchor") != "")
    own = links.where(F.col("kind") == "same-file-anchor").withColumn("target", F.col("path"))
    far = p.first_existing(links.where(F.col("kind") == "local-file"), c.paths, o.get("siteRouter", c.router)).where(F.col("target").isNotNull())
    known = c.headings.select(F.col("path").alias("target"), F.col("slug").alias("anchor")).distinct()
    lost = own.unionByName(far).join(known, ["target", "anchor"], "left_anti")
    return findings(lost, say("No heading '#%s' in '%s'.", F.col("anchor"), F.col("target")), col=F.col("col"), anchor=F.col("anchor"), target=F.col("target"))


@rule("REF-003", "Images resolve.", "error", "document", {"files": TEXTS, "exclude": TEXTS})
def images_resolve(c: Corpus, o: dict) -> DataFrame:
    """exclude: targets that are not looked for."""
    return p.image_resolves(scoped(c.images, {"files": o.get("files")}), c.on_disk, o.get("exclude"))


def zone_of(path: Column, zones_dir: str) -> Column:
    """First folder below zones_dir; null for files elsewhere or directly in it."""
    return F.nullif(F.regexp_extract(path, f"^{literal(normalize(zones_dir))}/([^/]+)/.", 1), F.lit(""))


@rule("REF-004", "Links between zones are declared.", "error", "document", SCOPE | {"zonesDir": need(TEXT), "dependencySection": TEXT})
def zones_declared(c: Corpus, o: dict) -> DataFrame:
    zone = lambda col: zone_of(F.col(col), o["zonesDir"])
    links = scoped(c.links, o).where(F.col("kind") == "local-file").withColumn("target", resolve_relative(F.col("path"), file_part(F.col("raw_target"))))
    links = links.withColumn("from", zone("path")).withColumn("to", zone("target")).where("from is not null and to is not null and from <> to")
    bodies = c.section_bodies.where(F.col("text") == o.get("dependencySection", "Dependencies")).select(zone("path").alias("from"), "body").where("from is not null")
    declared = named_zones(bodies, links.select("from", "to").distinct())
    lost = links.join(declared, ["from", "to"], "left_anti")
    return findings(lost, say("Link from zone '%s' to zone '%s' is not declared.", F.col("from"), F.col("to")), col=F.col("col"), fromZone=F.col("from"), toZone=F.col("to"))


def named_zones(bodies: DataFrame, asked: DataFrame) -> DataFrame:
    """bodies: from, body; asked: from, to. The pairs of which a body of `from` names `to` with no name character on either side.

    An index of the bodies' words is met by the first word of each name: wherever the name stands so, that word is one of
    the text's. A name of one word is decided by that; others are looked for in the bodies that hold their first word, and
    those without any word in all bodies of their zone.
    """
    word = "[A-Za-z0-9_-]+"
    first = F.regexp_extract("to", word, 0)
    asked = asked.withColumn("word", first)
    words = bodies.select("from", "body", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(word), F.lit(0)))).alias("word"))
    stands = F.expr("regexp_like(body, concat('(^|[^A-Za-z0-9_-])\\\\Q', replace(to, '\\\\E', ''), '\\\\E([^A-Za-z0-9_-]|$)'))")
    single = asked.where("word = to").join(words.select("from", "word").distinct(), ["from", "word"], "left_semi").select("from", "to")
    several = asked.where("word <> to and word <> ''").join(words, ["from", "word"]).where(stands).select("from", "to")
    none = asked.where("word = ''").join(bodies, "from").where(stands).select("from", "to")
    return single.unionByName(several).unionByName(none).distinct()


@rule("REF-005", "Ids that are referenced are defined, and the reverse.", "error", "project", {"idPattern": need(TEXT), "definitions": need(TEXTS), "references": need(TEXTS), "idColumn": TEXT, "referenceColumn": TEXT})
def ids_traced(c: Corpus, o: dict) -> DataFrame:
    defined = g.defined_ids(c, o["idPattern"], o["definitions"], o.get("idColumn"))
    cells = c.cells.where(in_scope(F.col("path"), o["references"]))
    if o.get("referenceColumn") or o.get("idColumn"):
        cells = cells.where(F.col("header") == (o.get("referenceColumn") or o["idColumn"]))
    used = cells.select("path", "line", F.explode(id_tokens(F.col("value"))).alias("id")).where(F.col("id").rlike(java(o["idPattern"])))
    return trace(defined, used)


def trace(defined: DataFrame, used: DataFrame) -> DataFrame:
    """defined: path, ord, id, line; used: path, id, line. An error for each dangling use, a warning for each orphan id."""
    dangling = used.join(defined.select("id").distinct(), "id", "left_anti")
    first = defined.groupBy("id").agg(F.min(F.struct("path", "ord", "line")).alias("f")).select("id", "f.path", "f.line")
    orphan = first.join(used.select("id").distinct(), "id", "left_anti")
    return findings(dangling, say("'%s' is not defined.", F.col("id")), severity=F.lit("error"), id=F.col("id")).unionByName(findings(orphan, say("'%s' is never referenced.", F.col("id")), severity=F.lit("warning"), id=F.col("id")))


@rule("REF-006", "Nothing depends on something less stable.", "warning", "project", {"stabilityColumn": need(TEXT), "stabilityOrder": need(Option("list", items=TEXT, least=2)), "definitions": need(TEXTS), "references": need(TEXTS), "idColumn": need(TEXT), "idPattern": TEXT})
def stability(c: Corpus, o: dict) -> DataFrame:
    """Both sides are rows of tables with both columns; a referring row's ids stand in the id column as well."""
    cell = lambda name: trim_all(F.coalesce(F.col("cells")[o[name]], F.lit("")))
    rows = c.rows.where(F.array_contains("headers", o["idColumn"]) & F.array_contains("headers", o["stabilityColumn"]))
    rows = rows.select("path", "table_pos", "row_pos", "line", cell("idColumn").alias("id"), cell("stabilityColumn").alias("level"))
    return less_stable(rows.where(in_scope(F.col("path"), o["definitions"])), rows.where(in_scope(F.col("path"), o["references"])), o["stabilityOrder"], o.get("idPattern"))


def less_stable(defined: DataFrame, used: DataFrame, order: list[str], id_pattern: str | None = None) -> DataFrame:
    """defined, used: path, table_pos, row_pos, line, id, level; order: from least to most stable.

    The last definition of an id with a level counts; rows and definitions of unknown level are skipped.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("level"))
    last = defined.where("id <> '' and level <> ''").groupBy("id").agg(F.max_by("level", F.struct("path", "table_pos", "row_pos")).alias("level")).select(F.col("id").alias("ref"), F.col("level").alias("ref_level"), rank.alias("ref_rank"))
    own = used.withColumn("rank", rank).where("rank > 0").withColumn("ref", F.explode(id_tokens(F.col("id"))))
    own = own if id_pattern is None else own.where(F.col("ref").rlike(java(id_pattern)))
    worse = own.join(last, "ref").where("ref_rank > 0 and ref_rank < rank")
    return findings(worse, say("A row of stability '%s' depends on '%s' (%s).", F.col("level"), F.col("ref"), F.col("ref_level")), id=F.col("ref"), level=F.col("level"), reference_level=F.col("ref_level"))


# --- context ------------------------------------------------------------------------------------------------------


@rule("CTX-001", "Sections have content.", "warning", "document", SCOPE | {"placeholders": TEXTS, "section": TEXT})
def sections_filled(c: Corpus, o: dict) -> DataFrame:
    return p.no_placeholders(scoped(c.section_bodies, o), o.get("placeholders", []), o.get("section"))


@rule("CTX-002", "Checklists are done.", "warning", "document", SCOPE | {"section": TEXT})
def checklists_done(c: Corpus, o: dict) -> DataFrame:
    return p.all_checked(scoped(c.check_items, o), o.get("section"))


@rule("CTX-003", "Terms are used in their canonical form.", "warning", "project", SCOPE | {"glossary": need(TEXT), "termColumn": need(TEXT), "aliasColumn": TEXT, "section": TEXT})
def canonical_terms(c: Corpus, o: dict) -> DataFrame:
    """With a section, only bodies under headings of that text are read. Without an alias column there is nothing to find."""
    inside = glob_column(F.col("path"), [o["glossary"]])
    aliases = {}
    if o.get("aliasColumn"):
        rows = c.rows.where(inside & F.array_contains("headers", o["termColumn"]))
        cell = lambda k: trim_all(F.coalesce(F.col("cells")[o[k]], F.lit("")))
        named = rows.select("path", "table_pos", "row_pos", cell("termColumn").alias("term"), F.explode(F.split(cell("aliasColumn"), ",")).alias("alias")).select("*", trim_all(F.col("alias")).alias("a")).where("a <> '' and term <> '' and a <> term")
        aliases = {r["a"]: r["term"] for r in named.groupBy("a").agg(F.max_by("term", F.struct("path", "table_pos", "row_pos")).alias("term")).orderBy("a").collect()}  # the glossary's tables
    if o.get("section") is None:
        texts = c.documents.select("path", "content", F.lit(0).alias("base"))
    else:
        texts = c.section_bodies.where(F.col("text") == o["section"]).select("path", F.col("body").alias("content"), F.col("line").alias("base"))
    return alias_findings(scoped(texts, o).where(~inside), aliases)


def alias_findings(documents: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """A finding for each whole-word use of each alias, also inside another alias. documents: path, content, base (lines before).

    Up to FEW_ALIASES are patterns of the JVM, one each; more are looked up by their words in one pass over the texts in Arrow
    batches, whose work does not grow with the glossary. Both find the same.
    """
    if len(aliases) > FEW_ALIASES:
        found = documents.select("path", "base", "content").mapInArrow(_alias_uses(aliases), "path string, line int, alias string, term string")
        return findings(found, say("Use '%s' instead of '%s'.", F.col("term"), F.col("alias")), alias=F.col("alias"), term=F.col("term"))
    lines = documents.select("path", "base", F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    if not aliases:
        return findings(lines.where("false").withColumn("line", F.lit(0)), F.lit(""))
    # One alternation tells the lines that hold anything; in those each alias is searched by itself.
    lines = lines.where(F.col("text").rlike("|".join(literal(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))))
    hits = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?<![A-Za-z0-9_])({literal(a)})(?![A-Za-z0-9_])"), F.lit(1)) for a in aliases]))
    found = lines.select("path", (F.col("base") + F.col("n") + 1).alias("line"), F.explode(hits).alias("alias"))
    term = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.col("alias")]
    return findings(found, say("Use '%s' instead of '%s'.", term, F.col("alias")), alias=F.col("alias"), term=term)


def _alias_uses(aliases: dict[str, str]):
    """(path, base, content) -> each use of an alias. An alias is filed under its longest word, or its first character if it
    has none: in a use of it that word is a whole word of the text, so words of the text lead to what may stand around them."""
    filed: dict[str, list[tuple[str, int]]] = {}
    for alias in aliases:
        word = max(re.finditer(r"[A-Za-z0-9_]+", alias), key=lambda m: len(m.group()), default=None)
        filed.setdefault(word.group() if word else alias[0], []).append((alias, word.start() if word else 0))
    signs = "".join(re.escape(k) for k in filed if not _WORD.match(k))
    token = re.compile(r"[A-Za-z0-9_]+" + (f"|[{signs}]" if signs else ""))

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, base, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n, line in enumerate((text or "").split("\n"), base + 1):
                    ends: dict[str, int] = {}
                    for m in token.finditer(line):
                        for alias, before in filed.get(m.group(), ()):
                            start = m.start() - before
                            end = start + len(alias)
                            # Uses of one alias do not overlap, and none touches a letter, digit or underscore.
                            if start >= ends.get(alias, 0) and line.startswith(alias, start) and not _WORD.match(line, end) and not (start and _WORD.match(line, start - 1)):
                                ends[alias] = end
                                rows.append((path, n, alias, aliases[alias]))
            kinds = {"path": pa.string(), "line": pa.int32(), "alias": pa.string(), "term": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))

    return run


# --- graph --------------------------------------------------------------------------------------------------------


@rule("GRP-001", "The reference graph has no cycles.", "error", "project", {"minCycleLength": Option("int", least=2), "idRef": Option("dict")})
def no_cycles(c: Corpus, o: dict) -> DataFrame:
    edges = g.build_edges(c, o.get("idRef"))
    least = o.get("minCycleLength", 3)
    loops = g.cycle_walks(c.paths, edges).where(F.size(F.array_distinct("walk")) >= least)
    rows = loops.select(F.col("walk")[0].alias("path"), F.col("walk")[1].alias("next"), F.array_join("walk", " -> ").alias("walk"))
    first = edges.groupBy(F.col("src").alias("path"), F.col("dst").alias("next")).agg(F.min_by("line", F.struct("type", F.coalesce("line", F.lit(0)))).alias("line"))
    df = rows.join(first, ["path", "next"], "left").withColumn("line", F.coalesce("line", F.lit(0)))
    return findings(df, say("Cycle: %s.", F.col("walk")), cycle=F.col("walk"))


@rule("GRP-002", "Documents are referenced from somewhere.", "warning", "project", SCOPE | {"entrypoints": TEXTS, "idRef": Option("dict")})
def no_orphans(c: Corpus, o: dict) -> DataFrame:
    nodes = g.build_nodes(c.paths, g.build_edges(c, o.get("idRef")))
    entry = glob_column(F.col("path"), o.get("entrypoints", ["README.md", "index.md"]))
    return findings(scoped(nodes, o).where((F.col("in_degree") == 0) & ~entry), F.lit("Nothing references this document."), line=F.lit(0))


_STAGE = Option("dict", fields={"stage": need(TEXT), "files": need(TEXTS), "idColumn": TEXT, "refColumn": need(TEXT)})


@rule("GRP-003", "Every stage is covered by the next one.", "warning", "project", {"chain": need(Option("list", items=_STAGE, least=2)), "idPattern": TEXT})
def stages_covered(c: Corpus, o: dict) -> DataFrame:
    def ids(column: str, files: list[str]) -> DataFrame:
        out = c.cells.where((F.col("header") == column) & in_scope(F.col("path"), files)).select("path", "line", F.explode(id_tokens(F.col("value"))).alias("id"))
        return out if o.get("idPattern") is None else out.where(F.col("id").rlike(java(o["idPattern"])))

    out = None
    for this, after in zip(o["chain"], o["chain"][1:], strict=False):
        if this.get("idColumn"):
            gap = uncovered(ids(this["idColumn"], this["files"]), ids(after["refColumn"], after["files"]), this["stage"], after["stage"])
            out = gap if out is None else out.unionByName(gap)
    return out if out is not None else findings(c.paths.where("false"), F.lit(""), line=F.lit(0))


def uncovered(stage: DataFrame, after: DataFrame, name: str = "", following: str = "") -> DataFrame:
    """stage, after: path, line, id. Every place of an id of a stage that the next one never mentions."""
    lost = stage.join(after.select("id").distinct(), "id", "left_anti")
    return findings(lost, say("'%s' is not covered by the next stage.", F.col("id")), id=F.col("id"), fromStage=F.lit(name), toStage=F.lit(following))


# --- custom -------------------------------------------------------------------------------------------------------

#: kind of a custom rule's assertion -> option names beside `kind`, and the call.
ASSERTIONS = {
    "requiredColumns": ({"columns": need(TEXTS), "section": TEXT}, table_columns),
    "columnNotEmpty": ({"columns": TEXTS, "section": TEXT}, table_not_empty),
    "columnInSet": ({"column": need(TEXT), "values": need(TEXTS), "section": TEXT, "caseSensitive": FLAG}, table_in_set),
    "columnMatches": ({"column": need(TEXT), "pattern": need(TEXT), "flags": TEXT, "section": TEXT}, table_matches),
    "columnUnique": ({"column": need(TEXT), "idPattern": TEXT, "section": TEXT}, table_unique),
    "crossColumn": ({"when": need(_CONDITION), "then": need(_CONDITION), "section": TEXT}, table_cross),
    "sectionPresent": ({"sections": need(TEXTS)}, sections_present),
    "sectionOrder": ({"order": need(TEXTS), "level": NUMBER, "section": TEXT}, sections_ordered),
    "contentNotMatch": ({"pattern": need(TEXT), "flags": TEXT}, lambda c, o: p.content_not_match(scoped(c.documents.select("path", "content"), o), o["pattern"], o.get("flags", ""))),
    "noPlaceholders": ({"placeholders": TEXTS, "section": TEXT}, sections_filled),
    "allChecked": ({"section": TEXT}, checklists_done),
    "linkResolves": ({"excludeTargets": TEXTS}, lambda c, o: p.link_resolves(scoped(c.links, o), c.on_disk, c.router, o.get("excludeTargets"))),
    "imageResolves": ({"excludeTargets": TEXTS}, lambda c, o: p.image_resolves(scoped(c.images, o), c.on_disk, o.get("excludeTargets"))),
}


def custom_rule(rule_id: str, assertion: dict, files: list[str] | None = None, exclude: list[str] | None = None) -> tuple[list[str], Rule | None]:
    """Issues, and the rule if there are none. The id's prefix must not be one of the built-in rules."""
    from corpusloom.operators.registry import _ID, check_fields

    issues = []
    if not _ID.match(rule_id) or rule_id.split("-")[0] in registry.prefixes():
        issues.append(f"'{rule_id}' cannot name a custom rule")
    kind = assertion.get("kind")
    if kind not in ASSERTIONS:
        return [*issues, f"assert.kind: unknown assertion '{kind}'"], None
    fields, call = ASSERTIONS[kind]
    rest = {k: v for k, v in assertion.items() if k != "kind"}
    issues += check_fields(rest, fields, "assert")
    if issues:
        return issues, None
    scope = {k: v for k, v in (("files", files), ("exclude", exclude)) if v is not None}
    return [], Rule(rule_id, "CUSTOM", f"Custom rule: {kind}.", "error", "project" if kind == "columnUnique" else "document", {}, lambda c, o: call(c, rest | scope))


