"""Registered queries of the engine's own operators with their SQL, over the driver's tables and the generated corpus.

For the generated corpus Spark parses Markdown while the SQL computes the same relations from doc_id alone.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import scalars as s
from corpusloom.operators import graph as g
from corpusloom.operators import primitives as p
from corpusloom.operators import rules as r
from corpusloom.operators.registry import registry
from corpusloom.plans import findings as plan
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.generated import dealt, generated_documents, path_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_parsed: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str, name: str = "generated", made: Callable[[], DataFrame] | None = None) -> Corpus:
    """The generated corpus, or the one of that name that `made` gives, scanned once for all relations and queries of a session (in memory, beyond that on disk)."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} {name}")
    if key not in _parsed:
        _parsed[key] = Corpus.of(made() if made else generated_documents(spark, sf_dir), persist=False)
    found = _parsed[key]
    if found.documents.storageLevel == StorageLevel.NONE:
        found.documents.persist()
    return found


#: Start of every SQL over the generated corpus: one row for each document, with everything that follows from its id.
D = """WITH n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT doc_id AS i, n, lang, source, 'z' || (doc_id % 5) || '/doc-' || doc_id || '.md' AS path,
  (doc_id + 1) % n AS nxt, (doc_id * 7 + 2) % n AS anc, doc_id // 2 AS imp, (doc_id * 3 + 1) % (n + 5) AS dep, CASE WHEN doc_id % 38 = 0 THEN 1 ELSE 0 END AS o
  FROM documents, n)"""
#: Edges of the generated corpus, with their multiplicity.
E = (
    D
    + """, p AS (SELECT i, path FROM d), e AS (
  SELECT d.path AS src, t.path AS dst, 'link' AS type, 3 + o AS line FROM d JOIN p t ON t.i = d.nxt WHERE d.i % 7 <> 3 AND d.i <> t.i
  UNION ALL SELECT d.path, t.path, 'anchor', 13 + o FROM d JOIN p t ON t.i = d.anc WHERE d.i % 13 <> 0 AND d.i <> t.i
  UNION ALL SELECT d.path, t.path, 'import', 17 + o FROM d JOIN p t ON t.i = d.imp WHERE d.i % 3 = 0 AND d.i <> t.i)"""
)


def shown(df: DataFrame, *data: str) -> DataFrame:
    """path, line and some of the data of findings."""
    return df.select("path", F.col("line").cast("long").alias("line"), *[F.col("data")[d].alias(d) for d in data])


# --- parsing ------------------------------------------------------------------------------------------------------


@query(D + """ SELECT path, h.text, CAST(h.depth AS BIGINT) AS depth, h.slug, CAST(h.line + o AS BIGINT) AS line FROM (
  SELECT path, o, unnest([{'text': 'Doc ' || i, 'depth': 1, 'slug': 'doc-' || i, 'line': 1}, {'text': 'Items', 'depth': 2, 'slug': 'items', 'line': 5}, {'text': 'Notes', 'depth': 2, 'slug': 'notes', 'line': 11},
    {'text': 'Later', 'depth': 2, 'slug': 'later', 'line': 24}, {'text': 'End', 'depth': 2, 'slug': 'end', 'line': 28}]) AS h FROM d)""")
def parse_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).headings.select("path", "text", F.col("depth").cast("long").alias("depth"), "slug", F.col("line").cast("long").alias("line"))


@query(D + """ SELECT path, kind, raw_target, coalesce(anchor, '') AS anchor, CAST(line + o AS BIGINT) AS line FROM (
  SELECT d.path, o, 'local-file' AS kind, '../z' || (nxt % 5) || '/doc-' || nxt || '.md' AS raw_target, NULL AS anchor, 3 AS line FROM d WHERE i % 7 <> 3
  UNION ALL SELECT path, o, 'local-file', '../z' || (anc % 5) || '/doc-' || anc || '.md#' || CASE WHEN i % 13 = 0 THEN 'nope' ELSE 'items' END, CASE WHEN i % 13 = 0 THEN 'nope' ELSE 'items' END, 13 FROM d
  UNION ALL SELECT path, o, 'local-file', 'missing-' || i || '.md', NULL, 15 FROM d WHERE i % 17 = 0)""")
def parse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).links.select("path", "kind", "raw_target", F.coalesce("anchor", F.lit("")).alias("anchor"), F.col("line").cast("long").alias("line"))


_CELLS = """ SELECT path, header, value, CAST(9 + o AS BIGINT) AS line, 'Items' AS section FROM (
  SELECT path, o, unnest(['ID', 'Owner', 'Status', 'Depends']) AS header, unnest(['REQ-' || i, CASE WHEN i % 7 = 0 THEN '' ELSE 'owner' || (i % 4) END,
    CASE WHEN i % 11 = 0 THEN 'bad' WHEN i % 2 = 0 THEN 'open' ELSE 'done' END, 'REQ-' || dep]) AS value FROM d)"""


@query(D + _CELLS)
def parse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).cells.select("path", "header", "value", F.col("line").cast("long").alias("line"), "section")


@query(D + """ SELECT path, '@../z' || (imp % 5) || '/doc-' || imp || '.md' AS raw_target, CAST(17 + o AS BIGINT) AS line, CAST(8 AS BIGINT) AS col FROM d WHERE i % 3 = 0""")
def parse_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).imports.select("path", "raw_target", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


@query(D + """ SELECT path, 'first' AS text, true AS checked, 'Notes' AS section, CAST(19 + o AS BIGINT) AS line FROM d
  UNION ALL SELECT path, 'second ' || i, i % 2 = 0, 'Notes', CAST(20 + o AS BIGINT) FROM d""")
def parse_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).check_items.select("path", "text", "checked", "section", F.col("line").cast("long").alias("line"))


@query(D + """ SELECT path, 'disable' AS kind, 'TBL-003' AS rules, CAST(22 + o AS BIGINT) AS line FROM d WHERE i % 19 = 0
  UNION ALL SELECT path, 'disable', 'TBL-002,TBL-003', 1 FROM d WHERE i % 38 = 0""")
def parse_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).directives.select("path", "kind", F.array_join("rule_ids", ",").alias("rules"), F.col("line").cast("long").alias("line"))


@query(D + """ SELECT path, 'pic-' || i || '.png' AS raw_target, CAST(26 + o AS BIGINT) AS line FROM d WHERE i % 23 = 0""")
def parse_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).images.select("path", "raw_target", F.col("line").cast("long").alias("line"))


# --- primitives ---------------------------------------------------------------------------------------------------


@query(D + " SELECT path, CAST(7 + o AS BIGINT) AS line, c AS \"column\" FROM d, (SELECT unnest(['Priority', 'Review']) AS c)")
def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.required_columns(corpus(spark, sf_dir).tables, ["ID", "Priority", "Owner", "Review"], "Items"), "column")


@query(D + " SELECT path, CAST(9 + o AS BIGINT) AS line, 'Owner' AS \"column\" FROM d WHERE i % 7 = 0")
def col_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.column_not_empty(corpus(spark, sf_dir).cells), "column")


def order_cells(spark: SparkSession, sf_dir: str, column: str, key: str = "o_orderkey", name: str = "orders") -> DataFrame:
    """A plain table's column as cells: relational mode."""
    t = table(spark, sf_dir, name)
    k = F.col(key).cast("string")
    return t.select(k.alias("path"), F.lit(0).alias("table_pos"), F.lit(0).alias("row_pos"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("section"), F.lit(column).alias("header"), F.col(column).cast("string").alias("value"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def col_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.column_in_set(order_cells(spark, sf_dir, "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]), "value").drop("line")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority AS value FROM orders WHERE lower(o_orderpriority) NOT IN ('1-urgent', '2-high')")
def col_in_set_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.column_in_set(order_cells(spark, sf_dir, "o_orderpriority"), "o_orderpriority", ["1-Urgent", "2-HIGH"], ignore_case=True), "value").drop("line")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand AS value FROM part WHERE NOT regexp_matches(p_brand, '#[1-3][0-9]$')")
def col_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.column_matches(order_cells(spark, sf_dir, "p_brand", "p_partkey", "part"), "p_brand", "#[1-3][0-9]$"), "value").drop("line")


@query("""SELECT path, first_path FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) OVER (PARTITION BY regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS first_path, text FROM documents)
  WHERE path > first_path""")
def col_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = order_cells(spark, sf_dir, "text", "doc_id", "documents").withColumn("path", F.lpad("path", 12, "0"))
    return shown(p.column_unique(cells, "text"), "first_path").select("path", "first_path")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus = 'O' AND NOT regexp_matches(o_orderpriority, '^[12]-')")
def cross_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_orderstatus", "o_orderpriority"]
    cells = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit(1).alias("line"), F.lit(None).cast("string").alias("section"), F.array(*map(F.lit, cols)).alias("headers"), cells.alias("cells"))
    return p.cross_column(rows, {"column": cols[0], "equals": "O"}, {"column": cols[1], "matches": "^[12]-"}).select("path")


@query(D + " SELECT path, CAST(0 AS BIGINT) AS line, 'Appendix' AS section FROM d")
def section_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return shown(p.section_present(c.paths, c.headings, ["Items", "Appendix", "End"]), "section")


@query(D + " SELECT path, CAST(5 + o AS BIGINT) AS line, 'Items' AS section FROM d UNION ALL SELECT path, CAST(11 + o AS BIGINT), 'Notes' FROM d")
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.section_order(corpus(spark, sf_dir).headings, ["Later", "Items", "Notes", "End"], 2), "section")


@query("""SELECT path, CAST(line AS BIGINT) AS line, match FROM (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(regexp_extract_all(t, '[a-z0-9._]+@[a-z0-9.]+')) AS match, line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents))""")
def content_not_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return shown(p.content_not_match(docs, "[a-z0-9._]+@[a-z0-9.]+"), "match")


@query(D + " SELECT path, CAST(28 + o AS BIGINT) AS line, 'End' AS section FROM d WHERE i % 29 = 0")
def no_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.no_placeholders(corpus(spark, sf_dir).section_bodies), "section")


@query(D + " SELECT path, CAST(20 + o AS BIGINT) AS line, 'second ' || i AS text FROM d WHERE i % 2 = 1")
def all_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(p.all_checked(corpus(spark, sf_dir).check_items), "text")


@query(D + " SELECT path, CAST(15 + o AS BIGINT) AS line, 'missing-' || i || '.md' AS target FROM d WHERE i % 17 = 0")
def link_resolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return shown(p.link_resolves(c.links, c.on_disk), "target")


@query(D + " SELECT path, CAST(26 + o AS BIGINT) AS line, 'pic-' || i || '.png' AS target FROM d WHERE i % 23 = 0")
def image_resolves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return shown(p.image_resolves(c.images, c.on_disk), "target")


# --- rules --------------------------------------------------------------------------------------------------------


@query(D + " SELECT path, CAST(13 + o AS BIGINT) AS line, 'nope' AS anchor FROM d WHERE i % 13 = 0")
def anchor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.anchors_match(corpus(spark, sf_dir), {}), "anchor")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, metric, severity, actual FROM (
  SELECT doc_id, unnest(['bytes', 'lines', 'tokens']) AS metric, unnest([strlen(text), length(text) - length(replace(text, chr(10), '')), CAST(ceil(length(text) / 4.0) AS BIGINT)]) AS actual,
    unnest([2000, 12, 900]) AS warn, unnest([8000, 60, 2500]) AS err FROM documents), LATERAL (SELECT CASE WHEN actual > err THEN 'error' WHEN actual > warn THEN 'warning' END AS severity)
  WHERE severity IS NOT NULL""")
def size_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    out = r.size_findings(docs, {"bytes": {"warn": 2000, "error": 8000}, "lines": {"warn": 12, "error": 60}, "tokens": {"warn": 900, "error": 2500}})
    return out.select("path", F.col("data.metric").alias("metric"), "severity", F.col("data.actual").cast("long").alias("actual"))


@query(D + """, l AS (SELECT path, 'z' || (i % 5) AS f, 'z' || (nxt % 5) AS t, 3 + o AS line FROM d WHERE i % 7 <> 3 UNION ALL SELECT path, 'z' || (i % 5), 'z' || (anc % 5), 13 + o FROM d)
  SELECT 'lib/' || path AS path, CAST(line AS BIGINT) AS line, f AS "fromZone", t AS "toZone" FROM l WHERE f <> t""")
def cross_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = generated_documents(spark, sf_dir).withColumn("path", F.concat(F.lit("lib/"), "path"))
    return shown(r.zones_declared(corpus(spark, sf_dir, "lib", lambda: raw), {"zonesDir": "lib"}), "fromZone", "toZone")


@query("""WITH d AS (SELECT 'O-' || o_orderkey AS id FROM orders UNION ALL SELECT 'C-' || c_custkey FROM customer), u AS (SELECT 'O-' || l_orderkey AS id FROM lineitem UNION ALL SELECT 'C-' || l_partkey FROM lineitem)
  SELECT id, 'error' AS severity, count(*) AS n FROM u WHERE id NOT IN (SELECT id FROM d) GROUP BY ALL UNION ALL SELECT id, 'warning', 1 FROM d WHERE id NOT IN (SELECT id FROM u)""")
def id_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling and orphan ids: orders and customers against the keys that line items name (their part keys as if they were customers)."""
    ids = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string")).alias("id")
    own = lambda t, mark, c: table(spark, sf_dir, t).select(F.lit(t).alias("path"), F.lit(0).alias("ord"), F.lit(1).alias("line"), ids(mark, c))
    named = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("path"), F.col("l_linenumber").alias("line"), F.explode(F.array(ids("O-", "l_orderkey"), ids("C-", "l_partkey"))).alias("id"))
    return r.trace(own("orders", "O-", "o_orderkey").union(own("customer", "C-", "c_custkey")), named).groupBy(F.col("data.id").alias("id"), "severity").agg(F.count("*").alias("n"))


@query(D + " SELECT path, CAST(9 + o AS BIGINT) AS line, 'REQ-' || dep AS id, 'error' AS severity FROM d WHERE dep >= n UNION ALL SELECT path, CAST(9 + o AS BIGINT), 'REQ-' || i, 'warning' FROM d WHERE i NOT IN (SELECT dep FROM d)")
def id_trace_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.ids_traced(corpus(spark, sf_dir), {"idPattern": r"^REQ-\d+$", "definitions": ["**/*.md"], "references": ["**/*.md"], "idColumn": "ID", "referenceColumn": "Depends"})
    return out.select("path", F.col("line").cast("long").alias("line"), F.col("data.id").alias("id"), "severity")


@query("""WITH d AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 END AS r, o_orderstatus AS s FROM orders), u AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linestatus AS s, CASE l_linestatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 END AS r FROM lineitem)
  SELECT CAST(u.k AS VARCHAR) AS id, CAST(u.n AS BIGINT) AS line, u.s AS level, d.s AS reference_level FROM u JOIN d USING (k) WHERE d.r < u.r""")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that depend on orders less stable than themselves."""
    rows = lambda t, k, s, n: table(spark, sf_dir, t).select(F.lit(t).alias("path"), F.lit(0).alias("table_pos"), n.alias("row_pos"), n.alias("line"), F.col(k).cast("string").alias("id"), F.col(s).alias("level"))
    found = r.less_stable(rows("orders", "o_orderkey", "o_orderstatus", F.lit(1)), rows("lineitem", "l_orderkey", "l_linestatus", F.col("l_linenumber")), ["P", "O", "F"])
    return found.select(F.col("data.id").alias("id"), F.col("line").cast("long").alias("line"), F.col("data.level").alias("level"), F.col("data.reference_level").alias("reference_level"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, alias, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS alias FROM documents) WHERE alias IN ('ing', 'the', 'ung') GROUP BY ALL""")
def alias_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit(0).alias("base"))
    return r.alias_findings(docs, {"ing": "Ing", "the": "The", "ung": "Ung"}).groupBy("path", F.col("data.alias").alias("alias")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, alias, 'long ' || alias AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) AS alias FROM documents) WHERE regexp_matches(alias, '^[a-z]{2}$') GROUP BY ALL""")
def alias_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of two small letters is an alias: a glossary that is looked up by words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit(0).alias("base"))
    names = [a + b for a in ascii_lowercase for b in ascii_lowercase]
    return r.alias_findings(docs, {a: f"long {a}" for a in names}).groupBy("path", F.col("data.alias").alias("alias"), F.col("data.term").alias("term")).agg(F.count("*").alias("n"))


@query(D + """, t AS (SELECT path, o, i, 'the app store of the app ' || CASE WHEN i % 2 = 0 THEN 'and app store' ELSE '' END AS text FROM d) SELECT path, 'app' AS alias, CAST(CASE WHEN i % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n FROM t UNION ALL SELECT path, 'app store', CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END FROM t""")
def alias_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases one of which lies inside the other: each is found by itself."""
    i = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    docs = i.select(path_of(F.col("i")).alias("path"), F.concat(F.lit("the app store of the app "), F.when(F.col("i") % 2 == 0, "and\napp store").otherwise("")).alias("content"), F.lit(0).alias("base"))
    return r.alias_findings(docs, {"app": "program", "app store": "shop"}).groupBy("path", F.col("data.alias").alias("alias")).agg(F.count("*").alias("n"))


@query("""SELECT 'lineitem' AS stage, CAST(l_suppkey AS VARCHAR) AS id, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT c_nationkey FROM customer) GROUP BY ALL""")
def chain_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the next stage lacks, at every place where they stand."""
    ids = lambda t, c, n: table(spark, sf_dir, t).select(F.lit(t).alias("path"), n.alias("line"), F.col(c).cast("string").alias("id"))
    lost = r.uncovered(ids("lineitem", "l_suppkey", F.col("l_linenumber")), ids("customer", "c_nationkey", F.lit(1)))
    return lost.groupBy(F.col("path").alias("stage"), F.col("data.id").alias("id"), F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"))


@query("""SELECT 'orders' AS stage, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def chain_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("path"), F.lit(1).alias("line"), F.col(c).cast("string").alias("id"))
    one = r.uncovered(ids("orders", "o_orderkey"), ids("lineitem", "l_orderkey"))
    two = r.uncovered(ids("customer", "c_custkey"), ids("events", "user_id"))
    return one.unionByName(two).select(F.col("path").alias("stage"), F.col("data.id").alias("id"))


@query(E + " SELECT path, CAST(0 AS BIGINT) AS line FROM p WHERE path NOT IN (SELECT dst FROM e) AND i <> 0")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.no_orphans(corpus(spark, sf_dir), {"entrypoints": ["doc-0.md"]}))


@query(D + " SELECT path, CAST(0 AS BIGINT) AS line, section FROM d, (SELECT unnest(['Doc 0', 'Extra']) AS section) WHERE i <> 0 AND section <> 'Extra'")
def template_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(r.sections_of_template(corpus(spark, sf_dir), {"template": "z0/doc-0.md"}), "section")


@query("SELECT 'absent.md' AS file UNION ALL SELECT 'zz/*.md'")
def required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.required_files(corpus(spark, sf_dir), {"files": ["z0/doc-0.md", "absent.md", "z1/*.md", "zz/*.md"]}).select(F.col("data.file").alias("file"))


# --- findings pipeline --------------------------------------------------------------------------------------------


def bound(*rules: tuple[str, dict]) -> list:
    return [(registry.get(i), o, None) for i, o in rules]


STANDARD = (
    ("TBL-002", {}), ("TBL-003", {"column": "Status", "values": ["open", "done"]}), ("REF-001", {}), ("REF-002", {}), ("REF-003", {}), ("CTX-001", {}), ("CTX-002", {}), ("SEC-001", {"sections": ["Items", "End"]}),
)

_FOUND = """, f AS (
  SELECT path, i, 'TBL-002' AS rule_id, 'warning' AS severity, 9 + o AS line FROM d WHERE i % 7 = 0 AND i % 38 <> 0
  UNION ALL SELECT path, i, 'TBL-003', 'error', 9 + o FROM d WHERE i % 11 = 0 AND i % 38 <> 0
  UNION ALL SELECT path, i, 'REF-001', 'error', 15 + o FROM d WHERE i % 17 = 0
  UNION ALL SELECT path, i, 'REF-002', 'error', 13 + o FROM d WHERE i % 13 = 0
  UNION ALL SELECT path, i, 'REF-003', 'error', 26 + o FROM d WHERE i % 23 = 0
  UNION ALL SELECT path, i, 'CTX-001', 'warning', 28 + o FROM d WHERE i % 29 = 0
  UNION ALL SELECT path, i, 'CTX-002', 'warning', 20 + o FROM d WHERE i % 2 = 1)"""


@query(D + _FOUND + " SELECT path, rule_id, severity, CAST(line AS BIGINT) AS line FROM f")
def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rules over the generated corpus, with suppression."""
    c = corpus(spark, sf_dir)
    return plan.ordered(plan.lint(c, bound(*STANDARD))).select("path", "rule_id", "severity", F.col("line").cast("long").alias("line"))


@query(D + _FOUND + " SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.counts(plan.lint(corpus(spark, sf_dir), bound(*STANDARD)))


@query("""WITH f AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, 'TBL-' || lpad(CAST(l_linenumber % 3 AS VARCHAR), 3, '0') AS rule_id, l_partkey % 40 AS line, l_linenumber FROM lineitem),
  dir AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_suppkey % 40 AS line, l_linenumber AS pos, CASE l_linenumber % 3 WHEN 0 THEN 'disable' WHEN 1 THEN 'enable' ELSE 'disable-next-line' END AS kind,
    CASE WHEN l_quantity > 25 THEN 'TBL-' || lpad(CAST(l_linenumber % 2 AS VARCHAR), 3, '0') END AS rule FROM lineitem)
  SELECT f.path, f.rule_id, CAST(f.line AS BIGINT) AS line, CAST(f.l_linenumber AS BIGINT) AS n FROM f WHERE NOT (f.line > 0 AND (
    EXISTS (SELECT 1 FROM dir WHERE dir.path = f.path AND kind = 'disable-next-line' AND dir.line + 1 = f.line AND (rule IS NULL OR rule = f.rule_id))
    OR coalesce((SELECT arg_max(kind, dir.line * 100 + pos) FROM dir WHERE dir.path = f.path AND kind <> 'disable-next-line' AND dir.line <= f.line AND (rule IS NULL OR rule = f.rule_id)), 'enable') = 'disable'))""")
def suppressed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppression on its own: findings and directives made from line items."""
    t = table(spark, sf_dir, "lineitem")
    path, n = F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber")
    rule = lambda k: F.concat(F.lit("TBL-"), F.lpad((n % k).cast("string"), 3, "0"))
    found = t.select(path, rule(3).alias("rule_id"), (F.col("l_partkey") % 40).cast("int").alias("line"), n.cast("long").alias("n"))
    kind = F.when(n % 3 == 0, "disable").when(n % 3 == 1, "enable").otherwise("disable-next-line")
    ids = F.when(F.col("l_quantity") > 25, F.array(rule(2))).otherwise(F.array().cast("array<string>"))
    directives = t.select(path, n.alias("pos"), kind.alias("kind"), ids.alias("rule_ids"), (F.col("l_suppkey") % 40).cast("int").alias("line"))
    return plan.suppress(found, directives).select("path", "rule_id", F.col("line").cast("long").alias("line"), "n")


# --- graph --------------------------------------------------------------------------------------------------------


@query(E + " SELECT src, dst, type, CAST(line AS BIGINT) AS line FROM e")
def edges_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.build_edges(corpus(spark, sf_dir)).select("src", "dst", "type", F.col("line").cast("long").alias("line"))


@query(E + """ SELECT p.path, coalesce(a.k, 0) AS in_degree, coalesce(b.k, 0) AS out_degree FROM p LEFT JOIN (SELECT dst, count(*) AS k FROM e GROUP BY 1) a ON a.dst = p.path LEFT JOIN (SELECT src, count(*) AS k FROM e GROUP BY 1) b ON b.src = p.path""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return g.build_nodes(c.paths, g.build_edges(c))


@query(E + """, x AS (SELECT p.path, (SELECT count(*) FROM e WHERE dst = p.path) AS i, (SELECT count(*) FROM e WHERE src = p.path) AS u FROM p)
  SELECT path, CASE WHEN i = 0 AND u = 0 THEN 'isolated' WHEN i >= 3 THEN 'hub' WHEN i = 0 THEN 'entry' WHEN u = 0 THEN 'leaf' ELSE 'bridge' END AS role FROM x""")
def node_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.roles(degrees(spark, sf_dir)).select("path", "role")


@query(E + """, x AS (SELECT path, (SELECT count(*) FROM e WHERE dst = p.path) + (SELECT count(*) FROM e WHERE src = p.path) AS degree FROM p) SELECT path, degree FROM x ORDER BY degree DESC, path LIMIT 5""")
def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.hubs(degrees(spark, sf_dir)).select("path", "degree")


@query(D + """, ids AS (SELECT i, path FROM d), said AS (SELECT path, i AS id, 9 + o AS line FROM d UNION ALL SELECT path, dep, 9 + o FROM d)
  SELECT said.path AS src, ids.path AS dst, 'REQ-' || id AS raw_target, CAST(line AS BIGINT) AS line FROM said JOIN ids ON ids.i = said.id WHERE said.path <> ids.path""")
def id_ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.id_edges(corpus(spark, sf_dir), {"id_pattern": r"^REQ-\d+$", "column": "ID"}).select("src", "dst", "raw_target", F.col("line").cast("long").alias("line"))


_REACH = """, a AS (SELECT DISTINCT src, dst FROM e){arcs}, w AS (SELECT {start} AS path, 0 AS depth)"""


def _bfs_sql(start: str, depth: int | None, types: str | None = None, reverse: bool = False) -> str:
    """Breadth-first levels by a recursive query: minimal depth, then the least predecessor one level up."""
    s_, d_ = ("dst", "src") if reverse else ("src", "dst")
    only = f" WHERE type = '{types}'" if types else ""
    limit = "" if depth is None else f" AND w.depth < {depth}"
    head = E.replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f""", a AS (SELECT DISTINCT {s_} AS s, {d_} AS t FROM e{only}), w(path, depth) AS ({start} UNION SELECT a.t, w.depth + 1 FROM w JOIN a ON a.s = w.path WHERE w.depth < (SELECT least(count(*), 60) FROM p){limit}),
  m AS (SELECT path, min(depth) AS depth FROM w GROUP BY 1) SELECT m.path, CAST(m.depth AS BIGINT) AS depth, coalesce((SELECT min(b.path) FROM m b JOIN a ON a.s = b.path WHERE a.t = m.path AND b.depth = m.depth - 1), '') AS via FROM m"""


def visits(df: DataFrame) -> DataFrame:
    return df.select("path", F.col("depth").cast("long").alias("depth"), F.coalesce("via", F.lit("")).alias("via"))


@query(_bfs_sql("SELECT 'z0/doc-0.md', 0", 2))
def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("z0/doc-0.md",)], "path string")
    return visits(g.traverse(start, g.build_edges(corpus(spark, sf_dir)), 2))


@query(_bfs_sql("SELECT 'z3/doc-3.md', 0", None, "import", True))
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that imports a document, directly or not."""
    start = spark.createDataFrame([("z3/doc-3.md",)], "path string")
    return visits(g.traverse(start, g.build_edges(corpus(spark, sf_dir), types=["import"]), reverse=True))


@query(_bfs_sql("SELECT path, 0 FROM p WHERE i IN (1, 2, 50)", 3, "link"))
def slice_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = spark.createDataFrame([("z1/doc-1.md",), ("z2/doc-2.md",), ("z0/doc-50.md",)], "path string")
    return visits(g.traverse(start, g.build_edges(corpus(spark, sf_dir)), 3, ["link"]))


@query(E.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT src AS s, dst AS t FROM e WHERE type = 'import' UNION SELECT dst, src FROM e WHERE type = 'import'), w(path, r) AS (SELECT path, path FROM p UNION SELECT a.t, w.r FROM w JOIN a ON a.s = w.path)
  SELECT path, min(r) AS component FROM w GROUP BY 1""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return g.components(c.paths, g.build_edges(c, types=["import"]))


def lineage_arcs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph with known cycles on documents 0 .. n-1: i -> (5 * i + 3) % n and i -> i // 2."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    n = docs.count()
    name = lambda x: F.lpad(x.cast("string"), 9, "0")
    edges = docs.where("i % 4 = 1").select(name(F.col("i")).alias("src"), name((F.col("i") * 5 + 3) % n).alias("dst")).union(docs.select(name(F.col("i")), name(F.floor(F.col("i") / 2))))
    return docs.select(name(F.col("i")).alias("path")), edges.where("src <> dst").withColumn("type", F.lit("link"))


_ARCS = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), a AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS s, lpad(CAST((doc_id * 5 + 3) % n AS VARCHAR), 9, '0') AS t FROM documents, n WHERE doc_id % 4 = 1 AND doc_id <> (doc_id * 5 + 3) % n
  UNION SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0'), lpad(CAST(doc_id // 2 AS VARCHAR), 9, '0') FROM documents WHERE doc_id <> doc_id // 2), w(s, t) AS (SELECT s, t FROM a UNION SELECT w.s, a.t FROM w JOIN a ON a.s = w.t)"""


@query(_ARCS + " SELECT x.s AS path, min(least(x.s, x.t)) AS scc FROM w x JOIN w y ON y.s = x.t AND y.t = x.s WHERE x.s <> x.t GROUP BY 1")
def scc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.strong_components(*lineage_arcs(spark, sf_dir))


@query(_ARCS + ", c AS (SELECT s AS path FROM w WHERE s = t) SELECT path FROM c UNION SELECT t FROM w WHERE s IN (SELECT path FROM c)")
def topo_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a topological order leaves out: nodes on a cycle or behind one."""
    paths, edges = lineage_arcs(spark, sf_dir)
    return g.peel(edges, paths)


@query(E.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT DISTINCT src AS s, dst AS t FROM e WHERE type = 'import'), w(r, path) AS (SELECT path, path FROM p WHERE i % 5 = 0 UNION SELECT w.r, a.t FROM w JOIN a ON a.s = w.path)
  SELECT r AS path, count(*) - 1 AS imported FROM w GROUP BY 1""")
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files each entry point imports, each once."""
    c = corpus(spark, sf_dir)
    return r.closure_tokens(c, g.build_edges(c, types=["import"]), ["z0/*.md"]).select("path", "imported")


@query("""SELECT CAST(page_id AS VARCHAR) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw_target FROM pages""")
def html_href_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("raw_target"))


# --- aggregation --------------------------------------------------------------------------------------------------


@query("SELECT source, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS documents FROM documents GROUP BY 1")
def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(s.estimate_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("documents"))


@query("""SELECT dir, count(*) AS n FROM (SELECT unnest([array_to_string(x[1:k], '/') for k in range(1, len(x))]) AS dir FROM (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS x FROM pages)) GROUP BY 1""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below each folder: every path counts for all its ancestors."""
    from corpusloom.operators.infer import ancestors

    return table(spark, sf_dir, "pages").select(F.explode(ancestors(F.regexp_replace("url", "^[a-z]+://", ""))).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


@query("SELECT source, pattern, count(*) AS n FROM (SELECT source, unnest(['numbers', 'mails', 'shouting']) AS pattern, unnest([regexp_matches(text, '[0-9]{3}'), regexp_matches(text, '@'), regexp_matches(text, '[A-Z]{5}')]) AS hit FROM documents) WHERE hit GROUP BY ALL")
def pattern_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators.infer import tally

    return tally(table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("text").alias("content")), {"numbers": "[0-9]{3}", "mails": "@", "shouting": "[A-Z]{5}"}).select(F.col("cluster").alias("source"), "pattern", "n")


@query(D + ", h AS (SELECT path, 'z' || (i % 5) AS cluster, unnest(['Items', 'Notes', 'Later', 'End', 'Doc ' || i]) AS text FROM d) SELECT cluster, text FROM (SELECT cluster, text, count(DISTINCT path) AS k FROM h GROUP BY 1, 2) JOIN (SELECT cluster, count(DISTINCT path) AS a FROM h GROUP BY 1) USING (cluster) WHERE k = a")
def common_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that all documents of a folder share."""
    from corpusloom.operators.infer import shared_headings

    return shared_headings(corpus(spark, sf_dir).headings.withColumn("cluster", s.dirname(F.col("path")))).select("cluster", "text")


@query(D + ", t AS (SELECT path, i, dep, repeat('N', length(CAST(i AS VARCHAR))) AS a, repeat('N', length(CAST(dep AS VARCHAR))) AS b FROM d) SELECT path, CASE WHEN a = b THEN 'REQ-' || a ELSE '' END AS family FROM t")
def id_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one family of ids that a document's tables use, or none if they differ."""
    from corpusloom.operators.profile import id_families

    c = corpus(spark, sf_dir)
    return c.paths.join(id_families(c.cells), "path", "left").select("path", F.coalesce("family", F.lit("")).alias("family"))


@query("""SELECT e.event_id, coalesce((SELECT arg_max(x.event_id, x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.event_id < e.event_id), -1) AS prior FROM events e""")
def nearest_preceding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join backwards: each event with its user's last purchase before it."""
    before = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    prior = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(prior, F.lit(-1)).alias("prior"))


@query(E.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT DISTINCT src AS s, dst AS t FROM e WHERE type = 'import'), w(path, level) AS (SELECT path, 0 FROM p UNION SELECT a.t, w.level + 1 FROM w JOIN a ON a.s = w.path)
  SELECT path, CAST(max(level) AS BIGINT) AS level FROM w GROUP BY 1""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological order of the import graph, as levels."""
    c = corpus(spark, sf_dir)
    return g.topological_levels(c.paths, g.build_edges(c, types=["import"])).select("path", F.col("level").cast("long").alias("level"))


def deep_arcs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chains of 400 documents with short cuts; in each whole chain an arc leads from its 391st document back to its 381st."""
    i, docs = F.col("i"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    name = lambda x: F.lpad(x.cast("string"), 9, "0")
    ahead = docs.select(i, F.explode(F.array(F.lit(1), F.when(i % 3 == 0, 2), F.when(i % 400 == 390, -10))).alias("by")).where("by is not null")
    arcs = ahead.select(i.alias("a"), (i + F.col("by")).alias("b")).where("a div 400 = b div 400").join(docs.select(i.alias("b")), "b", "left_semi")
    return docs.select(name(i).alias("path")), arcs.select(name(F.col("a")).alias("src"), name(F.col("b")).alias("dst"), F.lit("link").alias("type"))


@query("""SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, doc_id % 400 AS level FROM documents
  WHERE doc_id % 400 < 380 OR (SELECT count(*) FROM documents x WHERE x.doc_id = documents.doc_id // 400 * 400 + 390) = 0""")
def deep_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of a graph hundreds of arcs deep."""
    return g.topological_levels(*deep_arcs(spark, sf_dir)).select("path", F.col("level").cast("long").alias("level"))


#: The least closed simple path through each strongly connected part's least member.
_WALKS = (
    _ARCS
    + """, m AS (SELECT x.s AS path, min(least(x.s, x.t)) AS scc FROM w x JOIN w y ON y.s = x.t AND y.t = x.s WHERE x.s <> x.t GROUP BY 1),
  inner_arcs AS (SELECT a.s, a.t, f.scc FROM a JOIN m f ON f.path = a.s JOIN m o ON o.path = a.t AND o.scc = f.scc),
  walks(scc, walk) AS (SELECT DISTINCT scc, [scc] FROM m UNION ALL SELECT k.scc, list_append(k.walk, i.t) FROM walks k JOIN inner_arcs i ON i.scc = k.scc AND i.s = k.walk[-1] WHERE (len(k.walk) = 1 OR k.walk[-1] <> k.scc) AND (i.t = k.scc OR NOT list_contains(k.walk, i.t))),
  least_walks AS (SELECT scc, min(walk) AS walk FROM walks WHERE len(walk) > 1 AND walk[-1] = scc GROUP BY 1)"""
)


@query(_WALKS + " SELECT cycle, CAST(unnest(range(len(walk))) AS BIGINT) AS pos, unnest(walk) AS path FROM (SELECT row_number() OVER (ORDER BY scc) - 1 AS cycle, walk FROM least_walks)")
def cycle_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representative cycle of each strongly connected part."""
    paths, edges = lineage_arcs(spark, sf_dir)
    numbered = g.cycle_walks(paths, edges).orderBy("scc").rdd.zipWithIndex().map(lambda x: (x[1], x[0]["walk"]))
    walks = spark.createDataFrame(numbered, "cycle long, walk array<string>")
    return walks.select("cycle", F.posexplode("walk").alias("pos", "path")).select("cycle", F.col("pos").cast("long").alias("pos"), "path")


@query(_WALKS + """ SELECT walk[1] || '.md' AS path, (SELECT count(*) FROM a WHERE s = walk[1] AND t <= walk[2]) AS line, array_to_string([x || '.md' FOR x IN walk], ' -> ') AS cycle FROM least_walks WHERE len(walk) > 3""")
def reference_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRP-001 over documents that link to each other, a link on each line."""
    paths, edges = lineage_arcs(spark, sf_dir)
    links = edges.distinct().groupBy(F.col("src").alias("path")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("[next]("), "dst", F.lit(".md)")))), "\n").alias("content"))
    raw = paths.join(links, "path", "left").select(F.concat("path", F.lit(".md")).alias("path"), F.coalesce("content", F.lit("End.")).alias("content"))
    return shown(r.no_cycles(corpus(spark, sf_dir, "lineage", lambda: raw), {}), "cycle")


@query("""WITH d AS (SELECT doc_id // 6 AS k, count(*) AS n FROM documents GROUP BY 1), c AS (SELECT 'm' || (6 * k + 2) || '.md' AS c, 'm' || (6 * k + 3) || '.md' AS d, 'm' || (6 * k + 4) || '.md' AS e FROM d WHERE n > 4)
  SELECT e AS path, CAST(1 AS BIGINT) AS line, c || ' -> ' || d || ' -> ' || e || ' -> ' || c AS cycle FROM c UNION ALL SELECT c, 1, d || ' -> ' || e || ' -> ' || c || ' -> ' || d FROM c UNION ALL SELECT c, 3, e || ' -> ' || c || ' -> ' || e FROM c""")
def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM-001 over blocks of six documents: two entry points that enter one strongly connected part at different documents."""
    i = F.col("i")
    at = lambda k: F.concat(F.lit("@m"), (i - i % 6 + k).cast("string"), F.lit(".md"))
    text = F.when(i % 6 == 1, at(3)).when(i % 6 == 2, F.concat(at(3), F.lit("\n\n"), at(4))).when(i % 6 == 3, at(4)).when(i % 6 == 5, "None.").otherwise(at(2))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    docs = dealt(docs, docs.count())
    raw = docs.select(F.concat(F.when(i % 6 < 2, "e").otherwise("m"), i.cast("string"), F.lit(".md")).alias("path"), text.alias("content"))
    found = r.import_budget(corpus(spark, sf_dir, "blocks", lambda: raw), {"entrypoints": ["e*.md"], "maxTokensPerEntrypoint": 10**9})
    return shown(found.where("data.cycle is not null"), "cycle")


#: Paths of pages: hosts are folders, those named m. or blog. lie in hidden ones, and Spanish pages in a noise folder.
_FILES = """WITH f AS (SELECT DISTINCT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', ''), '^(m|blog)\\.', '.\\1/'), '/es(/|$)', '/dist\\1') || '.md' AS path FROM pages),
  x AS (SELECT path, string_split(path, '/') AS s FROM f), k AS (SELECT *, [i FOR i IN range(1, len(s)) IF s[i] = 'dist' OR s[i][1] = '.'] AS why FROM x),
  kept AS (SELECT path, [array_to_string(s[1:i], '/') FOR i IN range(1, len(s))] AS dirs FROM k WHERE len(why) = 0)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    for pattern, new in (("[?#].*$", ""), ("/+$", ""), (r"^(m|blog)\.", ".$1/"), ("/es(/|$)", "/dist$1")):
        path = F.regexp_replace(path, pattern, new)
    return table(spark, sf_dir, "pages").select(F.concat(path, F.lit(".md")).alias("path")).distinct()


@query(_FILES + """ SELECT array_to_string(s[1:why[1]], '/') AS path, CASE WHEN s[why[1]] = 'dist' THEN 'noise' ELSE 'hidden' END AS reason,
  CAST(CASE WHEN s[why[1]] = 'dist' THEN -1 ELSE count(*) FILTER (NOT list_contains(s[1:len(s) - 1], 'dist')) END AS BIGINT) AS documents FROM k WHERE len(why) > 0 GROUP BY 1, 2, s[why[1]]""")
def scan_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that a scan does not enter, and how many documents hidden ones hold."""
    from corpusloom.operators.infer import scan_repository

    return scan_repository(page_files(spark, sf_dir)).pruned.select("path", "reason", F.coalesce("documents", F.lit(-1)).alias("documents"))


@query(_FILES + """, c AS (SELECT dir, count(*) AS n FROM (SELECT unnest(dirs) AS dir FROM kept) GROUP BY 1), q AS (SELECT * FROM c WHERE n >= 3)
  SELECT dir AS path, 'cluster' AS kind, n AS score, n AS documents, dir || '/**/*.{md,mdx}' AS include, (SELECT string_agg(path, ' ' ORDER BY path) FROM (SELECT path FROM kept WHERE starts_with(path, q.dir || '/') ORDER BY path LIMIT 5)) AS samples
  FROM q WHERE NOT EXISTS (SELECT 1 FROM q u WHERE starts_with(q.dir, u.dir || '/'))
  UNION ALL SELECT '', 'root', count(*), count(*), './*.{md,mdx}', (SELECT string_agg(path, ' ' ORDER BY path) FROM (SELECT path FROM kept WHERE len(dirs) = 0 ORDER BY path LIMIT 5)) FROM kept WHERE len(dirs) = 0 HAVING count(*) > 0""")
def scan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of documents that a scan proposes."""
    from corpusloom.operators.infer import scan_repository

    return scan_repository(page_files(spark, sf_dir)).clusters.select("path", "kind", F.col("score").cast("long").alias("score"), "documents", "include", F.array_join("samples", " ").alias("samples"))


@query(D + """, c AS (SELECT 'z' || (i % 5) AS cluster, i, unnest(['localLinks', 'anchorLinks', 'images', 'tables', 'checklistItems']) AS pattern, unnest([CASE WHEN i % 7 <> 3 THEN 1 ELSE 0 END + 1 + CASE WHEN i % 17 = 0 THEN 1 ELSE 0 END, 1, CASE WHEN i % 23 = 0 THEN 1 ELSE 0 END, 1, 2]) AS n FROM d
    UNION ALL SELECT 'z' || (i % 5), i, 'placeholderSections', 1 FROM d WHERE i % 29 = 0)
  SELECT pattern, coalesce(cluster, '*') AS cluster, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS documents FROM c GROUP BY GROUPING SETS ((pattern, cluster), (pattern))""")
def pattern_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents hold, by folder and in all."""
    from corpusloom.operators.infer import pattern_counts, tally_totals

    counts = pattern_counts(corpus(spark, sf_dir)).withColumn("cluster", s.dirname(F.col("path")))
    return tally_totals(counts).select("pattern", F.coalesce("cluster", F.lit("*")).alias("cluster"), "n", "documents")


@query("""WITH h AS (SELECT doc_id AS i, doc_id % 10 AS c, unnest(['Context', 'Status', 'Decision', 'Consequences', 'Other']) AS text, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS pos FROM documents),
  k AS (SELECT * FROM h WHERE NOT (text = 'Context' AND c = 4) AND NOT (text = 'Status' AND i % 20 = 5) AND NOT (text = 'Decision' AND (i % 20 = 6 OR c = 4)) AND NOT (text = 'Consequences' AND c > 3) AND text <> 'Other'),
  z AS (SELECT c, count(*) AS n FROM (SELECT DISTINCT i, c FROM h) GROUP BY 1), bad AS (SELECT DISTINCT c FROM (SELECT i, c, count(*) AS core FROM k WHERE text <> 'Consequences' GROUP BY 1, 2) WHERE core < 2)
  SELECT 'c' || k.c AS cluster, text, min(pos) AS pos FROM k JOIN z USING (c) WHERE k.c NOT IN (SELECT c FROM bad) GROUP BY k.c, text, z.n HAVING count(*) = z.n""")
def shared_decision_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that all decision records of a cluster share, where each has two of the core ones."""
    from corpusloom.operators.infer import decision_sections

    i, c = F.col("i"), F.col("i") % 10
    names = ["Context", "Status", "Decision", "Consequences", "Other"]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i")).withColumn("cluster", F.concat(F.lit("c"), c.cast("string"))).withColumn("path", F.lpad(i.cast("string"), 9, "0"))
    heads = docs.select("i", "cluster", "path", F.posexplode(F.array(*map(F.lit, names))).alias("pos", "text"))
    lost = ((F.col("text") == "Context") & (c == 4)) | ((F.col("text") == "Status") & (i % 20 == 5)) | ((F.col("text") == "Decision") & ((i % 20 == 6) | (c == 4))) | ((F.col("text") == "Consequences") & (c > 3))
    return decision_sections(heads.where(~lost).select("cluster", "path", "pos", "text"), docs.select("cluster", "path"))


@query(D + """, l AS (SELECT path, i % 5 AS f, nxt % 5 AS t, 3 + o AS line FROM d WHERE i % 7 <> 3 UNION ALL SELECT path, i % 5, anc % 5, 13 + o FROM d)
  SELECT 'lib/' || path AS path, CAST(line AS BIGINT) AS line, 'z' || f AS "fromZone", 'z' || t AS "toZone" FROM l WHERE f <> t AND NOT (f % 2 = 0 AND t = (f + 1) % 5)""")
def declared_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF-004 where every other zone declares the next one; the others only name something like it."""
    raw = generated_documents(spark, sf_dir)
    k = F.regexp_extract("path", "^z(\\d)", 1).cast("int")
    after = F.concat(F.lit("z"), ((k + 1) % 5).cast("string"))
    said = F.when(k % 2 == 0, F.concat(F.lit("Needs "), after, F.lit(", and no other."))).otherwise(F.concat(after, F.lit("x or x-"), after))
    raw = raw.select(F.concat(F.lit("lib/"), "path").alias("path"), F.concat("content", F.lit("\n\n## Dependencies\n\n"), said).alias("content"))
    return shown(r.zones_declared(corpus(spark, sf_dir, "declaring", lambda: raw), {"zonesDir": "lib"}), "fromZone", "toZone")


@query(_ARCS + """, p AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path FROM documents), c AS (SELECT s AS path FROM w WHERE s = t), b AS (SELECT DISTINCT t AS path FROM w WHERE s IN (SELECT path FROM c)),
  lv(path, level) AS (SELECT path, 0 FROM p WHERE path NOT IN (SELECT path FROM c) AND path NOT IN (SELECT path FROM b) UNION SELECT a.t, lv.level + 1 FROM lv JOIN a ON a.s = lv.path WHERE a.t NOT IN (SELECT path FROM c) AND a.t NOT IN (SELECT path FROM b))
  SELECT p.path, CASE WHEN p.path IN (SELECT path FROM c) THEN 'cycle' WHEN p.path IN (SELECT path FROM b) THEN 'behind' ELSE 'placed' END AS cause, coalesce((SELECT max(level) FROM lv WHERE lv.path = p.path), -1) AS level FROM p""")
def graph_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a reading order leaves documents out, with the levels of the others."""
    return g.analyze(*lineage_arcs(spark, sf_dir)).select("path", "cause", F.coalesce("level", F.lit(-1)).alias("level"))


# --- lookups, profiles, fixes ----------------------------------------------------------------------------------------


@query(D + """ SELECT DISTINCT kind, key, path FROM (SELECT path, unnest(['path', 'heading', 'heading', 'heading', 'heading', 'heading', 'id']) AS kind, unnest([path, 'doc-' || i, 'items', 'notes', 'later', 'end', 'REQ-' || i]) AS key FROM d)""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a lookup can name: paths, headings and ids."""
    return g.search_index(corpus(spark, sf_dir), {"id_pattern": r"^REQ-\d+$", "column": "ID"}).select("kind", "key", "path")


@query(D + " SELECT 'z' || (i % 5) || '/missing-' || i || '.md' AS path FROM d WHERE i % 17 = 0")
def outside_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on disk that links point at, but that the corpus does not hold."""
    c = corpus(spark, sf_dir)
    lying = table(spark, sf_dir, "documents").select(F.concat(s.dirname(path_of(F.col("doc_id"))), F.lit("/missing-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return g.coverage(Corpus(c.documents, lying))


@query(D + " SELECT path, CAST(9 + o AS BIGINT) AS line FROM d WHERE i % 11 = 0")
def custom_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom rule made of an assertion."""
    _, rule = r.custom_rule("DOC-001", {"kind": "columnMatches", "column": "Status", "pattern": "^(open|done)$"})
    return shown(rule.check(corpus(spark, sf_dir), {}))


@query(E + " SELECT CASE WHEN starts_with(src, 'z3/') THEN substr(src, 4) ELSE '../' || src END AS path, count(*) AS n_references FROM e WHERE dst = 'z3/doc-33.md' GROUP BY 1")
def impact_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that refer to a changed one, as seen from its folder."""
    direct = g.direct_references("z3/doc-33.md", g.build_edges(corpus(spark, sf_dir)))
    return g.relativize({"directly": direct}, "z3")["directly"].withColumnRenamed("references", "n_references")


@query(E + """, x AS (SELECT p.path, p.i, (SELECT count(*) FROM e WHERE dst = p.path) AS a, (SELECT count(*) FROM e WHERE src = p.path) AS u FROM p),
  t AS (SELECT i, repeat('N', length(CAST(i AS VARCHAR))) AS a, repeat('N', length(CAST(dep AS VARCHAR))) AS b FROM d)
  SELECT x.path, CASE WHEN x.a = 0 AND u = 0 THEN 'isolated' WHEN x.a >= 3 THEN 'hub' WHEN x.a = 0 THEN 'entry' WHEN u = 0 THEN 'leaf' ELSE 'bridge' END AS role, 'doc-' || i || ' items notes later end' AS outline, 'ID|Owner|Status|Depends' AS schemas, CASE WHEN t.a = t.b THEN 'REQ-' || t.a ELSE '' END AS id_pattern,
    coalesce((SELECT string_agg(y, ' ' ORDER BY y) FROM (SELECT DISTINCT dst || ':' || type AS y FROM e WHERE src = x.path)), '') AS refers, coalesce((SELECT string_agg(y, ' ' ORDER BY y) FROM (SELECT DISTINCT src || ':' || type AS y FROM e WHERE dst = x.path)), '') AS referred FROM x JOIN t USING (i)""")
def document_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compiled artifact tells of each document."""
    from corpusloom.operators.profile import profiles

    c = corpus(spark, sf_dir)
    told = lambda x: F.array_join(F.array_sort(F.transform(F.coalesce(x, F.array()), lambda y: F.concat(y["path"], F.lit(":"), y["type"]))), " ")
    rows = profiles(c, g.build_edges(c))
    outline, schemas = F.array_join(F.transform("outline", lambda x: x["slug"]), " "), F.array_join(F.transform("table_schemas", lambda x: F.array_join(x["headers"], "|")), " ")
    return rows.select("path", "role", outline.alias("outline"), schemas.alias("schemas"), F.coalesce("id_pattern", F.lit("")).alias("id_pattern"), told(F.col("references_to")).alias("refers"), told(F.col("referenced_by")).alias("referred"))


@query(D + """ SELECT path, '| REQ-' || i || ' | ' || CASE WHEN i % 7 = 0 THEN 'TODO' ELSE 'owner' || (i % 4) END || ' | ' || CASE WHEN i % 11 = 0 THEN 'bad' WHEN i % 2 = 0 THEN 'open' ELSE 'done' END || ' | REQ-' || dep || ' |' AS fixed_row, chr(10) || chr(10) || '## Appendix' || chr(10) AS tail FROM d""")
def fixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of two fixable rules, folded once per document."""
    from corpusloom.plans import fix

    c = corpus(spark, sf_dir)
    made = fix.fold_edits(c.documents, fix.rule_edits(c, bound(("TBL-002", {}), ("SEC-001", {"sections": ["Items", "Appendix"]}))))
    return made.select("path", F.filter(F.split("content", "\n"), lambda x: x.startswith("| REQ-"))[0].alias("fixed_row"), F.right("content", F.lit(14)).alias("tail"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
