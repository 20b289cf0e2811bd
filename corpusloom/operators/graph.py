"""The typed reference graph and its operators.

Edges: link, anchor, image, import, id-ref; multiplicity is kept, edges to oneself are not. Iterative operators join a
frontier with the distinct arcs, keep their state in tables under spark.checkpoint.dir (any executor may be lost) and
stop when nothing changes, whatever the size of the graph. A topological order goes by level (the longest path from a
source), inside a level by path.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.patterns import check
from corpusloom.functions.scalars import candidates, file_part, has_scheme, id_tokens, prose_tokens, relative_path
from corpusloom.operators.contract import cyclic_core, longest_levels, shortest_depths, spread
from corpusloom.sources.corpus import Corpus
from corpusloom.sources.tables import Tables

EDGE_TYPES = ("link", "anchor", "image", "import", "id-ref")
HUB_IN_DEGREE = 3
#: Levels that a traversal walks one by one.
PLAIN_LEVELS = 8


def defined_ids(corpus: Corpus, id_pattern: str, definitions: list[str] | None = None, column: str | None = None) -> DataFrame:
    """path, ord, id, line: ids in a table column (tokens) and in headings, in files that match `definitions`."""
    from corpusloom.functions.globs import in_scope

    pattern = check(id_pattern)
    heads = corpus.headings.select("path", "line", F.struct(F.lit(1).alias("k"), F.col("pos").alias("a"), F.lit(0).alias("b")).alias("ord"), F.explode(prose_tokens(F.col("text"))).alias("id"))
    out = heads
    if column is not None:
        own = corpus.cells.where(F.col("header") == column)
        out = own.select("path", "line", F.struct(F.lit(0).alias("k"), F.col("table_pos").alias("a"), F.col("row_pos").alias("b")).alias("ord"), F.explode(id_tokens(F.col("value"))).alias("id")).unionByName(heads)
    return out.where(F.col("id").rlike(pattern) & in_scope(F.col("path"), definitions))


def build_edges(corpus: Corpus, id_ref: dict | None = None, types: list[str] | None = None) -> DataFrame:
    """src, dst, type, line, text, raw_target. id_ref: id_pattern, definitions (globs), column; types: only these are looked for (None: all)."""
    none = F.lit(None).cast("string")
    wanted = set(EDGE_TYPES if types is None else types)
    asked = lambda df, kind, target, router, text, anchor: df.select("path", F.lit(kind).alias("type"), "pos", "line", text.alias("text"), "raw_target", anchor.alias("anchor"), candidates(F.col("path"), target, router).alias("candidates"))
    own = file_part(F.col("raw_target"))
    tried = [asked(corpus.imports.where(F.lit("import" in wanted)), "import", F.expr("substring(raw_target, 2)"), corpus.router, none, none)]
    if "image" in wanted:
        tried.append(asked(corpus.images.where(~has_scheme(F.col("raw_target"))), "image", own, None, none, none))
    if wanted & {"link", "anchor"}:
        tried.append(asked(corpus.links.where(F.col("kind") == "local-file"), "link", own, corpus.router, F.col("text"), F.nullif("anchor", F.lit(""))))
    # All kinds are resolved by one join; only a router gives several candidates, of which the first that exists counts.
    found = reduce(DataFrame.unionByName, tried).select("*", F.posexplode("candidates").alias("ord", "dst")).drop("candidates")
    found = found.join(corpus.paths.select(F.col("path").alias("dst")).distinct(), "dst")
    if corpus.router:
        best = F.min(F.struct("ord", "dst", "line", "text", "raw_target", "anchor")).alias("b")
        found = found.groupBy("path", "type", "pos").agg(best).select("path", "type", "b.*")
    if wanted & {"link", "anchor"}:
        slugs = corpus.headings.select(F.col("path").alias("dst"), F.col("slug").alias("anchor")).distinct().withColumn("known", F.lit(True))
        found = found.join(slugs, ["dst", "anchor"], "left").where("anchor is null or known")
    edges = found.select(F.col("path").alias("src"), "dst", F.when(F.col("anchor").isNotNull(), "anchor").otherwise(F.col("type")).alias("type"), "line", "text", "raw_target")
    if id_ref and "id-ref" in wanted:
        edges = edges.unionByName(id_edges(corpus, id_ref))
    edges = edges.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return edges if types is None else edges.where(F.col("type").isin(list(wanted)) if wanted else F.lit(False))


def id_edges(corpus: Corpus, id_ref: dict) -> DataFrame:
    """An edge for each mention in running text of an id that another document defines."""
    definers = defined_ids(corpus, id_ref["id_pattern"], id_ref.get("definitions"), id_ref.get("column")).select("id", F.col("path").alias("dst")).distinct()
    lines = corpus.documents.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "text"))
    said = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(prose_tokens(F.col("text"))).alias("id")).where(F.col("id").rlike(check(id_ref["id_pattern"])))
    return said.join(definers, "id").where("path <> dst").select(F.col("path").alias("src"), "dst", F.lit("id-ref").alias("type"), "line", F.lit(None).cast("string").alias("text"), F.col("id").alias("raw_target"))


def build_nodes(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, in_degree, out_degree; multiplicity counts. One pass over the edges, one join."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    degree = ends.groupBy("path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return paths.select("path").join(degree, "path", "left").select("path", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))


def arcs(edges: DataFrame, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst) of the wanted types (None: all, []: none)."""
    df = edges if types is None else edges.where(F.col("type").isin(list(types)) if types else F.lit(False))
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return df.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst").distinct()


def traverse(starts: DataFrame, edges: DataFrame, depth: int | None = None, types: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """path, depth, via: breadth-first from starts(path); via is the least predecessor at the least depth.

    The first PLAIN_LEVELS levels are a round each; what lies deeper is found by contraction, in rounds that do not grow
    with its depth. Both give the same.
    """
    tables = Tables(edges.sparkSession, "bfs")
    hop = tables.keep(arcs(edges, types, reverse), "arcs")
    frontier = tables.keep(starts.select("path").distinct().select("path", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), "level0")
    parts, level = [frontier], 0
    while depth is None or level < depth:
        level += 1
        done = reduce(DataFrame.unionByName, parts)
        if level > PLAIN_LEVELS:
            seen = tables.keep(done, "seen")
            deep = shortest_depths(seen.select("path", "depth"), hop)
            deep = tables.keep(deep if depth is None else deep.where(F.col("depth") <= depth), "deep")
            all_depths = seen.select("path", "depth").unionByName(deep)
            before = hop.join(all_depths.select(F.col("path").alias("src"), (F.col("depth") + 1).alias("depth")), "src").select(F.col("dst").alias("path"), "depth", "src")
            via = before.groupBy("path", "depth").agg(F.min("src").alias("via"))
            return seen.unionByName(deep.join(via, ["path", "depth"]))
        reached = frontier.select(F.col("path").alias("src")).join(hop, "src").groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("via"))
        frontier = tables.keep(reached.join(done.select("path"), "path", "left_anti").select("path", F.lit(level).alias("depth"), "via"), f"level{level}")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def components(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, component: the least path of its weakly connected part; lone nodes included."""
    tables = Tables(edges.sparkSession, "components")
    salts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hop = tables.keep(arcs(edges), "hop")
    both = tables.keep(hop.union(hop.select("dst", "src")).distinct(), "arcs")
    labels = tables.keep(paths.select("path", F.col("path").alias("component")).distinct(), "0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("path").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("path")).agg(F.min("component").alias("near"))
        met = labels.join(near, "path", "left").select("path", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        # All rows of a giant part have one label: they ask for its own label once for each salt, so that no task joins them all.
        met = met.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(salts)))
        asked = met.select("new", "salt").distinct()
        jump = asked.join(met.select(F.col("path").alias("new"), F.col("new").alias("up")), "new")
        moved = met.join(jump, ["new", "salt"]).select("path", "old", F.least("new", "up").alias("component"))
        kept = tables.keep(moved, str(step))
        tables.drop(str(step - 1))
        labels = kept.select("path", "component")
        if kept.where("old <> component").isEmpty():
            return labels


def peel(edges: DataFrame, paths: DataFrame, reverse: bool = False) -> DataFrame:
    """Nodes that lie on a cycle or behind one (before one, if reversed)."""
    tables = Tables(edges.sparkSession, "peel")
    placed = longest_levels(paths, tables.keep(arcs(edges, reverse=reverse), "arcs"))
    return paths.select("path").distinct().join(placed, "path", "left_anti")


def analyze(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, in_degree, out_degree, role, level, scc, cause: a graph in one frame.

    cause: placed (it has a level in the topological order), cycle (member of a strongly connected part, which `scc` names)
    or behind (only reached through a cycle). Levels are found once and serve the parts as well.
    """
    tables = Tables(edges.sparkSession, "analysis")
    levels = tables.keep(topological_levels(paths, edges), "levels")
    parts = tables.keep(strong_components(paths, edges, levels), "parts")
    cause = F.when(F.col("level").isNotNull(), "placed").when(F.col("scc").isNotNull(), "cycle").otherwise("behind")
    return roles(build_nodes(paths.distinct(), edges)).join(levels, "path", "left").join(parts, "path", "left").withColumn("cause", cause)


def exclusion_counts(analysis: DataFrame) -> DataFrame:
    """placed, in_cycle, behind: how many documents a reading order holds, and why it leaves out the others."""
    return analysis.agg(*[F.count_if(F.col("cause") == c).alias(n) for c, n in (("placed", "placed"), ("cycle", "in_cycle"), ("behind", "behind"))])


def strong_components(paths: DataFrame, edges: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """path, scc: members of strongly connected parts with more than one node, named by their least path.

    Colouring: after contraction (contract.cyclic_core) and peeling from both sides, every node takes the least label that
    reaches it; a label's node and all of its colour that reach it back are one part, which leaves the graph; repeat with
    the rest. Labels jump along pointers that double (contract.spread), forwards and back.
    """
    tables = Tables(edges.sparkSession, "scc")
    hop = tables.keep(arcs(edges), "hop")
    inside = lambda df, nodes: df.join(nodes.select(F.col("path").alias("src")), "src", "left_semi").join(nodes.select(F.col("path").alias("dst")), "dst", "left_semi").select("src", "dst")
    named = paths.select("path").distinct()
    linked = lambda df: df.withColumn("type", F.lit("link"))
    if levels is None:
        core = tables.keep(named.join(cyclic_core(hop), "path", "left_semi"), "core")
        behind = tables.keep(peel(linked(tables.keep(inside(hop, core), "inner")), core), "behind")
    else:
        # What a topological order places is on no cycle, and of the rest only the arcs among itself matter.
        behind = tables.keep(named.join(levels, "path", "left_anti"), "behind")
    among = tables.keep(inside(hop, behind), "among")
    nodes = tables.keep(peel(linked(among), behind, reverse=True), "nodes0")
    left = tables.keep(inside(among, nodes), "arcs0")
    found: list[DataFrame] = []
    step = 0
    while not left.isEmpty():
        step += 1
        colour = spread(nodes.select("path", F.col("path").alias("label")), left, tables, f"colour{step}").withColumnRenamed("label", "colour")
        same = left.join(colour.select(F.col("path").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("path").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        # Backwards inside a colour: 0 spreads from its root to all that reach it.
        own = colour.select("path", F.when(F.col("path") == F.col("colour"), 0).otherwise(1).alias("label"))
        back = spread(own, tables.keep(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), f"same{step}"), tables, f"back{step}")
        part = tables.keep(back.where("label = 0").select("path").join(colour, "path").select("path", F.col("colour").alias("scc")), f"part{step}")
        found.append(part)
        nodes = tables.keep(nodes.join(part.select("path"), "path", "left_anti"), f"nodes{step}")
        left = tables.keep(inside(left, nodes), f"arcs{step}")
    if not found:
        return paths.sparkSession.createDataFrame([], "path string, scc string")
    out = reduce(DataFrame.unionByName, found)
    big = out.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    return out.join(big, "scc", "left_semi").select("path", "scc")


def topological_levels(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, level of every node that no cycle excludes: arcs lead to higher levels, and sources have level 0.

    Rounds grow with the logarithm of chains, not with the number of levels (contract.longest_levels).
    """
    tables = Tables(edges.sparkSession, "levels")
    return longest_levels(paths, tables.keep(arcs(edges), "arcs"))


def topological_order(paths: DataFrame, edges: DataFrame) -> tuple[list[str], list[str]]:
    """topological_levels() as a list for display, and what cycles exclude."""
    placed = topological_levels(paths, edges)
    excluded = paths.select("path").distinct().join(placed, "path", "left_anti")
    return [r["path"] for r in placed.orderBy("level", "path").collect()], [r["path"] for r in excluded.orderBy("path").collect()]


def cycle_path(out: list[list[int]]) -> list[int]:
    """The first closed simple path through node 0 in the order of a depth-first walk that takes smaller neighbours first.

    out: ascending neighbours of each node; every node reaches 0 and is reached by it. A step is taken only if 0 can be
    reached from there without the nodes walked already, so nothing is taken back: a search that backtracks finds the same
    path, but may take exponential time. Which nodes still reach 0 is kept as a tree of next hops; a node walked over
    sends only those whose hops led through it to look for others.
    """
    back: list[list[int]] = [[] for _ in out]
    for a, following in enumerate(out):
        for b in following:
            back[b].append(a)
    hop: list[int | None] = [None] * len(out)
    hop[0] = 0

    def attach(queue: deque) -> None:
        while queue:
            v = queue.popleft()
            for u in back[v]:
                if hop[u] is None and not walked[u]:
                    hop[u] = v
                    queue.append(u)

    walked = [False] * len(out)
    walked[0] = True
    attach(deque([0]))
    path, at = [0], 0
    while True:
        following = next(b for b in out[at] if (b == 0 and at) or (not walked[b] and hop[b] is not None))
        if following == 0:
            return [*path, 0]
        path.append(following)
        walked[following] = True
        lost = [following]
        for v in lost:
            lost += [u for u in back[v] if hop[u] == v and u != v and not walked[u]]
        for v in lost:
            hop[v] = None
        again = deque()
        for v in lost[1:]:
            if hop[v] is None:
                w = next((w for w in out[v] if w == 0 or (hop[w] is not None and not walked[w])), None)
                if w is not None:
                    hop[v] = w
                    again.append(v)
        attach(again)
        at = following


def _part_walk(group: pa.Table) -> pa.Table:
    src, dst = (group.column(c).combine_chunks() for c in ("src", "dst"))
    names = pc.unique(src)
    names = names.take(pc.array_sort_indices(names))  # in a strongly connected part every node has an arc
    a, b = (np.asarray(pc.index_in(c, names)) for c in (src, dst))
    order = np.lexsort((b, a))
    ends = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))])
    b = b[order]
    walk = cycle_path([b[ends[k] : ends[k + 1]].tolist() for k in range(len(names))])
    return pa.table([group.column("scc").slice(0, 1), pa.array([names.take(pa.array(walk)).to_pylist()], pa.list_(pa.string()))], names=["scc", "walk"])


def cycle_walks(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """scc, walk: one closed path for each strongly connected part, the same at every size; see cycle_path().

    A path of a part is sequential, so one task walks a part and holds its arcs; parts share the tasks.
    """
    tables = Tables(edges.sparkSession, "cycles")
    parts = tables.keep(strong_components(paths, edges), "parts")
    inner = arcs(edges).join(parts.select(F.col("path").alias("src"), "scc"), "src").join(parts.select(F.col("path").alias("dst"), F.col("scc").alias("other")), "dst").where("scc = other")
    return tables.keep(inner.select("scc", "src", "dst").groupBy("scc").applyInArrow(_part_walk, "scc string, walk array<string>"), "walks")


def cycles(paths: DataFrame, edges: DataFrame) -> list[list[str]]:
    """The walks of cycle_walks(), by least member; only they reach the driver."""
    return [r["walk"] for r in cycle_walks(paths, edges).orderBy("scc").collect()]


def roles(nodes: DataFrame, hub_in_degree: int = HUB_IN_DEGREE) -> DataFrame:
    """nodes with role: isolated, hub, entry, leaf or bridge - the first that applies."""
    i, o = F.col("in_degree"), F.col("out_degree")
    return nodes.withColumn("role", F.when((i == 0) & (o == 0), "isolated").when(i >= hub_in_degree, "hub").when(i == 0, "entry").when(o == 0, "leaf").otherwise("bridge"))


def hubs(nodes: DataFrame, n: int = 5) -> DataFrame:
    return nodes.withColumn("degree", F.col("in_degree") + F.col("out_degree")).where("degree > 0").orderBy(F.desc("degree"), "path").limit(n)


def coverage(corpus: Corpus) -> DataFrame:
    """path: Markdown files on disk that the corpus points at but does not hold."""
    target = file_part(F.col("raw_target"))
    routed = corpus.links.where(F.col("kind") == "local-file").select(F.explode(candidates(F.col("path"), target, corpus.router)).alias("c"))
    pictures = corpus.images.where(~has_scheme(F.col("raw_target"))).select(F.explode(candidates(F.col("path"), target)).alias("c"))
    imported = corpus.imports.select(F.explode(candidates(F.col("path"), F.expr("substring(raw_target, 2)"), corpus.router)).alias("c"))
    asked = routed.union(pictures).union(imported).where(F.col("c").rlike("(?i)\\.mdx?$") & ~F.col("c").startswith("../")).select(F.col("c").alias("path")).distinct()
    return asked.join(corpus.on_disk, "path", "left_semi").join(corpus.paths, "path", "left_anti")


def direct_references(target: str, edges: DataFrame) -> DataFrame:
    """path, references: documents that refer to target, and how often."""
    return edges.where((F.col("dst") == target) & (F.col("src") != target)).groupBy(F.col("src").alias("path")).agg(F.count("*").alias("references"))


def impact(target: str, edges: DataFrame) -> dict[str, DataFrame]:
    """directly(path, references), transitively(path, depth, via) and affected(path) of a change to target."""
    spark: SparkSession = edges.sparkSession
    visits = traverse(spark.createDataFrame([(target,)], "path string"), edges, reverse=True)
    return {"directly": direct_references(target, edges), "transitively": visits.where("depth >= 2"), "affected": visits.select("path")}


def relativize(parts: dict[str, DataFrame], base: str) -> dict[str, DataFrame]:
    """impact() with paths (and `via`) relative to the folder `base`; paths outside it climb with '..'."""
    out = {}
    for name, df in parts.items():
        for c in {"path", "via"} & set(df.columns):
            df = df.withColumn(c, relative_path(F.col(c), base))
        out[name] = df
    return out


def reading_order(affected: DataFrame, edges: DataFrame) -> tuple[list[str], list[str]]:
    """Topological order of the induced subgraph."""
    inner = edges.join(affected.select(F.col("path").alias("src")), "src", "left_semi").join(affected.select(F.col("path").alias("dst")), "dst", "left_semi")
    return topological_order(affected, inner)


def search_index(corpus: Corpus, id_ref: dict | None = None) -> DataFrame:
    """kind (path, id, heading), key, path - distinct."""
    out = corpus.paths.select(F.lit("path").alias("kind"), F.col("path").alias("key"), "path")
    out = out.union(corpus.headings.select(F.lit("heading"), "slug", "path"))
    if id_ref:
        out = out.union(defined_ids(corpus, id_ref["id_pattern"], id_ref.get("definitions"), id_ref.get("column")).select(F.lit("id"), "id", "path"))
    return out.distinct()


def resolve_query(index: DataFrame, query: str) -> DataFrame:
    """kind, path: '#x' looks up headings only; otherwise the first of path, id, heading that has the key."""
    from corpusloom.functions.globs import normalize
    from corpusloom.sources.markdown import decode_anchor

    if query.startswith("#"):
        return index.where((F.col("kind") == "heading") & (F.col("key") == decode_anchor(query[1:]))).select(F.lit("anchor").alias("kind"), "path")
    rank = F.when(F.col("kind") == "path", 0).when(F.col("kind") == "id", 1).otherwise(2)
    hit = index.where(((F.col("kind") == "path") & (F.col("key") == normalize(query))) | ((F.col("kind") != "path") & (F.col("key") == query))).withColumn("rank", rank)
    return hit.join(hit.agg(F.min("rank").alias("rank")), "rank").select("kind", "path")


def context_slice(corpus: Corpus, edges: DataFrame, query: str, id_ref: dict | None = None, depth: int = 2, types: list[str] | None = None) -> tuple[str | None, DataFrame]:
    """Kind of match and the visits of a forward traversal from all files that match."""
    starts = resolve_query(search_index(corpus, id_ref), query)
    kind = starts.select("kind").first()
    return (kind["kind"] if kind else None), traverse(starts.select("path"), edges, depth, types)
