"""Contraction of directed graphs, so that the rounds of a graph operator do not grow with the length of its paths.

A node with one predecessor takes its answer from it: level or depth are the predecessor's plus the arc's weight. All such
nodes form a forest, whose pointers double until they reach a node outside it, in the logarithm of the longest chain of
rounds. The arcs that leave the forest then start at its roots and parallel ones merge, which gives other nodes a single
predecessor: chains, trees, diamonds and ladders of diamonds disappear in a few turns. What is known already (sources, or
nodes found before) is one virtual predecessor, so each turn also does at least what a plain round would do.

Where most nodes have several predecessors, levels shrink the arcs by a part each turn and end in a long tail of small turns.
Once a bounded number of arcs remains, and not more than half of all, one task takes the levels of these in one pass.

Every round writes one table in the shared folder; a lost executor costs a re-read. The virtual nodes would be hot keys and
take no part in joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import Tables

#: Virtual nodes, which no path is called: where levels and depths count from, and what lies on a cycle or behind one.
ROOT, CYCLE = "\x00", "\x01"
_VIRTUAL = [ROOT, CYCLE]
#: How many arcs one task may take at the end of longest_levels().
TAIL = 1 << 17


def doubled(single: DataFrame, count: int, tables: Tables, name: str) -> DataFrame:
    """single: node, up, w, going (up is no virtual node), `count` rows, each node once, written. The same with up outside the forest.

    Those on a ring or behind one are going still; their ups are nodes of rings, and every node of a ring is one of them.
    """
    left = single
    for k in range(1, count.bit_length() + 2):
        above = left.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("w").alias("more"))
        moved = left.where("going").join(above, "up", "left").select("node", F.coalesce("next", "up").alias("up"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("next").isNotNull() & ~F.col("next").isin(_VIRTUAL)).alias("going"))
        left = tables.keep(left.where("not going").unionByName(moved), f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}")
        if left.where("going").isEmpty():
            break
    # Pointers of 2^rounds steps that have not left the forest never will.
    return left


def forest(single: DataFrame, count: int, tables: Tables, name: str) -> DataFrame:
    """node, root, w: the first node outside for each node of single, see doubled(); CYCLE for those on a ring or behind one."""
    left = doubled(single, count, tables, name)
    return left.select("node", F.when(F.col("going"), F.lit(CYCLE)).otherwise(F.col("up")).alias("root"), "w")


def _tail_levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, dst, w of one task -> node, root, w: the longest way from ROOT to each node that only known nodes lead to."""
    held = list(batches)
    if not held:
        return
    arcs = pa.Table.from_batches(held).combine_chunks()
    src, dst = (arcs.column(c).combine_chunks() for c in ("src", "dst"))
    w = arcs.column("w").to_numpy()
    names = pc.unique(dst)
    first = pc.equal(src, ROOT).to_numpy(zero_copy_only=False)
    b = pc.index_in(dst, names).to_numpy()
    # What is no node of these (CYCLE, or a name that nothing leads to) is never known, so it holds back what it leads to.
    a = pc.fill_null(pc.index_in(src, names), len(names)).to_numpy()
    level = np.zeros(len(names), np.int64)
    np.maximum.at(level, b[first], w[first])
    waits = np.bincount(b[~first], minlength=len(names))
    inner = ~first & (a < len(names))
    order = np.flatnonzero(inner)[np.argsort(a[inner], kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(a[inner], minlength=len(names)))]).tolist()
    to, more, level, waits = b[order].tolist(), w[order].tolist(), level.tolist(), waits.tolist()
    known = [k for k, n in enumerate(waits) if not n]
    for v in known:
        for k in range(ends[v], ends[v + 1]):
            u = to[k]
            level[u] = max(level[u], level[v] + more[k])
            waits[u] -= 1
            if not waits[u]:
                known.append(u)
    found = pa.array(known, pa.int64())
    yield pa.RecordBatch.from_arrays([names.take(found), pa.array([ROOT] * len(known), pa.string()), pa.array([level[v] for v in known], pa.int32())], ["node", "root", "w"])


def _contract(arcs: DataFrame, deepest: bool, tables: Tables) -> tuple[DataFrame | None, DataFrame]:
    """arcs: src, dst, w. Pointers (node, root, w) of contracted nodes, and the arcs that remain between others.

    deepest: the largest weight of parallel arcs counts and cycles exclude what lies behind them, and a short rest is
    decided by one task; otherwise the least weight, arcs that lead back say nothing, and nodes that nothing leads to are
    left out with what only they lead to.
    """
    weight = F.max if deepest else F.min
    real = lambda c: ~F.col(c).isin(_VIRTUAL)
    a, pointers, turn = tables.keep(arcs, "arcs0"), [], 0
    short = min(TAIL, a.count() // 2) if deepest else -1
    while True:
        turn += 1
        if deepest and turn > 1 and a.count() <= short:
            pointers.append(tables.keep(a.coalesce(1).mapInArrow(_tail_levels, "node string, root string, w int"), "tail"))
            break
        if not deepest:
            led = a.select(F.col("dst").alias("src")).distinct()
            a = tables.keep(a.where(~real("src")).unionByName(a.where(real("src")).join(led, "src", "left_semi").select("src", "dst", "w")), f"led{turn}")
        into = a.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("up"), weight("w").alias("w"), F.bool_or(F.col("src") == CYCLE).alias("behind"))
        taken = into.where("behind or n = 1").select("node", F.when(F.col("behind"), F.lit(CYCLE)).otherwise(F.col("up")).alias("up"), "w")
        single = tables.keep(taken.withColumn("going", real("up")), f"single{turn}")
        count, going = single.agg(F.count("*"), F.count_if("going")).first()
        if not count:
            break
        f = forest(single, count, tables, f"forest{turn}") if going else single.select("node", F.col("up").alias("root"), "w")
        rest = a.join(single.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "w")
        named = rest.where(real("src")).join(f.select(F.col("node").alias("src"), "root", F.col("w").alias("more")), "src", "left")
        moved = named.select(F.coalesce("root", "src").alias("src"), "dst", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
        if deepest:
            moved = moved.withColumn("src", F.when(F.col("src") == F.col("dst"), F.lit(CYCLE)).otherwise(F.col("src")))
        else:
            moved = moved.where((F.col("src") != F.col("dst")) & (F.col("src") != CYCLE))
        a = tables.keep(rest.where(~real("src")).unionByName(moved).groupBy("src", "dst").agg(weight("w").alias("w")), f"arcs{turn}")
        pointers.append(f)
        tables.drop(f"arcs{turn - 1}", f"led{turn}")
    if not pointers:
        return None, a
    # A root may be contracted in a later turn itself: the pointers of all turns are one forest.
    whole = tables.keep(reduce(DataFrame.unionByName, pointers).select("node", F.col("root").alias("up"), "w", real("root").alias("going")), "whole")
    count, going = whole.agg(F.count("*"), F.count_if("going")).first()
    return (forest(whole, count, tables, "whole") if going else whole.select("node", F.col("up").alias("root"), "w")), a


def longest_levels(paths: DataFrame, arcs: DataFrame) -> DataFrame:
    """path, level: the longest path from a node that nothing leads to; nodes on a cycle or behind one are left out.

    Every acyclic node goes: of those that remain, a first one in topological order has known predecessors only, which
    count as one. So what remains, and what leads to CYCLE, is excluded.
    """
    tables = Tables(arcs.sparkSession, "levels")
    sources = paths.select(F.col("path").alias("dst")).distinct().join(arcs.select("dst").distinct(), "dst", "left_anti")
    all_arcs = arcs.select("src", "dst", F.lit(1).alias("w")).unionByName(sources.select(F.lit(ROOT).alias("src"), "dst", F.lit(0).alias("w")))
    found, _ = _contract(all_arcs, True, tables)
    if found is None:
        return paths.select("path", F.lit(0).alias("level")).where("false")
    return found.where(F.col("root") == ROOT).select(F.col("node").alias("path"), F.col("w").cast("int").alias("level")).join(paths.select("path").distinct(), "path", "left_semi")


def shortest_depths(seen: DataFrame, arcs: DataFrame) -> DataFrame:
    """path, depth of all nodes that seen(path, depth) leads to and does not hold. What no contraction decides is relaxed."""
    tables = Tables(arcs.sparkSession, "depths")
    outside = tables.keep(arcs.join(seen.select(F.col("path").alias("dst")), "dst", "left_anti").select("src", "dst"), "outside")
    marked = outside.join(seen.select(F.col("path").alias("src"), "depth"), "src", "left")
    fresh = marked.select(F.when(F.col("depth").isNull(), F.col("src")).otherwise(F.lit(ROOT)).alias("src"), "dst", (F.coalesce("depth", F.lit(0)) + 1).alias("w"))
    found, rest = _contract(fresh.groupBy("src", "dst").agg(F.min("w").alias("w")), False, tables)
    known = tables.keep(rest.where(F.col("src") == ROOT).select(F.col("dst").alias("path"), F.col("w").alias("depth")), "known0")
    between = tables.keep(rest.where(~F.col("src").isin(_VIRTUAL)), "between")
    step = 0
    while not between.isEmpty():
        step += 1
        offered = between.join(known.select(F.col("path").alias("src"), "depth"), "src").select(F.col("dst").alias("path"), (F.col("w") + F.col("depth")).alias("depth"), F.lit(True).alias("new"))
        best = known.select("path", "depth", F.lit(False).alias("new")).unionByName(offered).groupBy("path").agg(F.min(F.struct("depth", "new")).alias("b"))
        kept = tables.keep(best.select("path", "b.depth", "b.new"), f"known{step}")
        tables.drop(f"known{step - 1}")
        known = kept.select("path", "depth")
        if kept.where("new").isEmpty():
            break
    if found is None:
        return known
    own = found.where(F.col("root") == ROOT).select(F.col("node").alias("path"), F.col("w").alias("depth"))
    by_root = found.where(~F.col("root").isin(_VIRTUAL)).join(known.select(F.col("path").alias("root"), "depth"), "root").select(F.col("node").alias("path"), (F.col("w") + F.col("depth")).alias("depth"))
    return known.unionByName(own).unionByName(by_root)


def spread(labels: DataFrame, arcs: DataFrame, tables: Tables, name: str) -> DataFrame:
    """path, label: the least label of a node and all that lead to it. labels: path, label, each node of arcs once.

    Besides one step along every arc, a label jumps along one pointer per node, which doubles: rings and chains take the
    logarithm of their length. It stops when one step along every arc changes nothing.
    """
    up = arcs.groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("up"))
    now = tables.keep(labels.join(up, "path", "left").select("path", "label", "up", F.lit(True).alias("new")), f"{name}-0")
    k = 0
    while True:
        k += 1
        state = now.select("path", "label", "up")
        one = arcs.join(state.select(F.col("path").alias("src"), F.col("label").alias("l")), "src").groupBy(F.col("dst").alias("path")).agg(F.min("l").alias("near"))
        far = state.select(F.col("path").alias("up"), F.col("label").alias("far"), F.col("up").alias("next"))
        met = state.join(one, "path", "left").join(far, "up", "left")
        now = tables.keep(met.select("path", F.least("label", "near", "far").alias("label"), F.col("next").alias("up"), (F.least("label", "near") != F.col("label")).alias("new")), f"{name}-{k}")
        tables.drop(f"{name}-{k - 1}")
        if now.where("new").isEmpty():
            return now.select("path", "label")


def cyclic_core(arcs: DataFrame) -> DataFrame:
    """path: all nodes on cycles of arcs(src, dst), and what had gone into them by then. What is left out is on no cycle.

    A node with one predecessor is on cycles with it only, so it goes into it, and so does a node with one successor; a
    node that lacks either goes. An arc that comes to lead from a node to itself closes a cycle, as does a ring of
    single arcs. Both directions together leave a fraction of the arcs each turn where levels would go one by one.
    """
    tables = Tables(arcs.sparkSession, "core")
    a, size = tables.keep(arcs.select("src", "dst"), "arcs0"), None
    turns: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    step = 0
    while True:
        count = a.count()
        # Two steps, one for each direction, that leave all arcs as they are: the rest is for others to decide.
        if not count or (step % 2 == 0 and count == size):
            found = tables.keep(a.select(F.explode(F.array("src", "dst")).alias("path")).distinct(), "found")
            break
        size = count if step % 2 == 0 else size
        step += 1
        near, far = ("src", "dst") if step % 2 else ("dst", "src")
        into = tables.keep(a.groupBy(F.col(far).alias("node")).agg(F.count("*").alias("n"), F.min(near).alias("up")), f"into{step}")
        ones = into.where("n = 1").select("node", "up", F.lit(0).alias("w"), F.lit(True).alias("going"))
        f = doubled(ones, ones.count(), tables, f"core{step}").select("node", "up", "going")
        # What hangs on a ring of single arcs is on no cycle, so its arcs go.
        root = tables.keep(into.where("n > 1").select("node", F.col("node").alias("up")).unionByName(f.where("not going").select("node", "up")), f"root{step}")
        stays = root.where("node = up").select(F.col("node").alias(far))
        moved = a.join(stays, far, "left_semi").join(root.select(F.col("node").alias(near), "up"), near).select(F.col("up").alias(near), far).distinct()
        kept = tables.keep(moved.select("src", "dst"), f"arcs{step}")
        turns.append((root.where("node <> up"), kept.where("src = dst").select(F.col("src").alias("path")), f.where("going").select(F.col("up").alias("path"))))
        a = kept.where("src <> dst")
    # What had gone into a node when it was found on a cycle may be on it as well, step by step back to the first.
    for k, (pointers, loops, rings) in enumerate(reversed(turns)):
        ends = tables.keep(found.union(loops).distinct(), f"ends{k}")
        inner = pointers.join(ends.select(F.col("path").alias("up")), "up", "left_semi").select(F.col("node").alias("path"))
        found = tables.keep(ends.union(inner).union(rings).distinct(), f"found{k}")
    return found
