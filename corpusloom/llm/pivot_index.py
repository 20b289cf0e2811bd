"""Exact top-k by inner product with a pivot-distance index.

Components become integers, floor(256 * x). Every vector is keyed by its nearest pivot and its distance to it; rows are
range-partitioned and sorted by (pivot, distance, vec_id) and cut into annuli of at most ANNULUS vectors. An annulus
keeps the least and greatest distance and the greatest squared norm of its vectors. For a query q at distance r from
the annulus's pivot, the triangle inequality bounds the distance to any member from below by the gap g between r and
the annulus, hence the inner product from above by (|q|^2 + max|v|^2 - g^2) / 2.

Search. When an annulus is cut, the queries among its own members get a first threshold: their k-th best score in it.
Annuli that lie side by side at one pivot form a group of at most GROUP vectors (more, if there would be more than
HEADS groups, so that their heads - pivot, distances, norm - have a bounded size and are broadcast). A query goes only to
groups whose bound reaches its threshold, in blocks of about BLOCK queries that lie side by side in the index, so that a
block's queries ask for much the same groups. Which groups a block asks for is found first, and a group's vectors go to
those blocks only; each such pair meets in one task, where annuli are expanded outwards from the best bound, queries whose bound is below their threshold
leave, and thresholds rise as scores come in. A task hands on at most k rows for a query, none below its first
threshold; the best k of all are the result. The number of pivots grows with the square root of the number of vectors;
they are fitted on at most SAMPLE vectors (farthest-first), and which pivots there are affects speed, not results.

Scores are exact integers as long as they stay below 2^53 (for 1024 components, each below 2.9 million after scaling).

Vectors that are null or hold a null or non-finite component, and rows without vec_id, take no part; shorter vectors
count as filled up with zeros; rows with the query's vec_id are not its candidates; equal scores go to the smaller
vec_id; repeated rows with one vec_id count once each. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, bounded_batches, mix, shuffle_parts

#: Least and most pivots.
PIVOTS = (16, 512)
SAMPLE = 4096
ANNULUS = 512
GROUP, HEADS, BLOCK = 1 << 15, 1 << 17, 1 << 13
#: Queries of a block that are scored at a time.
QUERY_BLOCK = 1024


def _clean(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("double")).alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer components as float64, which holds their products and sums exactly up to 2^53."""
    lengths = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T, 0))


def farthest_first(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of the sample, each as far as possible from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(k, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


INDEX = "group long, pivot int, low double, high double, norm double, ids binary, x binary, asked binary, floors binary, q binary"


def _cut(dims: int, k: int, every: int, most: int):
    """Sorted rows (pivot, distance, vec_id, q) -> annulus rows with first thresholds of their queries; most: annuli in a group."""

    def annulus(rows: pa.Table) -> pa.RecordBatch:
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("q").combine_chunks(), dims)
        distance = rows.column("distance").to_numpy()
        asked = np.flatnonzero(ids % every == 0)
        floor = np.full(len(asked), -np.inf)
        scores = x[asked] @ x.T
        for n, i in enumerate(asked):
            other = np.flatnonzero(ids != ids[i])
            if len(other) >= k:
                floor[n] = np.partition(scores[n][other], len(other) - k)[len(other) - k]
        head = {"group": pa.array([number(pivot := rows.column("pivot")[0].as_py())]), "pivot": pa.array([pivot], pa.int32()), "low": [distance.min()], "high": [distance.max()], "norm": [(x * x).sum(axis=1).max()]}
        return pa.RecordBatch.from_pydict(head | {"ids": [ids.astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()], "asked": [ids[asked].astype("<i8").tobytes()], "floors": [floor.astype("<f8").tobytes()], "q": [x[asked].astype("<f8").tobytes()]})

    at_pivot, made = [-1, 0, -1], [0]

    def number(pivot: int) -> int:
        """Of the group that takes the next annulus."""
        if at_pivot[0] != pivot or at_pivot[1] == most:
            at_pivot[:] = [pivot, 0, TaskContext.get().partitionId() << 32 | made[0]]
            made[0] += 1
        at_pivot[1] += 1
        return at_pivot[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            pivots = held.column("pivot").to_numpy()
            at = 0
            while at < len(pivots):
                end = min(at + ANNULUS, int(np.searchsorted(pivots, pivots[at], side="right")))
                if end == len(pivots) and end - at < ANNULUS:
                    break  # more of this pivot may follow
                yield annulus(held.slice(at, end - at))
                at = end
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield annulus(held)

    return run


def _blocks(heads: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each group, in the order of heads: the first block of its own queries and how many blocks they are dealt to."""
    asked = heads.column("asked").to_numpy()
    return (np.cumsum(asked) - asked) // BLOCK, np.maximum(-(-asked // BLOCK), 1)


def _route(heads: pa.Table, pivots: np.ndarray, dims: int, pairs: bool = False):
    """Annulus rows -> (group, block, query_id, floor, q): their queries, for each group that their threshold does not exclude.

    heads: by group. pairs: only which blocks ask for which groups (group, block), each once for an annulus row.
    """
    pivot, low, high, norm = (heads.column(c).to_numpy() for c in ("pivot", "low", "high", "norm"))
    groups = heads.column("group").to_numpy()
    first, parts = _blocks(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, floors, data in zip(*(batch.column(c).to_pylist() for c in ("group", "asked", "floors", "q")), strict=True):
                asked, floor, q = np.frombuffer(ids, "<i8"), np.frombuffer(floors, "<f8"), np.frombuffer(data, "<f8").reshape(-1, dims)
                near, at = _distances(q, pivots), np.searchsorted(groups, own)
                blocks = first[at] + (mix(asked.view(np.uint64)) % np.uint64(parts[at])).astype(np.int64)
                seen: dict[int, np.ndarray] = {}
                for n in range(len(asked)):
                    r = near[n][pivot]
                    gap = np.maximum(np.maximum(low - r, r - high) - 1e-6, 0)
                    live = (q[n] @ q[n] + norm - gap * gap) / 2 + 1e-6 >= floor[n]
                    if pairs:
                        seen[blocks[n]] = seen[blocks[n]] | live if blocks[n] in seen else live
                        continue
                    to = groups[live]
                    yield pa.RecordBatch.from_arrays([pa.array(to), *(pa.array(np.full(len(to), v[n])) for v in (blocks, asked, floor)), pa.array([q[n].astype("<f8").tobytes()] * len(to), pa.binary())], ["group", "block", "query_id", "floor", "q"])
                for block, live in seen.items():
                    yield pa.RecordBatch.from_arrays([pa.array(groups[live]), pa.array(np.full(int(live.sum()), block))], ["group", "block"])

    return run


def _search(dims: int, k: int, pivots: np.ndarray):
    """A group's annuli and a block's queries for it -> (query_id, vec_id, score)."""

    def run(annuli: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])
        if not annuli.num_rows or not queries.num_rows:
            return none
        heads = [annuli.column(c).to_numpy().astype(float) for c in ("pivot", "low", "high", "norm")]
        ids = [np.frombuffer(b, "<i8") for b in annuli.column("ids").to_pylist()]
        x = [np.frombuffer(b, "<f8").reshape(-1, dims) for b in annuli.column("x").to_pylist()]
        asked, floors = queries.column("query_id").to_numpy(), queries.column("floor").to_numpy()
        q = np.frombuffer(b"".join(queries.column("q").to_pylist()), "<f8").reshape(-1, dims)
        parts = [_expand(asked[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK], floors[at : at + QUERY_BLOCK], heads, ids, x, k, pivots) for at in range(0, len(asked), QUERY_BLOCK)]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _expand(asked, q, floors, heads, ids, x, k, pivots):
    pivot, low, high, norm = heads
    limit = floors.copy()
    r = _distances(q, pivots)[:, pivot.astype(int)]
    gap = np.maximum(np.maximum(low[None] - r, r - high[None]) - 1e-6, 0)
    bound = ((q * q).sum(axis=1)[:, None] + norm[None] - gap * gap) / 2 + 1e-6
    got_score = [np.zeros(0) for _ in asked]
    got_id = [np.zeros(0, np.int64) for _ in asked]
    for a in np.argsort(-bound.max(axis=0), kind="stable"):
        live = np.flatnonzero(bound[:, a] >= limit)
        if not len(live):
            continue
        scores = q[live] @ x[a].T
        hit = (scores >= limit[live][:, None]) & (ids[a][None] != asked[live][:, None])
        for row in np.flatnonzero(hit.any(axis=1)):
            n = live[row]
            s = np.concatenate([got_score[n], scores[row][hit[row]]])
            i = np.concatenate([got_id[n], ids[a][hit[row]]])
            top = best(s, i, k)
            got_score[n], got_id[n] = s[top], i[top]
            if len(top) == k:
                limit[n] = max(limit[n], s[top[-1]])
    sizes = [len(s) for s in got_score]
    return np.repeat(asked, sizes), np.concatenate(got_id), np.concatenate(got_score).astype(np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pivots")
    clean = _clean(vectors)
    size = clean.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    dims = max(int(size["d"] or 1), 1)
    share = min(1.0, SAMPLE / max(size["n"], 1))
    sample = clean.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * SAMPLE).select("q").toArrow()
    least, most = PIVOTS
    pivots = farthest_first(_matrix(sample.column("q").combine_chunks(), dims), int(np.clip(np.sqrt(size["n"]) / 8, least, most)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = _distances(_matrix(batch.column(1), dims), pivots)
            near = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(distance[np.arange(len(near)), near]), batch.column(0), batch.column(1)], ["pivot", "distance", "vec_id", "q"])

    keyed = clean.mapInArrow(key, "pivot int, distance double, vec_id long, q array<double>")
    parts = max(1, min(shuffle_parts(spark), -(-size["n"] // (4 * ANNULUS))))
    ordered = keyed.repartitionByRange(parts, "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    together = max(GROUP, -(-size["n"] // HEADS)) // ANNULUS
    index = scratch.keep(ordered.mapInArrow(_cut(dims, k, every, together), INDEX), "index")
    heads = index.groupBy("group").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"), (F.sum(F.length("asked")) / 8).cast("long").alias("asked")).toArrow().sort_by("group")
    asking = index.select("group", "asked", "floors", "q").where(F.length("asked") > 0)
    queries = asking.mapInArrow(_route(heads, pivots, dims), "group long, block long, query_id long, floor double, q binary")
    wanted = asking.mapInArrow(_route(heads, pivots, dims, pairs=True), "group long, block long").distinct()
    annuli = index.select("group", "pivot", "low", "high", "norm", "ids", "x").join(wanted, "group")
    found = annuli.groupBy("group", "block").cogroup(queries.groupBy("group", "block")).applyInArrow(_search(dims, k, pivots), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
