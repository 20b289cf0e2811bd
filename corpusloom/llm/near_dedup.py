"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Signatures. SuperMinHash gives every element of a set a random permutation of the signature's slots and, at step j, the
rank j plus a random fraction for the j-th slot of its permutation; a slot keeps the least rank. Ranks of one element
are thereby negatively correlated, which lowers the variance of the estimate. Steps are taken for all elements of a
batch at once; a set stops as soon as all its slots are filled, because later ranks are larger, so long sets take one
to five steps.

Candidates. Documents with equal sets are one class (128-bit set hash, order-free). Classes sharing all slots of a band
meet in a bucket; every member is tied to the least of its buckets' least ids, and these to each other, which gives
clusters: the connected parts of the bucket graph. A pair with a similarity of at least 0.85 shares no band with probability below 10^-5.

Verification. Within a cluster every pair is compared on its full shingle sets, except pairs that are connected
already: a breadth-first search over the links visits each class once and compares it with those not reached so far. A
cluster of up to CHUNK classes is one task's group. A larger one is dealt by hash into chunks of CHUNK / 2 to 4 * CHUNK
and every pair of chunks is compared in a group of its own, so no task ever holds more than about 8 * CHUNK texts; a
chunk pair gives a spanning forest of its links, never all pairs. The links of all chunk pairs join the same components as all
links would. Nothing is capped.

Components come from min-label propagation with pointer jumping over tables in the shared folder.

A document without words, or with a null text, has an empty set and is linked with nothing. Rows with the same doc_id
are one document: linked if any of their texts is; each keeps a row; rows without doc_id are treated as different documents whose id is null and never represent others.
An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, Words, bounded_batches, mix, shuffle_parts, stable_hashes, sums, text_array

BANDS = 30
#: Classes of one cluster that one group may hold.
CHUNK = 256


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, offsets): the distinct word shingles of each text, ascending. A-Z are lower-cased."""
    words = Words(pc.ascii_lower(texts))
    n = len(words.offsets) - 1
    if not len(words.codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    each = stable_hashes(words.unique)[words.codes]
    counts = words.counts
    made = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), made)
    start = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made) + np.repeat(words.offsets[:-1], made)
    last = words.offsets[1:][owner]
    value = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):  # a text shorter than a shingle is one shingle
        at = start + k
        inside = at < last
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, each[np.minimum(at, len(each) - 1)], np.uint64(0)) + np.uint64(k + 1) * inside)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[first], owner[first]
    return value, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def superminhash(elements: np.ndarray, offsets: np.ndarray, slots: int) -> np.ndarray:
    """sets x slots matrix of least ranks: step in the top 12 bits, random fraction below (all ones for an empty set)."""
    n = len(offsets) - 1
    if slots > 1 << 12:
        raise ValueError("a rank has 12 bits for its step")
    out = np.full((n, slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    live, history = np.arange(len(elements)), []
    for step in range(slots):
        if not len(live):
            break
        random = mix(elements[live] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64))
        fraction = random >> np.uint64(12)
        # A second draw picks the partner of this step's swap among the slots from `step` on.
        partner = (step + ((mix(random ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)).astype(np.int16)
        slot = partner.astype(np.int64)
        for earlier in range(step - 1, -1, -1):  # undo the earlier swaps to see what stands there
            slot = np.where(slot == history[earlier], earlier, slot)
        rank = np.uint64(step) << np.uint64(52) | fraction
        cell = owner[live] * slots + slot
        order = np.argsort(cell, kind="stable")
        cell, rank = cell[order], rank[order]
        heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        flat = out.reshape(-1)
        flat[cell[heads]] = np.minimum(flat[cell[heads]], np.minimum.reduceat(rank, heads))
        # Ranks of the next step are larger than any so far: full sets are done.
        done = (out != np.iinfo(np.uint64).max).all(axis=1)
        keep = ~done[owner[live]]
        history = [h[keep] for h in [*history, partner]]
        live = live[keep]
    return out


def _set_hash(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    return tuple(mix(sums(mix(elements ^ np.uint64(seed)), offsets) + np.diff(offsets).astype(np.uint64)) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344))


def rows_per_band(percent: int, bands: int = BANDS, missed: float = 1e-5) -> int:
    """The most slots a band may have so that a pair at the threshold shares no band with a probability of at most `missed`."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= missed:
        rows += 1
    return rows


def sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (the set's hash) and bands (array<long>) of each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                ids, texts = batch.column(0).slice(k, 1024), text_array(batch.column(1).slice(k, 1024))
                elements, offsets = shingles(texts, size)
                signature = superminhash(elements, offsets, bands * rows).reshape(len(ids), bands, rows)
                key = np.zeros((len(ids), bands), dtype=np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, r])
                h1, h2 = _set_hash(elements, offsets)
                flat = pa.array(key.reshape(-1).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), listed], ["doc_id", "n_shingles", "h1", "h2", "bands"])
                pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, label for every end of links (a, b): the least id of its connected part."""
    salts = shuffle_parts(links.sparkSession)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    arcs = scratch.keep(both.distinct(), f"{name}-arcs")
    labels = scratch.keep(arcs.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = arcs.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        # A root takes the least label that any of its members learnt of, and passes it on when they jump: the join is by
        # the unique id, never by the label that a large part's rows share.
        hook = met.where("new < label").groupBy(F.col("label").alias("root")).agg(F.min("new").alias("hook"))
        moved = met.join(hook, met["id"] == hook["root"], "left").select("id", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        # Rows ask for their root's label once for each salt, so a root that many rows share is asked by `salts` rows at
        # most, and its answers go to as many keys.
        moved = moved.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        asked = moved.select("new", "salt").distinct()
        root = moved.select(F.col("id").alias("new"), F.col("new").alias("up"))
        jumped = moved.join(asked.join(root, "new"), ["new", "salt"], "left").select("id", F.col("label").alias("old"), F.least("new", F.coalesce("up", "new")).alias("label"))
        kept = scratch.keep(jumped, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = kept.select("id", "label")
        if kept.where("old <> label").isEmpty():
            return labels


def forest(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (sorted arrays): pairs with 100 * |A & B| >= percent * |A | B|.

    split: the first `split` sets are one chunk and the others another; only links between chunks matter then, as
    each chunk is compared with itself elsewhere - but links inside may be given too, they are links all the same.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(vocabulary), dtype=np.int32)
    open_ = np.ones(n, dtype=bool)
    out: list[tuple[int, int]] = []
    for seed in range(n):
        if not open_[seed]:
            continue
        open_[seed] = False
        work = [seed]
        while work:
            a = work.pop()
            rest = np.flatnonzero(open_ & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a])))
            if not len(rest):
                continue
            mine = codes[offsets[a] : offsets[a + 1]]
            mark[mine] = 1
            lengths = sizes[rest]
            ends = np.cumsum(lengths)
            at = np.repeat(offsets[rest] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
            common = np.add.reduceat(mark[codes[at]], ends - lengths)
            mark[mine] = 0
            linked = rest[100 * common >= percent * (sizes[a] + lengths - common)]
            open_[linked] = False
            out += [(a, int(b)) for b in linked]
            work += linked.tolist()
    return out


def _cluster_links(size: int, percent: int):
    """Arrow batches of one group (members with their texts) -> links (a, b)."""

    def run(group: pa.Table) -> pa.Table:
        elements, offsets = shingles(text_array(group.column("text")), size)
        ids = group.column("id").to_pylist()
        pairs = forest([elements[offsets[k] : offsets[k + 1]] for k in range(len(ids))], percent) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[i] for i, _ in pairs], pa.int64()), "b": pa.array([ids[j] for _, j in pairs], pa.int64())})

    return run


def verified_links(docs: DataFrame, clusters: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links (a, b) among the classes of each cluster; clusters: id, label."""
    # Only clusters that need chunks are listed, one row for CHUNK classes at most; being a table, its size is known
    # when the join is planned, so a small one is sent to the members and a hot label is never dealt to one task.
    large = clusters.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") > CHUNK)
    large = scratch.keep(large.select("label", F.ceil(F.col("members") / F.least(F.lit(4 * CHUNK), F.greatest(F.lit(CHUNK // 2), F.col("members") / 64))).cast("int").alias("parts")), "large")
    placed = clusters.join(large, "label", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # A member of chunk c goes to the pairs (c, d) and (d, c) of every other chunk; a lone chunk meets itself.
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda d: F.struct(F.least(d, F.col("chunk")).alias("low"), F.greatest(d, F.col("chunk")).alias("high")))
    met = placed.select("id", "label", "parts", F.explode(other).alias("pair")).where((F.col("parts") == 1) | (F.col("pair.low") != F.col("pair.high")))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # A class is named by its least doc_id; should that id have several rows, those of the same set are all alike.
    wanted = texts.join(clusters.select("id"), "id", "left_semi")
    return met.join(wanted, "id").select("label", "pair", "id", "text").groupBy("label", "pair").applyInArrow(_cluster_links(size, percent), "a long, b long")


def bucket_ties(classes: DataFrame) -> DataFrame:
    """(a, b), each once: what ties the classes (id, bands) that meet in buckets into clusters.

    A class is tied to the least of its buckets' hubs, and its other hubs are tied to that one. The members of a large
    group share their hubs, so they add one tie each, and the ties among hubs are few, where a tie to every hub would be up
    to BANDS for each member.
    """
    slots = classes.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = slots.groupBy("band", "key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = slots.join(buckets, ["band", "key"]).where("id <> hub").groupBy("id").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))
    least = F.col("hubs")[0]
    tie = F.transform("hubs", lambda h: F.struct(F.when(h == least, F.col("id")).otherwise(h).alias("a"), least.alias("b")))
    return met.select(F.explode(tie).alias("t")).select("t.a", "t.b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable, itself included) and kept for each row."""
    scratch = Scratch(docs.sparkSession, "near")
    known = scratch.keep(sketches(docs, size, BANDS, rows_per_band(percent)), "sketches")
    linked = known.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.keep(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    clusters = components(bucket_ties(classes), scratch, "clusters")
    links = scratch.keep(verified_links(docs, clusters, scratch, size, percent), "links")
    labels = components(links, scratch, "labels")
    named = classes.select("h1", "h2", "id").join(labels, "id", "left").select("h1", "h2", F.coalesce("label", "id").alias("label"))
    found = known.join(named, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, whole: that of the least doc_id. Rows without doc_id all stay.

    What counts is the text: where doc_ids repeat, different texts under one of them are documents of their own, and
    rows of one doc_id and text are one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        found = scratch.keep(near_duplicates(docs, size, percent).select("doc_id", "kept"), "found")
        # What is dropped grows with the corpus: the join is by key at every size, so its cost stays in proportion.
        return docs.join(found.where(~F.col("kept")).select("doc_id").hint("merge"), "doc_id", "left_anti").select(docs.columns)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), F.col("text").alias("text"))
    # Every different text of a doc_id gets a number, which the table fixes; the digest spreads a hot doc_id.
    named = packed.where("own is not null").withColumn("digest", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).dropDuplicates(["own", "digest"])
    rows = scratch.keep(named.select(F.monotonically_increasing_id().alias("doc_id"), "own", "text", "row"), "rows")
    found = scratch.keep(near_duplicates(rows, size, percent).select("doc_id", "component_id"), "found")
    first = found.join(rows.select("doc_id", "own"), "doc_id").groupBy("component_id").agg(F.min(F.struct("own", "doc_id")).alias("first"))
    kept = rows.join(first.select(F.col("first.doc_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi").select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))
