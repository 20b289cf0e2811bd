"""Cross-entropy difference: documents scored by matched target and background n-gram models.

Both models have the same order (2), the same smoothing and one vocabulary, that of the corpus; its size V is counted in
full if asked for (exact; op5 does), else estimated from the distinct words whose hash lies in one of SLICES equal slices,
times SLICES. They are exact
counts of every word and every (previous word, word) pair of the corpus, keyed by 64-bit hashes: among n distinct keys
about n^2 / 2^65 collide (0.03 expected among 10^9). The tables grow with the corpus and lie in the shared folder and in
shuffles; no process holds one. The background is counted over all documents, the target over those with a positive
label; background counts are scaled to the target's number of words, so that smoothing weighs equally on both (matched).

Each task cuts its rows into blocks of about BLOCK_WORDS words and asks once for each distinct key of a block, with the
block's own counts, so a hot key costs one entry for each block. Requests are summed by key range - the number of
ranges grows with the requests - and the totals go back to the blocks that asked, where documents are scored.

P(w | v) = (c(v, w) + m * P(w)) / (c(v) + m) and P(w) = (c(w) + m / V) / (N + m), with m = SMOOTHING. A document's loss
under a model is the mean of -ln P over its words, the first word following a start mark. No document is scored by a
model that has seen it: its own counts are taken out of the background and, if it is a target, out of the target
(leave one out). score is loss under the background less loss under the target: the higher, the more a document is like
the target.

A text without words (or null) has 0 words and null losses and score. Repeated rows count as often as they occur; labels
repeated for a doc_id count once; without any target row the target losses are those of an empty model. An empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SLICE_ROWS, Scratch, Words, bounded_batches, mix, stable_hashes, sums, text_array

#: Slices of the hashes' range, of which one is counted to estimate the vocabulary's size.
SLICES = 64
SMOOTHING = 4.0
#: A block ends with the slice of rows that brings it to so many words.
BLOCK_WORDS = 1 << 21
#: Words of the corpus for each range; what is asked for in a range is less.
RANGE_WORDS = 1 << 22
_START = np.uint64(0x452821E638D01377)
_BLOCK = "block long, ids array<long>, lengths binary, targets binary, words binary, codes binary, slice array<long>, n_words long, n_texts long, target_words long, target_texts long"


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, most alike bytes side by side."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + (pa.Codec("zstd").compress(planes, asbytes=True) if planes else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size, wide = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, -1).T).reshape(-1).view(kind)


def _pairs(lengths: np.ndarray, words: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct pairs of a block, where each first occurs, each word's pair and the place of the word before (-1 at a text's start)."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = -1
    pair = mix(mix(np.append(words, _START)[before]) * np.uint64(0x9E3779B97F4A7C15) + words[codes])
    distinct, first, place = np.unique(pair, return_index=True, return_inverse=True)
    return distinct, first, place, before


def _block(number: int, held: list[tuple]) -> pa.RecordBatch:
    """One row: documents as indices into the sorted hashes of the block's distinct words."""
    ids, lengths, targets, own = pa.concat_arrays([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
    words, codes = np.unique(own, return_inverse=True)
    full = lengths > 0
    row = {
        "block": number, "ids": ids.to_pylist(), "lengths": packed(lengths.astype(np.int32)), "targets": packed(targets.astype(np.int8)), "words": packed(np.diff(words, prepend=np.uint64(0))), "codes": packed(codes.astype(np.int32)),
        "slice": words[words < np.uint64((1 << 64) // SLICES)].astype(np.int64).tolist(), "n_words": len(own), "n_texts": int(full.sum()), "target_words": int(lengths[targets].sum()), "target_texts": int((full & targets).sum()),
    }
    kinds = {"ids": pa.list_(pa.int64()), "slice": pa.list_(pa.int64())} | dict.fromkeys(("lengths", "targets", "words", "codes"), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.int64())) for k, v in row.items()], list(row))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths, words and codes of a block."""
    return unpacked(row["lengths"], np.int32).astype(np.int64), np.cumsum(unpacked(row["words"], np.uint64), dtype=np.uint64), unpacked(row["codes"], np.int32)


def blocks(marked: DataFrame) -> DataFrame:
    """The rows of each task in blocks; marked: doc_id, text, target (boolean)."""
    bounded_batches(marked.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, total = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                ids, texts, target = (c.slice(k, SLICE_ROWS) for c in batch.columns)
                words = Words(text_array(texts))
                held.append((ids, words.counts, np.asarray(target).astype(bool), stable_hashes(words.unique)[words.codes]))
                total += len(words.codes)
                if total >= BLOCK_WORDS:
                    yield _block(number, held)
                    number, held, total = number + 1, [], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield _block(number, held)

    return marked.select("doc_id", "text", "target").mapInArrow(run, _BLOCK)


def totals(made: DataFrame, ranges: int) -> DataFrame:
    """block, kind (0 words, 1 pairs), range, and the corpus' counts of the keys that the block has in that range."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Keys are hashes, so equal ranges of their values hold about equally many.
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                lengths, words, codes = _opened(row)
                is_target = np.repeat(unpacked(row["targets"], np.int8).astype(bool), lengths)
                pairs, _, place, _ = _pairs(lengths, words, codes)
                for kind, (own, places) in enumerate(((words, codes), (pairs, place))):
                    counts = np.bincount(places, minlength=len(own)), np.bincount(places[is_target], minlength=len(own))
                    cuts = [0, *np.searchsorted(own, edges), len(own)]
                    rows = [(row["block"], kind, r, packed(np.diff(own[a:b], prepend=np.uint64(0))), *(packed(x[a:b]) for x in counts)) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["block", "kind", "range", "keys", "background", "target"])

    def add(group: pa.Table) -> pa.Table:
        own, background, target = ([unpacked(x, kind) for x in group.column(c).to_pylist()] for c, kind in (("keys", np.uint64), ("background", np.int64), ("target", np.int64)))
        distinct, place = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in own]), return_inverse=True)
        ends = np.cumsum([len(x) for x in own])[:-1]
        answers = []
        for counts in (background, target):
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, place, np.concatenate(counts))
            answers.append(pa.array([packed(x) for x in np.split(total[place], ends)], pa.binary()))
        return pa.table([group.column("block"), group.column("kind"), group.column("range"), *answers], names=["block", "kind", "range", "background", "target"])

    asked = made.select("block", "lengths", "targets", "words", "codes").mapInArrow(split, "block long, kind int, range int, keys binary, background binary, target binary")
    return asked.groupBy("kind", "range").applyInArrow(add, "block long, kind int, range int, background binary, target binary")


def distinct_words(made: DataFrame, ranges: int) -> int:
    """How many different words the blocks hold; each range of their hashes is merged by itself, as in totals()."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                words = np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)
                cuts = [0, *np.searchsorted(words, edges), len(words)]
                rows = [(r, packed(np.diff(words[a:b], prepend=np.uint64(0)))) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["range", "words"])

    def count(group: pa.Table) -> pa.Table:
        own = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in group.column("words").to_pylist()]
        return pa.table([pa.array([len(np.unique(np.concatenate(own)))], pa.int64())], names=["n"])

    parts = made.select("words").mapInArrow(split, "range int, words binary").groupBy("range").applyInArrow(count, "n long")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class NgramModel:
    """Counts of one model; scale: what its counts are multiplied by to match the other's."""

    def __init__(self, total: int, texts: int, vocabulary: int, scale: float):
        self.total, self.texts, self.scale, self.base = total, texts, scale, SMOOTHING / max(vocabulary, 1)

    def loss(self, words: np.ndarray, pairs: np.ndarray, befores: np.ndarray, size: np.ndarray, one: np.ndarray) -> np.ndarray:
        """-ln P of each word, given counts (without the own document's) of word, pair and word before (-1 where a text
        starts); size, one: words and texts that the own document takes out of the totals."""
        single = (words * self.scale + self.base) / ((self.total - size) * self.scale + SMOOTHING)
        before = np.where(befores >= 0, befores, self.texts - one) * self.scale
        return -np.log((pairs * self.scale + SMOOTHING * single) / (before + SMOOTHING))


def _own_counts(places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often the own document has each entry of places."""
    document = np.repeat(np.arange(len(lengths)), lengths)
    _, place, often = np.unique(document * (int(places.max(initial=0)) + 1) + places, return_inverse=True, return_counts=True)
    return often[place]


def _losses(models: tuple, counts: list[tuple[np.ndarray, np.ndarray]], lengths: np.ndarray, targets: np.ndarray, codes: np.ndarray, place: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Each document's loss under target and background; counts: of words and of pairs, by model."""
    own_words, own_pairs = _own_counts(codes, lengths), _own_counts(place, lengths)
    # A word before has its own count at its own place; starts are looked up nowhere.
    own_before = np.concatenate([[0], own_words[:-1]]) if len(codes) else own_words
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    out = []
    for model, (words, pairs), mine in zip(models, counts, (np.repeat(targets, lengths), np.ones(len(codes), bool)), strict=True):
        size = np.repeat(lengths, lengths) * mine
        known = np.where(before >= 0, words[before] - own_before * mine, -1) if len(codes) else before
        out.append(sums(model.loss(words[codes] - own_words * mine, pairs[place] - own_pairs * mine, known, size, mine.astype(np.int64)), offsets) / np.maximum(lengths, 1))
    return out


def score_documents(docs: DataFrame, labels: DataFrame, exact: bool = False) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score; labels: doc_id of the target documents; exact: V is counted, not estimated."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().withColumn("mark", F.lit(True))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Labels grow with the corpus: the join is by key at every size, so its cost stays in proportion.
    marked = own.join(wanted.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("mark", F.lit(False)).alias("target"))
    made = Scratch(docs.sparkSession, "entropy").keep(blocks(marked), "blocks")
    names = ("target_words", "target_texts", "n_words", "n_texts")
    n = made.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    ranges = -(-n["n_words"] // RANGE_WORDS) or 1
    vocabulary = distinct_words(made, ranges) if exact else SLICES * made.select(F.explode("slice").alias("w")).distinct().count()
    models = NgramModel(n["target_words"], n["target_texts"], vocabulary, 1.0), NgramModel(n["n_words"], n["n_texts"], vocabulary, n["target_words"] / max(n["n_words"], 1))

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        row = block.select(["ids", "lengths", "targets", "words", "codes"]).to_pylist()[0]
        lengths, own, codes = _opened(row)
        _, _, place, before = _pairs(lengths, own, codes)
        parts = counts.sort_by([("kind", "ascending"), ("range", "ascending")])
        kinds, found = parts.column("kind").to_pylist(), []
        for column in ("target", "background"):
            values = [unpacked(x, np.int64) for x in parts.column(column).to_pylist()]
            found.append(tuple(np.concatenate([np.zeros(0, np.int64), *(v for v, k in zip(values, kinds, strict=True) if k == kind)]) for kind in (0, 1)))
        losses = _losses(models, found, lengths, unpacked(row["targets"], np.int8).astype(bool), codes, place, before)
        empty = lengths == 0
        columns = [pa.array(row["ids"], pa.int64()), pa.array(lengths), *(pa.array(x, pa.float64(), mask=empty) for x in (*losses, losses[1] - losses[0]))]
        return pa.table(columns, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    answers = totals(made, ranges).groupBy("block")
    return made.select("block", "ids", "lengths", "targets", "words", "codes").groupBy("block").cogroup(answers).applyInArrow(run, "doc_id long, n_words long, target_loss double, background_loss double, score double")
