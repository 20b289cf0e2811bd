"""Packing: vector bin packing of token pieces into training sequences under three simultaneous limits.

An item has three sizes: tokens, segments (1) and loss-bearing tokens. A sequence holds at most `tokens` tokens,
`segments` items and `loss` loss-bearing tokens. In instruction data a row may have a prompt, whose ids come first and
bear no loss; all other ids, the end id included, bear loss.

The dot-product heuristic places items in descending order of their weighted size; each goes to the open sequence with
room in all three dimensions for which the dot product of its size and the free room is largest, or opens a new one.
Ties: of equal items the earlier one first, of equal sequences the one opened first.

Documents are cut freely, so every document is first cut at the limits: pieces of `tokens` ids are sequences, all others
are items. Items of one block of BLOCK_ITEMS documents are placed; then the sequences beyond the least possible number
are dissolved, and each sequence with room takes, while there are any, the loose piece whose part that fits has the
largest dot product with the room in the three dimensions. At last what an unfilled sequence holds is cut at powers of
two, which need no padding. Both steps keep all three limits. A block is bounded and lies within one task, so nothing is
shuffled, and a task that is run again gives the same pieces. sequence_id is partition * 2^40 + number within the
partition.

A null text or prompt is an empty one (the end id is still packed); repeated rows are packed once each; an empty table
gives no row; columns other than doc_id, text and the prompt are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.byte_tokens import tokenizer, with_end
from corpusloom.llm.common import bounded_batches, gather, text_array

#: Documents whose remainders are packed together; bounds memory to BLOCK_ITEMS * tokens ids.
BLOCK_ITEMS = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def place_items(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Dot-product vector bin packing: item numbers of each bin. sizes: items x dimensions, each within limits."""
    share = sizes / limits
    weight = weights(sizes, limits)
    order = np.argsort(-(share * weight).sum(axis=1), kind="stable")
    room = np.empty((max(len(sizes), 1), sizes.shape[1]))
    bins: list[list[int]] = []
    opened = np.zeros(0, dtype=np.int64)  # bins that can still take something
    smallest = share.min(axis=0) if len(share) else None
    for i in order.tolist():
        fit = opened[(room[opened] >= share[i] - 1e-12).all(axis=1)]
        if len(fit):
            k = int(fit[np.argmax(room[fit] @ (weight * share[i]))])
            bins[k].append(i)
            room[k] -= share[i]
        else:
            k = len(bins)
            bins.append([i])
            room[k] = 1 - share[i]
            opened = np.append(opened, k)
        if (room[k] < smallest - 1e-12).any():
            opened = opened[opened != k]
    return bins


def weights(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The heuristic's weight of each dimension: its mean share of the limit, of all."""
    mean = (sizes / limits).mean(axis=0) if len(sizes) else np.ones(len(limits))
    return mean / max(mean.sum(), 1e-12)


def loss_of(start: np.ndarray, length: np.ndarray, quiet: np.ndarray) -> np.ndarray:
    """Loss-bearing ids of pieces [start, start + length) of documents whose first `quiet` ids bear none."""
    return np.maximum(start + length - np.maximum(start, quiet), 0)


Piece = tuple[int, int, int]


def fill_up(bins: list[list[Piece]], limits: np.ndarray, quiet: np.ndarray) -> list[list[Piece]]:
    """Dissolve the bins beyond the least possible number and fill the others with (parts of) loose pieces.

    bins: lists of (document, start, length). What fills a bin is chosen by the dot product of the part that fits and
    the bin's room. Bins stay short where another limit than that on tokens binds, or where nothing is left.
    """
    if not bins:
        return []
    size = lambda b: np.array([sum(p[2] for p in b), len(b), sum(max(s + n - max(s, int(quiet[i])), 0) for i, s, n in b)], dtype=float)
    used = np.stack([size(b) for b in bins])
    weight = weights(used, limits)
    order = np.argsort(-((used / limits) * weight).sum(axis=1), kind="stable").tolist()
    least = max(int(np.ceil((used.sum(axis=0) / limits).max() - 1e-9)), 1)
    order, spare = order[:least], order[least:]
    pool = np.array([p for k in spare for p in bins[k]], dtype=np.int64).reshape(-1, 3)
    done: list[list[Piece]] = []
    while order:
        k = order.pop(0)
        held, room = list(bins[k]), limits - used[k]
        while room[0] > 0 and room[1] > 0:
            if not len(pool):
                if not order:
                    break
                pool = np.array(bins[order.pop()], dtype=np.int64).reshape(-1, 3)
            own = quiet[pool[:, 0]]
            fits = np.minimum(np.minimum(pool[:, 2], int(room[0])), np.maximum(own - pool[:, 1], 0) + int(room[2]))
            gain = (fits / limits[0] * room[0] / limits[0]) * weight[0] + room[1] / limits[1] ** 2 * weight[1] + (loss_of(pool[:, 1], fits, own) / limits[2] * room[2] / limits[2]) * weight[2]
            best = int(np.argmax(np.where(fits > 0, gain, -1.0)))
            n = int(fits[best])
            if n <= 0:  # no loose piece fits: all that is left bears loss
                break
            item, start, length = pool[best].tolist()
            held.append((item, start, n))
            room = room - [n, 1, max(start + n - max(start, int(quiet[item])), 0)]
            if n < length:
                pool[best] = item, start + n, length - n
            else:
                pool = np.delete(pool, best, axis=0)
        done.append(held)
    if len(pool):  # a limit other than that on tokens binds: what is left makes sequences of its own
        sizes = np.stack([pool[:, 2], np.ones(len(pool)), loss_of(pool[:, 1], pool[:, 2], quiet[pool[:, 0]])], axis=1)
        done += [[tuple(pool[i].tolist()) for i in b] for b in place_items(sizes, limits)]
    return [b for b in done if b]


def at_powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """Cut what one sequence holds into sequences whose lengths are the powers of two in its length."""
    out, rest = [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        need, part = total & (1 << bit), []
        while need:
            item, start, length = rest.pop(0)
            part.append((item, start, min(length, need)))
            if length > need:
                rest.insert(0, (item, start + need, length - need))
            need -= part[-1][2]
        if part:
            out.append(part)
    return out


def cut(length: int, quiet: int, tokens: int, loss: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: each as long as both limits allow."""
    out, at = [], 0
    while at < length:
        n = min(length - at, tokens, max(quiet - at, 0) + loss)
        out.append((at, n))
        at += n
    return out


def pieces_of(length: np.ndarray, quiet: np.ndarray, tokens: int, loss: int) -> np.ndarray:
    """(document, start, length) of all pieces, by document."""
    if loss < tokens:
        return np.array([(i, s, n) for i, (size, q) in enumerate(zip(length.tolist(), quiet.tolist(), strict=True)) for s, n in cut(size, q, tokens, loss)], dtype=np.int64).reshape(-1, 3)
    count = -(-length // tokens)
    doc = np.repeat(np.arange(len(length)), count)
    start = tokens * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return np.stack([doc, start, np.minimum(tokens, length[doc] - start)], axis=1)


def pack_block(length: np.ndarray, quiet: np.ndarray, limits: np.ndarray) -> list[list[Piece]]:
    """The sequences of a block of documents, as lists of pieces."""
    made = pieces_of(length, quiet, int(limits[0]), int(limits[2]))
    full = made[:, 2] == limits[0]
    items = made[~full]
    sizes = np.stack([items[:, 2], np.ones(len(items)), loss_of(items[:, 1], items[:, 2], quiet[items[:, 0]])], axis=1)
    placed = [[tuple(items[i].tolist()) for i in b] for b in place_items(sizes, limits)]
    out = [[tuple(p)] for p in made[full].tolist()]
    for b in fill_up(placed, limits, quiet):
        total = sum(p[2] for p in b)
        out += [b] if total == limits[0] else at_powers(b, total)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, tokens: int = 1024, segments: int = 64, loss: int | None = None, prompt: str | None = None) -> DataFrame:
    """A row for each piece. loss: limit on loss-bearing tokens (None: tokens); prompt: the column of a row's prompt."""
    bounded_batches(docs.sparkSession)
    limits = np.array([tokens, segments, tokens if loss is None else loss], dtype=float)
    if limits.min() < 1:
        raise ValueError("limits must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, sequence = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ITEMS):
                doc_ids, texts, *asked = (c.slice(k, BLOCK_ITEMS) for c in batch.columns)
                ids, offsets = with_end(*tokenizer(tokenizer_path).encode(text_array(texts)), end_id)
                quiet = np.zeros(len(texts), dtype=np.int64)
                if asked:
                    before, bounds = tokenizer(tokenizer_path).encode(text_array(asked[0]))
                    quiet = np.diff(bounds)
                    ids, offsets = _side_by_side(before, bounds, ids, offsets)
                length = np.diff(offsets)
                bins = pack_block(length, quiet, limits)
                flat = np.array([(i, s, n, q) for q, b in enumerate(bins) for i, s, n in b], dtype=np.int64).reshape(-1, 4)
                doc, start, size, number = flat.T
                per = np.array([len(b) for b in bins], dtype=np.int64)
                ends = np.cumsum(size)
                first = np.repeat(np.cumsum(per) - per, per)
                offset = ends - size - (ends[first] - size[first])
                data = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
                at = 4 * (offsets[doc] + start)
                crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(length[doc]), pa.array(base + sequence + number), pa.array(offset)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                sequence += len(bins)
                pa.default_memory_pool().release_unused()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns, *([F.col(f"`{prompt}`").cast("string").alias("prompt")] if prompt else [])).mapInArrow(run, SCHEMA)


def _side_by_side(a: np.ndarray, a_offsets: np.ndarray, b: np.ndarray, b_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the values of a and then those of b."""
    lengths = np.stack([np.diff(a_offsets), np.diff(b_offsets)], axis=1).ravel()
    starts = np.stack([a_offsets[:-1], b_offsets[:-1] + len(a)], axis=1).ravel()
    return gather(np.concatenate([a, b]), starts, lengths), a_offsets + b_offsets
