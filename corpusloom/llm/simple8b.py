"""Token files: Simple-8b word-aligned integer coding with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector (its top bits) and a 60-bit payload, lowest slot first. Selectors 0-13 pack 60,
30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 and 1 values of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 and 60 bits.
Selector 15 is an escape: the value (60 bits or more) is the whole next word. Every block of BLOCK values begins on a
word of its own, whose offset the file lists, so blocks decode side by side with array operations.

A file holds, little-endian: the magic, then six 64-bit counts (documents, ids, alphabet entries, blocks, words, block
size), then doc_id and length of each document (int64), the alphabet (uint32: the ids of this file from the commonest
on; what is coded is an id's place in it, so common ids take few bits), the word offset of each block (int64, one more
than blocks), the words (uint64), and an unsigned crc32 of all that (uint32).

Writing: rows are range-partitioned by doc_id and sorted; a file is closed at FILE_IDS ids. Files are written and read by
Spark, as the rows of a table (part, seq, before, docs, ids, data), so any store that Spark reaches holds them, and a task
that is run again leaves one result. (part, seq) is the order of ascending doc_ids; `before` counts the ids of earlier
files of the part, so a file's place follows from that and one total for each part. Ties of doc_id are ordered by text;
null doc_ids come first; a null text is an empty one; an empty table gives no file; columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.byte_tokens import tokenizer, with_end
from corpusloom.llm.common import Scratch, bounded_batches, shuffle_parts, text_array

#: Fixed values of the coding: values in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
MAGIC = b"S8BTOK01"
BLOCK = 1024
#: Ids after which a file is closed, and bytes of a row group of the table; they bound a reader's memory.
FILE_IDS, GROUP_BYTES = 2_000_000, 8 << 20
FILES = "part int, seq int, before long, docs long, ids long, data binary"


#: Values that may follow a block's end in the laid-out form of blocks: more than any word holds, all zero.
MARGIN = 64


def encode_blocks(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """uint64 values -> (words, word offset of each block and the end).

    Blocks are rows of a matrix with a margin of zeros, so a word that runs over a block's end needs no special care.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    rows, width = -(-n // block), block + MARGIN
    ends = np.full(rows, block)
    ends[-1] = n - (rows - 1) * block
    laid = np.zeros((rows, width), dtype=np.uint64)
    laid[:-1, :block] = values[: (rows - 1) * block].reshape(-1, block)
    laid[-1, : ends[-1]] = values[(rows - 1) * block :]
    # The narrowest selector that takes each value (14: none does), and the widest need of the next 1, 2, 4, ... values.
    need = np.zeros((rows, width), dtype=np.uint8)
    for bits in BITS.tolist():
        if int(values.max()) >> bits:
            need += laid >= np.uint64(1 << bits)
    widest = [need]
    for k in range(5):
        widest.append(np.maximum(widest[-1][:, : -(1 << k)], widest[-1][:, 1 << k :]))
    # Who takes fewer values takes wider ones, so the first selector that fits is the number of those that do not.
    choice = np.zeros((rows, block), dtype=np.uint8)
    for selector in range(int(need.max())):
        count = int(COUNTS[selector])
        power = count.bit_length() - 1
        two = widest[power], count - (1 << power)
        choice += np.maximum(two[0][:, :block], two[0][:, two[1] : two[1] + block]) > selector
    take = np.append(COUNTS, 1).astype(np.uint8)[choice]
    head = np.zeros((rows, block), dtype=bool)
    at, live = np.zeros(rows, dtype=np.int64), np.arange(rows)
    while len(live):
        here = at[live]
        head[live, here] = True
        at[live] = here = here + take[live, here]
        live = live[here < ends[live]]
    heads = np.flatnonzero(head)
    owner = heads // block
    chosen, source = choice.reshape(-1)[heads], heads + owner * MARGIN
    size = np.where(chosen == len(COUNTS), 2, 1)
    where = np.cumsum(size) - size
    words, flat = np.zeros(int(size.sum()), dtype=np.uint64), laid.reshape(-1)
    for selector, (count, bits) in enumerate(zip(COUNTS.tolist(), BITS.tolist(), strict=True)):
        mine = np.flatnonzero(chosen == selector)
        first, word = source[mine], np.full(len(mine), selector << 60, dtype=np.uint64)
        for slot in range(count if len(mine) else 0):
            word |= flat[first + slot] << np.uint64(slot * bits)
        words[where[mine]] = word
    escaped = np.flatnonzero(chosen == len(COUNTS))
    words[where[escaped]] = np.uint64(ESCAPE << 60)
    words[where[escaped] + 1] = flat[source[escaped]]
    per_block = np.bincount(owner, weights=size, minlength=rows).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_block)])


def decode_blocks(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The inverse of encode_blocks for n values."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    rows, width = len(offsets) - 1, block + MARGIN
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():  # a raw word may look like any selector: only words that are not the payload of an escape count
        raw = np.zeros(len(words), dtype=bool)
        k, escapes = 0, np.flatnonzero(selector == ESCAPE)
        while k < len(escapes):
            i = int(escapes[k])
            if not raw[i]:
                raw[i + 1] = True
            k += 1
        heads = np.flatnonzero(~raw)
    else:
        heads = np.arange(len(words))
    chosen = selector[heads]
    owner = np.searchsorted(offsets, heads, side="right") - 1
    slots = np.where(chosen == ESCAPE, 1, COUNTS[np.minimum(chosen, len(COUNTS) - 1)])
    before = np.cumsum(slots) - slots
    first = np.searchsorted(owner, np.arange(rows))
    start = owner * width + before - before[first[owner]]
    # As in encoding, what a block's last word holds beyond the block goes to the margin.
    out = np.zeros(rows * width, dtype=np.uint64)
    for s, (count, bits) in enumerate(zip(COUNTS.tolist(), BITS.tolist(), strict=True)):
        mine = np.flatnonzero(chosen == s)
        payload, place, mask = words[heads[mine]], start[mine], np.uint64((1 << bits) - 1)
        for slot in range(count if len(mine) else 0):
            out[place + slot] = (payload >> np.uint64(slot * bits)) & mask
    escaped = np.flatnonzero(chosen == ESCAPE)
    out[start[escaped]] = words[heads[escaped] + 1]
    return out.reshape(rows, width)[:, :block].reshape(-1)[:n]


def pack_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One token file. doc_ids holds the smallest int64 for a null."""
    if len(ids) and int(ids.max()) < 1 << 22:
        often = np.bincount(ids)
        alphabet, place = np.flatnonzero(often), ids
        rank = np.zeros(len(often), dtype=np.uint64)  # by id
        order = np.argsort(-often[alphabet], kind="stable")
        rank[alphabet[order]] = np.arange(len(order))
    else:
        alphabet, place, often = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), dtype=np.uint64)  # by place in the alphabet
        rank[order] = np.arange(len(order))
    words, offsets = encode_blocks(rank[place] if len(ids) else np.zeros(0, np.uint64))
    body = b"".join([
        MAGIC,
        np.array([len(doc_ids), len(ids), len(alphabet), len(offsets) - 1, len(words), BLOCK], dtype="<i8").tobytes(),
        doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), alphabet[order].astype("<u4").tobytes(), offsets.astype("<i8").tobytes(), words.astype("<u8").tobytes(),
    ])
    return body + np.uint32(zlib.crc32(body)).astype("<u4").tobytes()


def unpack_file(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a token file; raises ValueError if it is damaged."""
    data = memoryview(data)
    if data[:8] != MAGIC or len(data) < 60 or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a whole token file")
    docs, n, letters, blocks, n_words, block = np.frombuffer(data, "<i8", 6, 8).tolist()
    at = 56
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<i8", docs, at := at + 8 * docs)
    alphabet = np.frombuffer(data, "<u4", letters, at := at + 8 * docs)
    offsets = np.frombuffer(data, "<i8", blocks + 1, at := at + 4 * letters)
    words = np.frombuffer(data, "<u8", n_words, at + 8 * (blocks + 1))
    places = decode_blocks(words, offsets, n, block)
    return doc_ids, lengths, alphabet[places.astype(np.int64)] if n else np.zeros(0, np.uint32)


_NULL_ID = np.iinfo(np.int64).min


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write token files to a table at path; returns the table: part, seq, before, docs, ids, data - a row for each file."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, size
            doc_ids, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            numbers = {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before]), "docs": pa.array([len(doc_ids)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())}
            seq, before, held, size = seq + 1, before + len(ids), [], 0
            return pa.RecordBatch.from_pydict(numbers | {"data": pa.array([pack_file(doc_ids, lengths, ids)], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = with_end(*tokenizer(tokenizer_path).encode(text_array(batch.column(1))), end_id)
            doc_ids = batch.column(0).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            k = 0
            while k < len(doc_ids):  # as many documents as still fit; at least one
                m = max(k + 1, int(np.searchsorted(offsets, offsets[k] + FILE_IDS - size, side="right")) - 1)
                held.append((doc_ids[k:m], np.diff(offsets[k : m + 1]), ids[offsets[k] : offsets[m]]))
                size += int(offsets[m] - offsets[k])
                k = m
                if size >= FILE_IDS or k < len(doc_ids):
                    yield flush()
            pa.default_memory_pool().release_unused()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILES).write.mode("overwrite").option("compression", "uncompressed").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(FILES).parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), tokens (array<long>)."""
    return _from_files(files, "tokens array<long>", lambda ids, lengths: {"tokens": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids.astype(np.int64)))})


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian unsigned 32-bit integers, from the files."""

    def digest(ids: np.ndarray, lengths: np.ndarray) -> dict[str, pa.Array]:
        data, ends = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), 4 * np.cumsum(lengths)
        return {"n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(data[e - 4 * n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.int64())}

    return _from_files(files, "n_tokens long, ids_crc32 long", digest)


def _from_files(files: DataFrame, schema: str, columns) -> DataFrame:
    # One row for each partition of the writing job, whose number is a setting: the running total and broadcast are small.
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))
    start = parts.select("part", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = files.join(F.broadcast(start), "part").select("data", (F.col("start") + F.col("before")).alias("start"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, lengths, ids = unpack_file(batch.column(0)[k].as_buffer())
                made, start = columns(ids, lengths), batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == _NULL_ID), pa.array(start + np.cumsum(lengths) - lengths), *(made[n] for n in names)], ["doc_id", "start", *names])
                pa.default_memory_pool().release_unused()

    return placed.mapInArrow(run, f"doc_id long, start long, {schema}")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode, write, read back: a digest row for each document."""
    return read_digests(write_tokens(docs, Scratch(spark, "tokens").path("files"), tokenizer_path, end_id))
