"""Chat formatting at token level: one row per turn, its ids and its loss mask; reading back.

Template of a turn: `### ` role `: ` text `</turn>` and a line feed. Role and text are encoded each by itself; the three
control strings are reserved ids behind the vocabulary, spliced between them, so no text can produce one and no merge
crosses a border. A conversation's ids are those of its turns, by turn (nulls first), ties by role, then by ids. Control
strings that occur in a text or role are escaped, so that the formatted characters are unambiguous too: `\\` becomes `\\\\`,
`###` `\\h`, `</turn>` `\\e`, the vocabulary's `<|endoftext|>` `\\x`, and in a role `:` `\\c`.

The mask is a prefix sum over a batch: +1 at the first id of an assistant's text, -1 behind its last one. Formatting is
row by row, without a shuffle; reading back shuffles ids by conversation and streams them, sorted, so a task holds one
batch whatever a conversation's length.

Null role and text are empty; rows without conv_id are one conversation; repeated rows are turns of their own; an empty
table gives no row. Very long texts are encoded whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.byte_tokens import tokenizer
from corpusloom.llm.common import bounded_batches, encoder_caches, text_array

#: Rows that are formatted at a time.
SLICE = 1024
#: Control strings, in the order of their reserved ids, which follow the vocabulary's.
CONTROLS = ("### ", ": ", "</turn>\n")
TURN, SAY, END = range(3)
#: What is escaped in contents; the backslash first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"), ("<|endoftext|>", "\\x"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
_PLAIN = {code[1]: plain for plain, code in ROLE_ESCAPES}

TURNS = "conv_id long, turn long, role string, ids array<int>, loss array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array, pairs: tuple = ESCAPES) -> pa.Array:
    for plain, code in pairs:
        texts = pc.replace_substring(texts, plain, code)
    return texts


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text) if "\\" in text else text


@functools.lru_cache(maxsize=2)
def alphabet(path: str) -> tuple[list[bytes], int]:
    """The bytes of every id (reserved ones: the control string), and the first reserved id."""
    own = tokenizer(path)
    byte = {c: b for b, c in own.stand_in.items()}
    vocab = own.tokenizer.get_vocab(with_added_tokens=True)
    base = max(vocab.values()) + 1
    out = [b""] * (base + len(CONTROLS))
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    for k, control in enumerate(CONTROLS):
        out[base + k] = control.encode()
    return out, base


encoder_caches.append(alphabet.cache_clear)


def assemble(roles: pa.Array, texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, loss mask and offsets of turns; roles and texts without nulls."""
    _, base = alphabet(path)
    encode = tokenizer(path).encode
    distinct = roles.dictionary_encode()
    role_pool, role_ends = encode(escape(distinct.dictionary, ROLE_ESCAPES))
    said, said_ends = encode(escape(texts))
    which = np.asarray(distinct.indices, dtype=np.int64)
    n_role, n_text = np.diff(role_ends)[which], np.diff(said_ends)
    ends = np.concatenate([[0], np.cumsum(n_role + n_text + 3)]).astype(np.int64)
    ids = np.empty(int(ends[-1]), dtype=np.int32)
    at = ends[:-1]
    text_at = at + n_role + 2
    ids[at], ids[text_at - 1], ids[ends[1:] - 1] = base + TURN, base + SAY, base + END
    spots = lambda begin, n: np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    ids[spots(at + 1, n_role)] = role_pool[spots(role_ends[:-1][which], n_role)]
    ids[spots(text_at, n_text)] = said
    learnt = np.asarray(pc.equal(roles, "assistant"))
    change = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(change, text_at[learnt], 1)
    np.add.at(change, (text_at + n_text)[learnt], -1)
    return ids, np.cumsum(change[:-1]).astype(bool), ends


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """TURNS: a row for each row of conversations. ids are those of the vocabulary file and the reserved ones behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                conv_id, turn, role, text = (c.slice(k, SLICE) for c in batch.columns)
                role = text_array(role)
                ids, loss, ends = assemble(role, text_array(text), path)
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([conv_id, turn, role, pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(loss))], ["conv_id", "turn", "role", "ids", "loss"])

    bounded_batches(conversations.sparkSession)
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    return conversations.select(*columns).mapInArrow(run, TURNS)


def split(ids: list[int], path: str) -> tuple[str, str, int]:
    """Role and text of a formatted turn, still escaped, from its ids alone, and the place of the id between them."""
    pool, base = alphabet(path)
    say = ids.index(base + SAY)
    if ids[0] != base + TURN or ids[-1] != base + END:
        raise ValueError("not a formatted turn")
    shown = lambda part: b"".join([pool[i] for i in part]).decode()
    return shown(ids[1:say]), shown(ids[say + 1 : -1]), say


def parse(ids: list[int], path: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, text, _ = split(ids, path)
    return unescape(role), unescape(text)


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """DIGEST, read from the ids and masks of format_turns(): all turns, and all text under the mask, unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, _ = alphabet(path)
        now, state, out = None, None, []

        def ended() -> tuple:
            n, said, chars, learnt, shown = state
            return now[0], n, said.hexdigest(), chars, learnt.hexdigest(), shown

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        fixed = sum(map(len, CONTROLS))
        for batch in batches:
            listed, masks = batch.column(1), batch.column(2)
            ends = np.asarray(listed.offsets) - listed.offsets[0].as_py()
            flat = listed.flatten().to_numpy().tolist()
            under = np.asarray(masks.flatten().to_numpy(zero_copy_only=False), dtype=bool)
            before = np.concatenate([[0], np.cumsum(under)])
            for k, conv_id in enumerate(batch.column(0).to_pylist()):
                begin, end = int(ends[k]), int(ends[k + 1])
                ids = flat[begin:end]
                if now is None or now[0] != conv_id:
                    if now is not None:
                        out.append(ended())
                    now, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw_role, raw_text, say = split(ids, path)
                role, text = unescape(raw_role), unescape(raw_text)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                n = before[end] - before[begin]
                if n:
                    own = n == before[end - 1] - before[begin + say + 1] == end - begin - say - 2
                    masked = text if own else unescape(b"".join([pool[ids[i]] for i in np.flatnonzero(under[begin:end])]).decode())
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += fixed + len(raw_role) + len(raw_text)
            if out:
                yield flush()
        if now is not None:
            out.append(ended())
            yield flush()

    bounded_batches(turns.sparkSession)
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "ids")
    return ordered.select("conv_id", "ids", "loss").mapInArrow(run, DIGEST)
