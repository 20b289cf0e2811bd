"""Ids of the byte-level tokenizer for whole batches of texts.

The result for each text is that of `Tokenizer.encode(text, add_special_tokens=False).ids`. White space followed by a
non-white run is a *unit*; pre-tokenisation never joins units, so a text whose separators are single blanks or line
feeds is the concatenation of its units. Units are dictionary-encoded per batch and only those not met before by this
worker are encoded. All other texts (runs of white space, other white space, white space at the end, NUL, or the start
of a special token's string) go through `encode` whole.
"""

from __future__ import annotations

import functools
import gc
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm.common import encoder_caches, gather, worker_threads_off

#: Entries of a worker's cache of units and of pieces (a unit may be a piece, with the same ids); a full one starts anew.
CACHE = 700_000
#: Texts that are split at a time.
SLICE = 2048
#: Code points that count as white space for the pre-tokeniser besides blank and line feed, and NUL.
_ODD = r"[\x00\t\x0B\x0C\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{3000}\x{FEFF}]|[ \n][ \n]|[ \n]$|<\|"


class ByteTokenizer:
    def __init__(self, path: str):
        worker_threads_off()
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        #: The published pre-tokenisation pattern, and the printable stand-ins of bytes.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(extra)}
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of what the pre-tokeniser keeps together."""
        found = self.known.get(piece)
        return self._new_piece(piece) if found is None else found

    def _new_piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[:1] == " " and piece[1:].isalpha():
            word = "\u0120" + piece[1:]  # letters stand for themselves
        else:
            word = piece.encode().decode("latin-1").translate(self.stand_in)
        found = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        if len(piece) <= 64:
            self.known[piece] = found
        return found

    def _unit(self, unit: str) -> bytes:
        found = self.known.get(unit)
        if found is None:
            if unit[:1] == " " and unit[1:].isalpha():
                return self._new_piece(unit)
            if unit[:1] == " " and unit[-1] in ",." and unit[1:-1].isalpha():
                found = self._piece(unit[:-1]) + self._piece(unit[-1])
            else:
                found = b"".join(map(self._piece, self.split(unit)))
            if len(unit) <= 64:
                self.known[unit] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts without nulls -> (ids of all texts, offsets)."""
        # Nothing here makes reference cycles, but so many objects that the collector would run all the time.
        gc.disable()
        try:
            parts = [self._encode(texts.slice(k, SLICE)) for k in range(0, max(len(texts), 1), SLICE)]
        finally:
            gc.enable()
        if len(parts) == 1:
            return parts[0]
        before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *(ends[1:] + b for (_, ends), b in zip(parts, before))])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) >= CACHE:
            self.known.clear()
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        easy = texts.filter(pa.array(~odd))
        marked = pc.replace_substring(pc.replace_substring(easy, " ", "\x00 "), "\n", "\x00\n")
        listed = pc.split_pattern(marked, "\x00")
        coded = listed.flatten().dictionary_encode()
        codes = np.asarray(coded.indices)
        found = list(map(self._unit, coded.dictionary.to_pylist()))
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        pool = np.frombuffer(b"".join(found), dtype=np.uint32)
        each = lengths[codes]
        ids = gather(pool, (np.cumsum(lengths) - lengths)[codes], each)
        ends = np.concatenate([[0], np.cumsum(each)])
        bounds = ends[np.asarray(listed.offsets, dtype=np.int64) - (listed.offsets[0].as_py() if len(listed) else 0)] if len(listed) else np.zeros(1, np.int64)
        if not odd.any():
            return ids, bounds
        rest = iter(self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.filter(pa.array(odd)).to_pylist())
        parts, k = [], 0
        for is_odd in odd:
            if is_odd:
                parts.append(np.array(next(rest), dtype=np.uint32))
            else:
                parts.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    """One per Python worker."""
    return ByteTokenizer(os.fspath(path))


encoder_caches.append(tokenizer.cache_clear)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    new = offsets + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
