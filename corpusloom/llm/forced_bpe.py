"""BPE encoding and decoding by forced-boundary splitting.

A merge result is a byte string. If bytes x and y are adjacent in no merge result, no merge can ever join across them,
so a word may be cut there with certainty: its fragments are encoded independently and concatenated. Two relations are
kept, because a word's last byte carries the end-of-word mark: pairs inside a word, and pairs whose second byte ends the
word. Fragments recur across words, so a worker encodes each only once.

The tokenizer file gives the vocabulary, the merges, the added tokens and their normalisation (NFC, lower case, white
space dropped by the splitting pattern). Text is cut at the strings of added tokens first, as written in the text. Words
are runs without ASCII white space; no pattern match spans them, so they are dictionary-encoded per batch.

Decoding joins token strings by one blank, which is what the library does for a tokenizer without a decoder.

A null text is an empty one: no ids, empty decoded text. Rows are mapped one by one: repeated rows, ties and extra
columns do not matter; an empty table gives no row. A text of any length is encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusloom.llm.common import annotate, encoder_caches, text_array

#: Entries of a worker's caches; a full one starts anew.
CACHE = 500_000


class ForcedBoundaryBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end_mark: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pair = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merge = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pair)}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = [b for b in range(256) if b not in plain]
        self.stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(extra)}
        #: joined[last][x, y]: characters x and y are adjacent in a merge result, y its end-of-word character or not.
        self.joined: tuple[set, set] = (set(), set())
        for a, b in pair:
            whole = a + b
            ends = bool(self.end_mark) and whole.endswith(self.end_mark)
            letters = whole[: -len(self.end_mark)] if ends else whole
            for k in range(len(letters) - 1):
                self.joined[ends and k == len(letters) - 2].add(letters[k : k + 2])
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, str, str]] = {}

    @staticmethod
    def normalise(word: str) -> str:
        """NFC, then each character's own lower case (no context, so sigma is never final)."""
        if word.isascii():
            return word.lower()
        word = unicodedata.normalize("NFC", word)
        return word.lower() if "Σ" not in word else "".join(c.lower() for c in word)

    def cut(self, letters: str) -> list[str]:
        """The fragments of a word's letters between certain cuts."""
        out, start, last = [], 0, len(letters) - 2
        inside, at_end = self.joined
        for k in range(last + 1):
            if letters[k : k + 2] not in (at_end if k == last and self.end_mark else inside):
                out.append(letters[start : k + 1])
                start = k + 1
        out.append(letters[start:])
        return out

    def fragment(self, letters: str, ends: bool) -> tuple[int, ...]:
        """Ids of a fragment: the lowest-ranked pair is merged, leftmost first, until none is left.

        Pairs wait in a heap and parts are linked, so n letters take n log n steps.
        """
        known = self.fragments.get((letters, ends))
        if known is not None:
            return known
        parts = list(letters)
        if ends:
            parts[-1] += self.end_mark
        ids = [self.vocab[p] for p in parts if p in self.vocab]
        size, merge = len(ids), self.merge
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # (rank, place, pair, result): a rank is of one pair only, so equal ranks go by place.
        waiting = [(merge[pair][0], k, pair, merge[pair][1]) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merge]
        heapify(waiting)
        while waiting:
            _, k, pair, made = heappop(waiting)
            other = after[k]
            if other == size or (ids[k], ids[other]) != pair:
                continue  # one of the two was merged meanwhile
            ids[k], ids[other] = made, -1
            after[k] = after[other]
            if after[k] < size:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < size and (found := merge.get((ids[left], ids[right]))):
                    heappush(waiting, (found[0], left, (ids[left], ids[right]), found[1]))
        out = tuple(i for i in ids if i >= 0)
        if len(letters) <= 64:
            self.fragments[letters, ends] = out
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        out: list[int] = []
        for piece in self.pieces(self.normalise(text)):
            letters = piece.encode().decode("latin-1").translate(self.stand_in)
            cuts = self.cut(letters)
            for f in cuts[:-1]:
                out += self.fragment(f, False)
            out += self.fragment(cuts[-1], bool(self.end_mark))
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            out += self.encode_plain(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self.encode_plain(text[at:])

    def decode(self, ids) -> str:
        return " ".join(map(self.names.__getitem__, ids))

    def word(self, word: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text and their decoded text."""
        known = self.words.get(word)
        if known is None:
            ids = self.encode(word)
            known = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            if len(word) <= 64:
                self.words[word] = known
        return known

    def digest(self, texts: pa.Array) -> dict[str, pa.Array]:
        """n_tokens and the digests of ids and decoded text, for texts without nulls."""
        for cache in (self.words, self.fragments):
            if len(cache) >= CACHE:
                cache.clear()
        listed = pc.ascii_split_whitespace(texts)
        coded = listed.flatten().dictionary_encode()
        found = list(map(self.word, coded.dictionary.to_pylist()))
        full = np.fromiter((f[0] > 0 for f in found), dtype=bool, count=len(found))
        codes = np.asarray(coded.indices)
        keep = full[codes]
        ends = np.concatenate([[0], np.cumsum(keep)])
        bounds = ends[np.asarray(listed.offsets, dtype=np.int64) - listed.offsets[0].as_py()]
        counts = np.fromiter((f[0] for f in found), dtype=np.int64, count=len(found))[codes]
        total = np.concatenate([[0], np.cumsum(counts)])[np.asarray(listed.offsets, dtype=np.int64) - listed.offsets[0].as_py()]
        offsets, picked = pa.array(bounds.astype(np.int32)), pa.array(codes[keep])
        out = {"n_tokens": pa.array(np.diff(total))}
        for name, k in (("ids_sha256", 1), ("decoded_sha256", 2)):
            parts = pa.array([f[k] for f in found], pa.string()).take(picked)
            whole = pc.binary_join(pa.ListArray.from_arrays(offsets, parts), " ")
            out[name] = pa.array([hashlib.sha256(x).hexdigest() for x in whole.cast(pa.binary()).to_pylist()], pa.string())
        return out


@functools.lru_cache(maxsize=2)
def forced_bpe(path: str) -> ForcedBoundaryBpe:
    """One per Python worker."""
    return ForcedBoundaryBpe(path)


encoder_caches.append(forced_bpe.cache_clear)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each row with `ids` (array<int>) and `decoded` (string)."""

    def run(_, texts: pa.Array) -> dict[str, pa.Array]:
        bpe = forced_bpe(tokenizer_path)
        ids = [bpe.encode(t) for t in text_array(texts).to_pylist()]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([bpe.decode(i) for i in ids], pa.string())}

    return annotate(docs, run, "ids array<int>, decoded string", encodes=True)


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Each row with n_tokens, ids_sha256 and decoded_sha256, without building the arrays of ids."""
    return annotate(docs, lambda _, texts: forced_bpe(tokenizer_path).digest(text_array(texts)), "n_tokens long, ids_sha256 string, decoded_sha256 string", encodes=True)
