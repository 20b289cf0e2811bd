"""Language identification by mixture inference.

Model: for each language, character n-gram (1-3) probabilities over words padded with blanks, from a sample of labelled
training rows of at most `per_language` expected per language (the bound on what is fitted), for the `LANGUAGES`
commonest labels (the bound on the model: n-grams are hashed into 2^16 cells, so a language takes 256 KB). The sample is
counted by the tasks that read it and summed by language on the executors in two steps.

Inference: each word of a document comes from one language, drawn with the document's own proportions. A word's
likelihood under a language is that of its n-grams. Expectation-maximisation finds the proportions; then, languages in
descending proportion, sets of one, two, ... languages are refitted, and the set with the highest likelihood less
`penalty` * log(words) for each language beyond the first is selected; a document's sets stop growing when its own
value no longer rises, so a result depends on the document alone. The prediction is the selected set's largest
proportion, which is also the score.

A null text or one without a letter is `und` with score 0; ties, of proportions and of labels' frequencies alike, go to
the language that sorts first; of two sets with the same value the smaller one is selected; repeated rows and other
columns do not matter; rows without doc_id are sampled by their text; without any labelled row every prediction is
`und`; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, annotate, bounded_batches, mix, text_array

CELLS = 1 << 16
#: Expected number of training rows for each language, and the most languages that are learnt (the commonest labels).
PER_LANGUAGE, LANGUAGES = 1500, 256
#: Partial sums that a language's counts pass through.
_FANOUT = 32


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each n-gram, offsets by word): orders 1 to 3 over lower-cased words with a blank on both sides."""
    joined = "".join(f" {w} " for w in pc.utf8_lower(words).to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.asarray(pc.utf8_length(pc.utf8_lower(words)), dtype=np.int64) + 2
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # characters up to the word's end
    cells, place = [], []
    position = np.arange(len(points))
    value = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 4):
        value[: len(points) - n + 1] = value[: len(points) - n + 1] * np.uint64(0x110000) + points[n - 1 :]
        inside = left >= n
        cells.append((mix(value[inside] + np.uint64(n << 62)) >> np.uint64(48)).astype(np.int64))
        place.append(position[inside])
    order = np.argsort(np.concatenate(place), kind="stable")
    all_cells = np.concatenate(cells)[order]
    per = 3 * lengths - 3
    return all_cells, np.concatenate([[0], np.cumsum(per)])


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang and text of a bounded sample of the rows that may be learnt from, chosen by a hash of doc_id."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return rows.select("lang", "text")
    most = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, per_language / r["n"]) * (1 << 30)))])
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return rows.where(F.pmod(place, F.lit(1 << 30)) < most[F.col("lang")]).select("lang", "text")


def _sparse(lang: str, cells: np.ndarray) -> tuple[str, bytes, bytes]:
    full = np.flatnonzero(cells)
    return lang, full.astype("<i4").tobytes(), cells[full].astype("<i8").tobytes()


def _added(group: pa.Table) -> pa.Table:
    """The sum of sparse counts of one language."""
    total = np.zeros(CELLS, np.int64)
    for places, counts in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(places, "<i4")] += np.frombuffer(counts, "<i8")
    lang, places, counts = _sparse(group.column("lang")[0].as_py(), total)
    return pa.table({"lang": pa.array([lang], pa.string()), "cells": pa.array([places], pa.binary()), "counts": pa.array([counts], pa.binary())})


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each cell under each; the driver gets one row for each language."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            words = Words(text_array(batch.column(1)))
            if not len(words.codes):
                continue
            cells, offsets = word_grams(words.unique)
            owner = words.owner()
            for lang in set(langs.tolist()):
                often = np.bincount(words.codes[langs[owner] == lang], minlength=len(words.unique))
                held.setdefault(lang, np.zeros(CELLS, np.int64))
                held[lang] += np.bincount(cells, weights=np.repeat(often, np.diff(offsets)), minlength=CELLS).astype(np.int64)
        for lang, cells in held.items():
            name, places, counts = _sparse(lang, cells)
            yield pa.RecordBatch.from_pydict({"lang": [name], "cells": [places], "counts": [counts]})

    schema = "lang string, cells binary, counts binary"
    parts = training_rows(docs, per_language).mapInArrow(count, schema).withColumn("part", F.pmod(F.xxhash64("cells"), F.lit(_FANOUT)))
    rows = parts.groupBy("lang", "part").applyInArrow(_added, schema).groupBy("lang").applyInArrow(_added, schema).collect()
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total[r["lang"]] = np.zeros(CELLS, np.int64)
        total[r["lang"]][np.frombuffer(bytes(r["cells"]), "<i4")] = np.frombuffer(bytes(r["counts"]), "<i8")
    langs = sorted(total)
    if not langs:
        return [], np.zeros((CELLS, 0))
    counts = np.stack([total[x] for x in langs], axis=1) + 0.05
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def infer(words: Words, table: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """texts x languages: proportions under the selected language set (all zero for a text without words)."""
    n, k = len(words.offsets) - 1, table.shape[1]
    out = np.zeros((n, k))
    if not len(words.codes) or not k:
        return out
    # Words without a letter say nothing about a language.
    lettered = np.asarray(pc.match_substring_regex(words.unique, r"\pL"))[words.codes]
    bounds = np.concatenate([[0], np.cumsum(lettered)])[words.offsets]
    codes, sizes = words.codes[lettered], np.diff(bounds)
    if not len(codes):
        return out
    cells, offsets = word_grams(words.unique)
    each = np.add.reduceat(table[cells].astype(np.float64), offsets[:-1], axis=0)
    # A third of the sum: the three orders describe the same characters.
    each = each / 3
    top = each.max(axis=1, keepdims=True)
    weight = np.exp(np.maximum(each - top, -60))
    full = np.flatnonzero(sizes)
    counts = sizes[full]
    flat = np.ascontiguousarray(weight[codes].T)  # languages x words

    def climb(flat: np.ndarray, counts: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(counts)), counts)
        while True:
            joint = [flat[j] * share[row, j] for j in range(k)]
            total = np.maximum(sum(joint), 1e-300)
            if not steps:
                return share, np.add.reduceat(np.log(total), starts)
            share = np.stack([np.add.reduceat(x / total, starts) for x in joint], axis=1) / counts[:, None]
            steps -= 1

    share, _ = climb(flat, counts, np.full((len(full), k), 1 / k), rounds)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    best, chosen = np.full(len(full), -np.inf), share.copy()
    live, held = np.arange(len(full)), flat  # the texts whose set still grows, and their words
    for size in range(1, k + 1):
        start = np.where(rank[live] < size, np.maximum(share[live], 1e-6), 0)
        start /= start.sum(axis=1, keepdims=True)
        fitted, likelihood = climb(held, counts[live], start, 0 if size == 1 else 4)
        value = likelihood - penalty * (size - 1) * np.log(np.maximum(counts[live], 2))
        better = value > best[live]
        best[live[better]], chosen[live[better]] = value[better], fitted[better]
        held, live = held[:, np.repeat(better, counts[live])], live[better]
        if not len(live):
            break
    out[full] = chosen
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Each row with lang_pred, score and mixture (the selected languages with their proportions)."""
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table)  # CELLS x languages

    def run(_, texts: pa.Array) -> dict[str, pa.Array]:
        full = text_array(texts)
        letters = np.asarray(pc.match_substring_regex(full, r"\pL"))
        step = max(16, 4096 // max(len(langs), 8))  # texts at a time: what is held grows with the languages
        share = np.concatenate([infer(Words(full.slice(k, step)), sent.value) for k in range(0, len(full), step)])
        best = share.argmax(axis=1) if langs else np.zeros(len(full), int)
        known = letters & bool(langs)
        pred = [langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
        score = np.where(known, share[np.arange(len(full)), best] if langs else 0.0, 0.0)
        mixture = [[{"lang": langs[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0] if ok else [] for row, ok in zip(share, known, strict=True)]
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.clip(score, 0.0, 1.0)), "mixture": pa.array(mixture, kind)}

    return annotate(docs, run, "lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def keep_identified(docs: DataFrame, least_share: float = 0.5) -> DataFrame:
    """The rows of docs that are mostly in one known language."""
    return identify(docs, fit(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least_share)).select("row.*")
