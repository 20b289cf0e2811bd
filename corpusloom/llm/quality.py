"""Quality rules with robust multivariate outliers.

Base statistics of a text (words are runs of characters other than space and U+0009-U+000D): n_words; word_chars, code
points in words; n_symbols, characters of [#*$%&|<>]; n_dup_lines, lines with a word that equal an earlier line of the
text; n_repeat_words, words inside 3-word windows that occur twice or more in the text. base_failed: under 50 words, or
more than half of the words repeat.

Method: the statistics become a vector (log words, log mean word length, log symbols per 100 words, log repeated-line
share, log repeated-word share), rounded to 1/1024. For every (language, source) a minimum-covariance-determinant
estimate is found over all rows that pass the base rules, from three starts: medians with quartile ranges; mean and
covariance of all rows; medians with the correlation of tanh-squashed deviations. Concentration steps take the h rows
nearest by Mahalanobis distance and re-estimate mean and covariance from them, for each start until the determinant of
the covariance falls no more (STEPS steps at most; the estimate of least determinant met counts); the start with the
least determinant wins, and one step reweights. A step is one aggregation by (group, start, distance bin) that carries
counts and moments, so no group is gathered and a hot group costs no more than others; sums are of integers, so a result
does not depend on the order of rows. The h-subset ends at the bin (a sixteenth of an octave) that reaches h, and the
covariance is made consistent for the share it has. A floor is added to each variance, as most texts have no symbols or
repeats at all; determinants are those with the floor. Groups under min_rows rows use their language's estimate, those
of small languages the estimate of all rows; if even all are too few, the method rejects nothing. A row is rejected if
its squared distance exceeds `cutoff`. Ties: rows at one distance share a bin; of equal determinants the first start's.

Estimates go to the rows by broadcast while there are at most SMALL of them (their number is counted), beyond that by a
join in which every group is dealt to many tasks.

Nulls: a null text has no words and fails the base rules; a null lang or source is a group of its own. Repeated rows
count as often as they occur. An empty table gives no row. Other columns are carried, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, Words, annotate, shuffle_parts, sums, text_array

SCALE = 1024
DIMS = 5
#: Standard deviations added in quadrature, by dimension.
FLOORS = (0.5, 0.1, 0.7, 0.7, 0.7)
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
#: Most concentration steps of a start; estimates that are broadcast (about 400 bytes each); tasks a group is dealt to beyond.
STEPS, SMALL, SALTS = 20, 20_000, 64
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_stats(texts: pa.Array) -> dict[str, pa.Array]:
    """The base statistics of texts without nulls."""
    words = Words(texts)
    counts, owner = words.counts, words.owner()
    n = len(counts)
    chars = np.asarray(pc.utf8_length(words.unique), dtype=np.int64)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    line_owner = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    full = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(flat))) > 0
    coded = np.asarray(flat.dictionary_encode().indices, dtype=np.int64)[full]
    line_owner = line_owner[full]
    distinct = np.unique(line_owner * (len(flat) + 1) + coded) // (len(flat) + 1) if n else np.zeros(0, np.int64)
    dup = np.bincount(line_owner, minlength=n) - np.bincount(distinct, minlength=n)
    return {
        "n_words": pa.array(counts), "word_chars": pa.array(sums(chars, words.offsets)), "n_symbols": pc.count_substring_regex(texts, "[#*$%&|<>]").cast(pa.int64()),
        "n_dup_lines": pa.array(dup.astype(np.int64)), "n_repeat_words": pa.array(sums(_repeated(words.codes, owner, len(words.unique)).astype(np.int64), words.offsets)),
    }


def _repeated(codes: np.ndarray, owner: np.ndarray, n_codes: int) -> np.ndarray:
    """For each word, whether it lies in a 3-word window that its text has twice or more."""
    inside = np.zeros(len(codes), dtype=bool)
    if len(codes) < 3:
        return inside
    start = np.flatnonzero(owner[:-2] == owner[2:])
    # Exact keys: pairs are ranked first, so that every product stays within 64 bits.
    pair = np.unique(codes[:-1] * n_codes + codes[1:], return_inverse=True)[1]
    window = np.unique(pair[start] * n_codes + codes[start + 2], return_inverse=True)[1]
    _, place, often = np.unique(owner[start] * (len(start) + 1) + window, return_inverse=True, return_counts=True)
    again = start[often[place] > 1]
    for k in range(3):
        inside[again + k] = True
    return inside


def with_stats(docs: DataFrame) -> DataFrame:
    """`row` (all input columns), the base statistics and base_failed."""
    base = annotate(docs, lambda _, texts: text_stats(text_array(texts)), STATS)
    return base.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log1p(F.col("n_words")), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), F.log1p(100 * F.col("n_symbols") / words),
        F.log1p(100 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words),
    ]
    return [F.round(v * SCALE).cast("long").alias(f"z{k}") for k, v in enumerate(values)]


def _chi2_below(x: float, p: int) -> float:
    """P(chi-square with p degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, t = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > 1e-15 * total:
        k += 1
        term *= t / k
        total += term
    return total * math.exp(-t + a * math.log(t) - math.lgamma(a))


def chi2_point(q: float, p: int) -> float:
    """The value that a chi-square variable stays below with probability q."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_below(middle, p) < q else (low, middle)
    return high


@lru_cache(maxsize=4096)
def _consistency(share: float) -> float:
    """What a covariance of the nearest `share` of normal rows is to be multiplied by."""
    return share / _chi2_below(chi2_point(share, DIMS), DIMS + 2) if share < 1 else 1.0


def _levels(df: DataFrame) -> DataFrame:
    """Each row in three groups: its language and source, its language, all rows."""
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("g_lang"), F.lit(None).cast("string").alias("g_source")),
    )
    return df.select(F.explode(levels).alias("g"), *[f"z{k}" for k in range(DIMS)]).select("g.*", *[f"z{k}" for k in range(DIMS)])


KEYS = ["level", "g_lang", "g_source"]
FIT = "level int, g_lang string, g_source string, start int, n long, mean array<double>, precision array<double>, det double"
MOMENTS = [f"s{k}" for k in range(DIMS)] + [f"q{i}{j}" for i, j in PAIRS]


def _moments(of: list[Column], prefix: str = "") -> list[Column]:
    return [F.sum(of[k]).alias(f"{prefix}s{k}") for k in range(DIMS)] + [F.sum(of[i] * of[j]).alias(f"{prefix}q{i}{j}") for i, j in PAIRS]


def _spread(r, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the r.m rows that moments sum up."""
    count = max(r.m, 1)
    mean = np.array([getattr(r, f"{prefix}s{i}") for i in range(DIMS)], dtype=float) / count
    cov = np.empty((DIMS, DIMS))
    for i, j in PAIRS:
        cov[i, j] = cov[j, i] = getattr(r, f"{prefix}q{i}{j}") / count - mean[i] * mean[j]
    return mean / SCALE, cov / SCALE**2


def _fit_row(r, start: int, mean: np.ndarray, cov: np.ndarray, det: float | None = None) -> tuple:
    cov = cov + np.diag(np.square(FLOORS))
    return (*[getattr(r, k) for k in KEYS], start, r.n, mean.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.slogdet(cov)[1]) if det is None else det)


def _fit_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*KEYS, "start", "n", "mean", "precision", "det"]).astype({"level": "int32", "start": "int32"})


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three first estimates of each group; their determinants do not count."""
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            middle, sd = np.array(r.mid, dtype=float), np.array(r.range, dtype=float) / 1.349
            out.append(_fit_row(r, 0, middle, np.diag(sd**2), math.inf))
            out.append(_fit_row(r, 1, *_spread(r), math.inf))
            squashed = _spread(r, "u")[1]
            scale = np.sqrt(np.maximum(np.diag(squashed), 1e-12))
            out.append(_fit_row(r, 2, middle, np.clip(squashed / np.outer(scale, scale), -1, 1) * np.outer(sd, sd), math.inf))
        yield _fit_frame(out)


def _estimates(share: float | None):
    """An estimate from each row of moments; share: of normal rows that they stand for (None: m of n)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                mean, cov = _spread(r)
                out.append(_fit_row(r, r.start, mean, cov * _consistency(round(min(r.m / r.n, 1.0), 4) if share is None else share)))
            yield _fit_frame(out)

    return run


def _distance() -> Column:
    total = F.lit(0.0)
    gap = [F.col(f"z{k}") / F.lit(float(SCALE)) - F.col("mean")[k] for k in range(DIMS)]
    for i, j in PAIRS:
        total = total + gap[i] * gap[j] * F.col("precision")[i * DIMS + j] * F.lit(1.0 if i == j else 2.0)
    return total


def _meet(rows: DataFrame, fits: DataFrame, on: list[str], how: str, many: int | None = None) -> DataFrame:
    """rows with the columns of fits (a table of known size) whose `on` columns, nulls included, are alike."""
    named = fits.select(*[F.col(k).alias(f"f_{k}") for k in on], *[c for c in fits.columns if c not in on])
    same = F.lit(True)
    for k in on:
        same = same & F.expr(f"{k} <=> f_{k}")
    lost = [f"f_{k}" for k in on]
    if (named.count() if many is None else many) <= SMALL:
        return rows.join(F.broadcast(named), same, how).drop(*lost)
    # One group may hold any share of the rows: rows are dealt by their statistics, and each estimate goes to every share.
    salts = max(SALTS, shuffle_parts(rows.sparkSession))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*[f"z{k}" for k in range(DIMS)]), F.lit(salts)).cast("int"))
    spread = named.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, same & (F.col("salt") == F.col("f_salt")), how).drop("salt", "f_salt", *lost)


def _first(rows: DataFrame) -> DataFrame:
    """KEYS, n, mid and range: medians and quartile ranges of each group, from a histogram on a grid of 1/32."""
    grid = rows.select(*KEYS, F.posexplode(F.array(*[F.floor(F.col(f"z{k}") / 32) for k in range(DIMS)])).alias("dim", "bin")).groupBy(*KEYS, "dim", "bin").agg(F.count("*").alias("c"))
    order = W.partitionBy(*KEYS, "dim").orderBy("bin")
    ranked = grid.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(W.partitionBy(*KEYS, "dim")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("bin"))) / 32.0 + 1 / 64
    by_dim = ranked.groupBy(*KEYS, "dim").agg(F.max("n").alias("n"), at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("range"))
    listed = F.array_sort(F.collect_list(F.struct("dim", "mid", "range")))
    return by_dim.groupBy(*KEYS).agg(F.max("n").alias("n"), listed.alias("d")).select(F.col("level").cast("int").alias("level"), "g_lang", "g_source", "n", F.transform("d", lambda d: d["mid"]).alias("mid"), F.transform("d", lambda d: d["range"]).alias("range"))


def fit(stats: DataFrame, scratch: Scratch, share: float = 0.75, steps: int = STEPS) -> DataFrame:
    """Robust mean and precision for each group; stats: lang, source, z0..z4 of the rows to fit."""
    rows = scratch.keep(_levels(stats), "levels")
    first = scratch.keep(_first(rows), "first")
    z = [F.col(f"z{k}") for k in range(DIMS)]
    u = [F.round(F.tanh((z[k] / F.lit(float(SCALE)) - F.col("mid")[k]) / F.sqrt(F.pow(F.col("range")[k] / 1.349, F.lit(2.0)) + FLOORS[k] ** 2)) * SCALE).cast("long") for k in range(DIMS)]
    summed = _meet(rows, first.drop("n"), KEYS, "inner").groupBy(*KEYS).agg(F.count("*").alias("m"), F.max("mid").alias("mid"), F.max("range").alias("range"), *_moments(z), *_moments(u, "u")).withColumn("n", F.col("m"))
    found = scratch.keep(summed.mapInPandas(_starts, FIT).withColumn("done", F.lit(False)), "fit0")
    group, start = W.partitionBy(*KEYS), W.partitionBy(*KEYS, "start")
    for step in range(1, steps + 1):
        joined = _meet(rows, found.where("not done").select(*KEYS, "start", "mean", "precision"), KEYS, "inner")
        binned = F.least(F.greatest(F.floor(16 * F.log2(_distance() + 1e-9)), F.lit(-64)), F.lit(191)).cast("int")
        bins = joined.withColumn("bin", binned).groupBy(*KEYS, "start", "bin").agg(F.count("*").alias("c"), *_moments(z))
        bins = bins.withColumn("n", F.sum("c").over(start)).withColumn("before", F.sum("c").over(start.orderBy("bin")) - F.col("c")).where(F.col("before") < F.ceil(F.col("n") * share))
        new = bins.groupBy(*KEYS, "start").agg(F.max("n").alias("n"), F.sum("c").alias("m"), *[F.sum(x).alias(x) for x in MOMENTS]).mapInPandas(_estimates(None), FIT)
        new = new.select(*KEYS, "start", F.struct("mean", "precision", "det").alias("new"))
        same = F.lit(True)
        for k in [*KEYS, "start"]:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        better = F.coalesce(F.col("new.det") < F.col("det") - 1e-9, F.lit(False))
        either = [F.when(better, F.col(f"new.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("mean", "precision", "det")]
        found = scratch.keep(found.alias("a").join(new.alias("b"), same, "left").select(*[F.col(f"a.{k}").alias(k) for k in [*KEYS, "start", "n"]], *either, (~better).alias("done")), f"fit{step}")
        scratch.drop(f"fit{step - 1}")
        if found.where("not done").isEmpty():
            break
    best = found.groupBy(*KEYS).agg(F.min_by(F.struct("start", "mean", "precision"), F.struct("det", "start")).alias("b")).select(*KEYS, "b.*")
    joined = _meet(rows, scratch.keep(best, "best"), KEYS, "inner")
    # Reweighting only asks whether a row lies within the 0.975 point.
    bins = joined.withColumn("bin", F.when(_distance() <= chi2_point(0.975, DIMS), 0).otherwise(1)).groupBy(*KEYS, "start", "bin").agg(F.count("*").alias("c"), *_moments(z))
    bins = bins.withColumn("n", F.sum("c").over(group)).withColumn("least", F.min("bin").over(group)).where("bin = least")
    out = scratch.keep(bins.groupBy(*KEYS, "start").agg(F.max("n").alias("n"), F.sum("c").alias("m"), *[F.sum(x).alias(x) for x in MOMENTS]).mapInPandas(_estimates(0.975), FIT), "fit")
    scratch.drop("levels", "first", f"fit{step}", "best")
    return out


def judge(annotated: DataFrame, fits: DataFrame, cutoff: float, min_rows: int) -> DataFrame:
    """annotated (lang, source, statistics) with distance (null if base_failed or not judged) and kept."""
    df = annotated.select("*", *_vector())
    for level, on in ((0, ["lang", "source"]), (1, ["lang"]), (2, [])):
        own = fits.where((F.col("level") == level) & (F.col("n") >= min_rows)).select(F.col("g_lang").alias("lang"), F.col("g_source").alias("source"), F.struct("mean", "precision").alias(f"f{level}"))
        df = _meet(df, own.select(*on, f"f{level}"), on, "left")
    df = df.withColumn("f", F.coalesce("f0", "f1", "f2")).withColumn("mean", F.col("f.mean")).withColumn("precision", F.col("f.precision"))
    df = df.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)
    return df.withColumn("kept", kept).drop("f0", "f1", "f2", "f", "mean", "precision", *[f"z{k}" for k in range(DIMS)])


#: The 0.9999 point of the chi-square distribution with DIMS degrees of freedom.
CUTOFF = chi2_point(0.9999, DIMS)
MIN_ROWS = 200


def quality_rows(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed, distance and kept of every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    small = with_stats(docs.select("doc_id", "lang", "source", "text")).select("row.doc_id", "row.lang", "row.source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    stats = scratch.keep(small, "stats")
    fits = fit(stats.where(~F.col("base_failed")).select("lang", "source", *_vector()), scratch)
    return judge(stats, fits, cutoff, min_rows)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of docs that are kept, with their own columns. The texts are read twice rather than shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = scratch.keep(with_stats(docs.select("doc_id", "lang", "source", "text")).select("row.lang", "row.source", *columns), "stats")
    fits = fit(stats.where(~F.col("base_failed")).select("lang", "source", *_vector()), scratch)
    judged = judge(with_stats(docs).select("row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), *columns), fits, cutoff, min_rows)
    return judged.where("kept").select("row.*")
