import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import quality
from corpusloom.llm.queries import op1_robust_outliers

from .fixtures import ODD_TEXTS, empty_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def columns(stats):
    return list(zip(*(stats[k].to_pylist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["a", "b", "c", "\n", " ", "é#", "\x1c", "\x0b"]), max_size=60).map(" ".join)), min_size=1, max_size=6))
def test_statistics_equal_brute_force(texts):
    assert columns(quality.text_stats(pa.array(texts, pa.string()))) == [brute(t) for t in texts]


def test_chi2_points():
    assert abs(quality.chi2_point(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi2_point(0.5, 5) - 4.3515) < 1e-3


def concentrate(x, mean, precision, share):
    """One step: the rows up to the distance bin that reaches h, and their estimate."""
    gap = x - mean
    d2 = np.einsum("ni,ij,nj->n", gap, precision, gap)
    bins = np.clip(np.floor(16 * np.log2(d2 + 1e-9)), -64, 191)
    part = x[bins <= np.sort(bins)[int(np.ceil(len(x) * share)) - 1]]
    cov = np.cov(part.T, bias=True) * quality._consistency(round(len(part) / len(x), 4)) + np.diag(np.square(quality.FLOORS))
    return np.linalg.slogdet(cov)[1], part.mean(axis=0), np.linalg.inv(cov)


def reference_fit(z, share=0.75):
    """The same estimate of one group with numpy: (determinants by start, mean, precision)."""
    x, floors = z / quality.SCALE, np.square(quality.FLOORS)
    grid = np.floor(z / 32)
    at = lambda q: (np.sort(grid, axis=0)[int(np.ceil(len(z) * q)) - 1]) / 32 + 1 / 64
    middle, sd = at(0.5), (at(0.75) - at(0.25)) / 1.349
    u = np.round(np.tanh((x - middle) / np.sqrt(sd**2 + floors)) * quality.SCALE)
    shape = np.corrcoef(u.T)
    found = []
    for mean, cov in ((middle, np.diag(sd**2)), (x.mean(axis=0), np.cov(x.T, bias=True)), (middle, shape * np.outer(sd, sd))):
        best = (np.inf, mean, np.linalg.inv(cov + np.diag(floors)))
        while (new := concentrate(x, *best[1:], share))[0] < best[0] - 1e-9:
            best = new
        found.append(best)
    _, mean, precision = min(found, key=lambda f: f[0])
    gap = x - mean
    part = x[np.einsum("ni,ij,nj->n", gap, precision, gap) <= quality.chi2_point(0.975, 5)]
    return [f[0] for f in found], part.mean(axis=0), np.linalg.inv(np.cov(part.T, bias=True) * quality._consistency(0.975) + np.diag(floors))


def far_cluster(seed, inner, outer):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(0, 1, (5, 5))
    return np.round(np.concatenate([rng.normal(0, 1, (inner, 5)) @ mixing + 3, rng.normal(9, 0.3, (outer, 5))]) * quality.SCALE).astype(int)


def frame(spark, groups):
    rows = [("en", name, *map(int, r)) for name, z in groups.items() for r in z]
    return spark.createDataFrame(rows, "lang string, source string, z0 long, z1 long, z2 long, z3 long, z4 long")


def test_fit_equals_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    plain = np.round(np.concatenate([rng.normal(3, 0.6, (800, 5)), rng.normal(9, 0.3, (150, 5))]) * quality.SCALE).astype(int)
    groups = {"s": plain, "t": far_cluster(1, 700, 150), "u": far_cluster(4, 500, 120)}
    for small in (quality.SMALL, 0):  # by broadcast, and dealt to many tasks
        monkeypatch.setattr(quality, "SMALL", small)
        got = {r["g_source"]: r for r in quality.fit(frame(spark, groups), quality.Scratch(spark, "test")).where("level = 0").collect()}
        for name, z in groups.items():
            _, mean, precision = reference_fit(z)
            assert np.allclose(got[name]["mean"], mean, atol=1e-9) and np.allclose(np.array(got[name]["precision"]).reshape(5, 5), precision, rtol=1e-6)
    assert np.allclose(reference_fit(plain)[1], 3, atol=0.1)  # the far cluster had no influence


def test_starts_differ_and_the_least_determinant_wins():
    """Over many groups no single start always ends with the least determinant."""
    ends = [reference_fit(far_cluster(seed, 120, 45))[0] for seed in range(30)]
    assert len({int(np.argmin(e)) for e in ends if max(e) - min(e) > 1e-6}) > 1


def test_op1_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op1_robust_outliers(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_outlier_is_rejected_and_columns_stay(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["w" + "abcdefghij"[i % 10] * (1 + i % 7) + str(i) for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, 120)), "en", "s", i) for i in range(300)]
    rows.append((900, " ".join(f"{w}&&&" for w in rng.choice(vocabulary, 120)), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, distance long")
    kept = quality.keep_good(docs, min_rows=50)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(300))


def test_odd_documents(spark):
    rows = quality.quality_rows(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert all(r.base_failed for r in rows if (r.n_words or 0) < 50)
    assert quality.quality_rows(empty_documents(spark)).collect() == []
    assert quality.keep_good(empty_documents(spark)).collect() == []
