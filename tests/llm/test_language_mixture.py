import math
import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import language_mixture as lm
from corpusloom.llm.common import Words
from corpusloom.llm.queries import op8_language_mixture

from .fixtures import ODD_TEXTS, empty_documents, odd_documents


def test_op8_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_language_mixture(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 150 and sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_grams_of_words():
    cells, offsets = lm.word_grams(pa.array(["ab", "c"]))
    assert offsets.tolist() == [0, 9, 15]
    again, _ = lm.word_grams(pa.array(["AB"]))
    assert again.tolist() == cells[:9].tolist()


def test_mixture_finds_both_languages(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = lm.fit(docs)
    text = {x: next(t for _, t, lang in rows if lang == x and len(t) > 1500 and "|" not in t) for x in ("en", "de")}
    mixed = " ".join(text["en"].split()[:150] + text["de"].split()[:100])
    share = lm.infer(Words(pa.array([text["en"], mixed, ""])), table)
    en, de = langs.index("en"), langs.index("de")
    assert share[0, en] > 0.97 and (share[0] > 0).sum() == 1
    assert abs(share[1, en] - 0.6) < 0.08 and abs(share[1, de] - 0.4) < 0.08
    assert share[2].sum() == 0
    assert (lm.infer(Words(pa.array([" | 12 -- ".join(text["de"].split())])), table)[0] > 0).sum() == 1


def test_odd_documents(spark):
    model = (["a", "b"], np.zeros((lm.CELLS, 2), np.float32))
    rows = lm.identify(odd_documents(spark), model).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not (r.row.text or "").strip())
    assert all(r.lang_pred == "und" for r in lm.identify(odd_documents(spark), ([], np.zeros((lm.CELLS, 0)))).collect())
    assert lm.keep_identified(empty_documents(spark)).collect() == []
    assert lm.keep_identified(odd_documents(spark)).columns == odd_documents(spark).columns


def brute_mixture(text, table, penalty=1.0, rounds=12):
    """One text by plain loops: EM over its words, then growing language sets."""
    k = table.shape[1]
    words = [w for w in text.split(" ") if any(c.isalpha() for c in w)]
    like = []
    for w in words:
        cells, _ = lm.word_grams(pa.array([w]))
        logs = [sum(float(table[c, j]) for c in cells) / 3 for j in range(k)]
        like.append([math.exp(max(x - max(logs), -60)) for x in logs])

    def climb(share, steps):
        for _ in range(steps):
            posts = [[x * s for x, s in zip(row, share)] for row in like]
            share = [sum(p[j] / sum(p) for p in posts) / len(words) for j in range(k)]
        return share, sum(math.log(sum(x * s for x, s in zip(row, share))) for row in like)

    share, _ = climb([1 / k] * k, rounds)
    ranked = sorted(range(k), key=lambda j: (-share[j], j))
    best = None
    for size in range(1, k + 1):
        start = [max(share[j], 1e-6) if j in ranked[:size] else 0.0 for j in range(k)]
        start = [x / sum(start) for x in start]
        fitted, likelihood = climb(start, 0 if size == 1 else 4)
        value = likelihood - penalty * (size - 1) * math.log(max(len(words), 2))
        if best is not None and value <= best[0]:
            break
        best = value, fitted
    return best[1]


def test_mixture_equals_brute_force_and_ignores_neighbours():
    """Five languages of overlapping letters; texts alone, together and by plain loops give the same proportions."""
    rng = random.Random(7)
    letters = ["abcde", "cdefg", "efghi", "ghijk", "ijkla"]
    table = np.full((lm.CELLS, 5), 0.05)
    for j, own in enumerate(letters):
        words = ["".join(rng.choices(own, k=rng.randint(2, 6))) for _ in range(400)]
        cells, _ = lm.word_grams(pa.array(words))
        table[:, j] += np.bincount(cells, minlength=lm.CELLS)
    table = np.log(table / table.sum(axis=0)).astype(np.float32)
    texts = [" ".join("".join(rng.choices(letters[rng.choice(some)], k=rng.randint(1, 5))) for _ in range(rng.randint(1, 40))) for some in [rng.sample(range(5), rng.randint(1, 4)) for _ in range(150)]]
    together = lm.infer(Words(pa.array(texts)), table)
    for text, row in zip(texts, together, strict=True):
        assert lm.infer(Words(pa.array([text])), table)[0].tolist() == row.tolist()
        assert np.allclose(row, brute_mixture(text, table), atol=1e-9)


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    seen = []
    for parts in (1, 50):
        spread = docs.repartition(parts, "doc_id")
        seen.append(sorted((r.row.doc_id, r.lang_pred, r.score) for r in lm.identify(spread, lm.fit(spread)).collect()))
    assert seen[0] == seen[1]


def test_rows_without_id_and_tied_labels(spark):
    rows = [(None, f"alpha beta {i}", "x") for i in range(40)] + [(None, "alpha beta 1", "x"), (3, "gamma delta", "y"), (3, "gamma delta", "y"), (4, "gamma", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 5 <= lm.training_rows(docs, 20).where("lang = 'x'").count() <= 36
    langs, table = lm.fit(docs)
    assert langs == ["x", "y"]
    same = np.zeros((lm.CELLS, 2), np.float32)
    assert {r.lang_pred for r in lm.identify(docs, (langs, same)).collect()} == {"x"}  # equal proportions: the first label
