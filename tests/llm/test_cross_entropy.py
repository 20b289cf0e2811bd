import math
from collections import Counter

import pyarrow as pa
import pytest

from corpusloom.llm import cross_entropy as ce
from corpusloom.llm.queries import op5_cross_entropy

from .fixtures import ODD_TEXTS, empty_documents, odd_documents


def vocabulary(docs):
    """The size as it is estimated: distinct words in one slice of the hashes' range."""
    words = sorted({w for _, t in docs for w in (t or "").encode().split()})
    hashes = ce.stable_hashes(pa.array(words, pa.binary())) if words else []
    return ce.SLICES * sum(int(h) < 2**64 // ce.SLICES for h in hashes)


def brute(docs, target):
    """Losses of each document under models of all other documents, with exact counts."""
    out, models, size = {}, [], max(vocabulary(docs), 1)
    for chosen in ([t for i, t in docs if i in target], [t for _, t in docs]):
        single, pairs, texts = Counter(), Counter(), 0
        for t in chosen:
            w = (t or "").encode().split()
            single.update(w)
            pairs.update(zip([None, *w], w, strict=False))
            texts += bool(w)
        models.append((single, pairs, texts))
    scale = sum(models[0][0].values()) / max(sum(models[1][0].values()), 1)
    for i, t in docs:
        w = (t or "").encode().split()
        own, own_pairs = Counter(w), Counter(zip([None, *w], w, strict=False))
        losses = []
        for (single, pairs, texts), s, seen in zip(models, (1, scale), (i in target, True), strict=True):
            total, m = (sum(single.values()) - len(w) * seen) * s, ce.SMOOTHING
            loss = 0
            for v, x in zip([None, *w], w, strict=False):
                before = (texts - seen if v is None else single[v] - own[v] * seen) * s
                p = ((single[x] - own[x] * seen) * s + m / size) / (total + m)
                loss -= math.log(((pairs[v, x] - own_pairs[v, x] * seen) * s + m * p) / (before + m))
            losses.append(loss / max(len(w), 1))
        out[i] = (len(w), *losses, losses[1] - losses[0]) if w else (0, None, None, None)
    return out


def test_losses_equal_brute_force(spark):
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "stocks fell and stocks rose"), (4, None), (5, "the cat sat on the mat"), (6, "zebra")]
    labels = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    rows = {r.doc_id: tuple(r)[1:] for r in ce.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), labels).collect()}
    for i, want in brute(docs, {1, 2}).items():
        assert rows[i] == pytest.approx(want, rel=1e-4) if want[0] else rows[i] == want
    assert rows[1][3] > rows[3][3]


def test_a_target_does_not_profit_from_itself(spark):
    """A target unlike all other targets scores like the same text outside the target would."""
    docs = [(i, f"the cat number{i} sat on the mat") for i in range(20)] + [(20, "stocks fell and bonds rose"), (21, "stocks fell and bonds rose too")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    inside = {r.doc_id: r.target_loss for r in ce.score_documents(frame, spark.createDataFrame([(i,) for i in [*range(10), 20]], "doc_id long")).collect()}
    outside = {r.doc_id: r.target_loss for r in ce.score_documents(frame, spark.createDataFrame([(i,) for i in range(10)], "doc_id long")).collect()}
    assert inside[20] == pytest.approx(outside[20], rel=0.01) and inside[21] < outside[21]


def test_op5_covers_all_rows(spark, sf_dir):
    rows = op5_cross_entropy(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.target_loss > 0 and abs(r.background_loss - r.target_loss - r.score) < 1e-9 for r in rows if r.n_words)


def test_odd_documents(spark):
    rows = ce.score_documents(odd_documents(spark), spark.createDataFrame([(5,)], "doc_id long")).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert all((r.score is None) == (r.n_words == 0) for r in rows)
    assert ce.score_documents(empty_documents(spark), spark.createDataFrame([], "doc_id long")).collect() == []


def test_counts_stay_exact_beyond_the_former_cells(spark, monkeypatch):
    """300,000 distinct words and their pairs, more than 2^18 cells, in several blocks and ranges."""
    monkeypatch.setattr(ce, "RANGE_WORDS", 1 << 16)
    docs = [(i, " ".join(f"w{i * 1000 + k}" for k in range(1000))) for i in range(300)] + [(300, "w5 w7 w5 w299999"), (301, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = {r.doc_id: tuple(r)[1:] for r in ce.score_documents(df, spark.createDataFrame([(0,), (300,)], "doc_id long")).collect()}
    assert len(rows) == len(docs)
    for i, want in brute(docs, {0, 300}).items():
        assert rows[i] == pytest.approx(want, rel=1e-9, abs=1e-7) if want[0] else rows[i] == want


def test_op5_counts_the_whole_vocabulary(spark, tmp_path, monkeypatch):
    """Few words, none of which need lie in the slice that the estimate counts: the query must use their true number."""
    docs = [(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "stocks fell and stocks rose"), (4, None), (5, "the cat sat on the mat"), (6, "zebra")]
    words = {w for _, t in docs for w in (t or "").split()}
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert vocabulary(docs) != len(words)
    monkeypatch.setitem(globals(), "vocabulary", lambda docs: len(words))
    rows = {r.doc_id: tuple(r)[1:] for r in op5_cross_entropy(spark, str(tmp_path)).collect()}
    for i, want in brute(docs, {1, 2}).items():
        assert rows[i] == pytest.approx(want, rel=1e-9) if want[0] else rows[i] == want


def test_distinct_words_by_ranges(spark):
    """More ranges than words, several blocks, and no words at all."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 7 + k}" for k in range(10)), False) for i in range(50)], "doc_id long, text string, target boolean").repartition(3)
    made = ce.blocks(docs)
    assert [ce.distinct_words(made, r) for r in (1, 7, 1000)] == [49 * 7 + 10] * 3
    assert ce.distinct_words(ce.blocks(docs.where("false")), 3) == 0
    assert ce.distinct_words(ce.blocks(docs.withColumn("text", docs.text.substr(1, 0))), 3) == 0
