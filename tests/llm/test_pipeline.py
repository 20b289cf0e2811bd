from collections import defaultdict

import numpy as np

import corpus_pipeline
from corpusloom.llm import language_mixture, quality
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.secrets import find_secrets, redact

from .fixtures import ODD_TEXTS, empty_documents
from .test_near_dedup import brute as near_brute
from .test_tokens import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_equals_brute_force(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: r.text for r in source.collect()}
    good = {r.doc_id for r in quality.quality_rows(source).collect() if r.kept}
    assert 0 < len(good) < len(docs)
    left = source.where(source.doc_id.isin(sorted(good)))
    identified = {r.doc_id for r in language_mixture.identify(left, language_mixture.fit(left)).where("lang_pred <> 'und' and score >= 0.5").select("row.doc_id").collect()}
    assert len(identified) > 0.95 * len(good)
    groups = near_brute({i: docs[i] for i in identified}, 5, 80)
    kept = {i: docs[i] for i, (_, root) in groups.items() if root == i}
    clean = {i: redact(t, find_secrets(t)[1]) for i, t in kept.items()}
    assert check_packing(corpus_pipeline.run(spark, sf_dir).collect(), clean) < 0.01
    assert vocabulary("byte_bpe_50k.json")


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = defaultdict(int)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes, name
        seen[name] = out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_near_dedup", "secret_scans", "sequence_packing"]


def test_odd_and_empty_tables(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns: everything short fails the base rules."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 80)) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t), None, "x") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1, None, "y"), (70, texts[1], None, None, None, "r", "z"), (None, texts[2] + " end", "en", "s", 1, None, "n")]
    rows += [(100 + i, t, None, None, None, None, None) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, kept string")
    pieces = corpus_pipeline.run_on(spark, docs).collect()
    # The copy of text 1 and the repeated row of text 0 went; the row without id stayed by itself.
    assert {p.doc_id for p in pieces if p.doc_id is None or p.doc_id < 100} == {0, 1, 2, 3, 4, 5, None}
    assert sum(p.length for p in pieces if p.doc_id == 0) == next(p.doc_tokens for p in pieces if p.doc_id == 0)
    assert corpus_pipeline.run_on(spark, empty_documents(spark).selectExpr("*", "'x' as row")).collect() == []
