import hashlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm.forced_bpe import encode_documents, forced_bpe
from corpusloom.llm.queries import op4_forced_bpe, vocabulary

from .fixtures import ODD_TEXTS, empty_documents, odd_documents

PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", categories=("L", "N", "P", "S", "Z", "Cc")), max_size=40))
def test_equals_library(text):
    got = forced_bpe(PATH).digest(pa.array([text]))
    assert (got["n_tokens"][0].as_py(), got["ids_sha256"][0].as_py(), got["decoded_sha256"][0].as_py()) == expected(text)


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000, "ab" * 100_000, "schön" * 40_000, "0" * 100_000 + " x " + "=" * 100_001):
        got = forced_bpe(PATH).digest(pa.array([text]))
        assert (got["n_tokens"][0].as_py(), got["ids_sha256"][0].as_py(), got["decoded_sha256"][0].as_py()) == expected(text)
    assert all(len(letters) <= 64 for letters, _ in forced_bpe(PATH).fragments)


def test_cuts_never_cross_a_merge():
    bpe = forced_bpe(PATH)
    cut = [w for w in ("schönheit", "qxzjk", "señorñó", "vwqx", "heitlichkeitßä") if len(bpe.cut(w.encode().decode("latin-1").translate(bpe.stand_in))) > 1]
    assert cut


def test_op4_equals_library(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_forced_bpe(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {k: expected(t) for k, t in docs.items()}
    assert len(rows) == len(docs)


def test_odd_documents(spark):
    rows = encode_documents(odd_documents(spark), PATH).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    for r in rows:
        ids = LIBRARY.encode(r.row.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert encode_documents(empty_documents(spark), PATH).collect() == []
