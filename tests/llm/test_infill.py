"""op12 against a direct computation, and against SQL."""

import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from corpusloom.llm.infill import infill, restore
from corpusloom.llm.queries import OP12_SQL, op12_relational_infill

from .fixtures import ODD_TEXTS, empty_documents, odd_documents


def brute(doc_id, text, plain_from=90, spm_below=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_from:
        return doc_id, text, n, "plain", None, None, text
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "spm" if h[3] % 100 < spm_below else "psm"
    return doc_id, text, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def rows(frame):
    return sorted(map(repr, map(tuple, frame.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output").collect())))


def test_odd_texts_equal_brute_force(spark):
    more = ["<P> control", "a<S>b", "x <M", "<<P", "S><S", "M>M>", "<P", "P><", "\n", "😀a😀", "a" * 70_000, "b c! " * 40_000, "<S" * 30, "<M" * 30]
    docs = odd_documents(spark).union(spark.createDataFrame([(1000 + 100 * k + j, t, None, None, 0, None, None) for k, t in enumerate(more) for j in range(12)], odd_documents(spark).schema))
    listed = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = infill(docs).cache()
    assert rows(out) == sorted(repr(brute(*d)) for d in listed)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    assert out.where(restore(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert len(listed) > len(ODD_TEXTS)


def test_repeated_rows_and_rates(spark):
    docs = spark.createDataFrame([(7, "one two three", "t")] * 5000 + [(None, "one two three", "t")] * 3 + [(7, "other", "t")], "doc_id long, text string, t string")
    out = infill(docs, plain_from=101, spm_below=100)
    assert rows(out) == sorted(repr(brute(*d, 101, 100)) for d in [(7, "one two three")] * 5000 + [(None, "one two three")] * 3 + [(7, "other")])
    assert infill(empty_documents(spark)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    frame = op12_relational_infill(spark, sf_dir)
    assert sorted(map(repr, map(tuple, frame.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(frame.columns)} FROM ({OP12_SQL})").fetchall()))


def test_texts_move_once(spark, sf_dir):
    frame = op12_relational_infill(spark, sf_dir)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 1
