import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import toxicity as tx
from corpusloom.llm.queries import op6_toxicity_grammar

from .fixtures import ODD_TEXTS, empty_documents, odd_documents


AUTOMATON = tx.compose(tx.FACTORS)


def scores(text):
    kinds = [tx.Model().classify(w) for w in text.split()]
    classes, weights = [], []
    for c, w, e in kinds:
        classes += [c, tx.END] if e else [c]
        weights += [w, 0.0] if e else [w]
    return tx.clause_scores(classes, weights, AUTOMATON)


def test_grammar_of_clauses():
    assert scores("what an idiot.") == [2.0]
    assert scores("you are an idiot.") == [3.0] and scores("idiot you are.") == [3.0]
    assert scores("not an idiot.") == [1.0]
    assert scores("she said that some old man was an idiot.") == [1.0]
    assert scores("kill the lights.") == [] and scores("kill you all.") == [3.0]
    assert scores("fine words. a scum! more. trash") == [2.0, 2.0]
    assert scores("") == []


def brute_clause(classes, weights, factors):
    """The sum over all markings of one word, each weighed by looking at the words around it."""
    total = 0.0
    for i, (c, w) in enumerate(zip(classes, weights)):
        before, behind = classes[max(i - tx.REACH, 0) : i], classes[i + 1 : i + 1 + tx.REACH]
        if c == tx.INSULT or c == tx.THREAT and tx.TARGET in behind:
            total += w * (factors["target"] if tx.TARGET in before + behind else 1) * (factors["negation"] if tx.NEGATION in classes[max(i - tx.NEAR, 0) : i] else 1) * (factors["reported"] if tx.REPORTED in classes[:i] else 1)
    return total


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.floats(0.5, 6)), max_size=14))
def test_automaton_equals_enumerated_paths(words):
    classes, weights = [c for c, _ in words], [w for _, w in words]
    factors = {"target": 1.7, "negation": 0.3, "reported": 0.6}
    want = brute_clause(classes, weights, factors)
    assert sum(tx.clause_scores(classes, weights, tx.compose(factors))) == pytest.approx(want)


def test_factors_are_learnt():
    # 200 marks beside a target, all in toxic rows; 100 reported ones, mostly in clean rows; no negation at all.
    got = tx.learnt_factors({1: [300, 200, 0, 20], 0: [100, 0, 0, 80]})
    assert got["target"] > 2 and got["reported"] < 0.4 and got["negation"] == pytest.approx(0.5)
    assert tx.learnt_factors({}) == pytest.approx(tx.FACTORS)


def test_contexts_count_marks():
    x = tx.Model().contexts(pa.array(["you idiot. not a moron. she said scum, kill you. kill it", "nothing", ""]))
    assert x.tolist() == [[4, 3, 1, 2], [0] * 4, [0] * 4]


def test_op6_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op6_toxicity_grammar(spark, sf_dir).select("doc_id", "held_out", "score", "predicted").collect()
    tested = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in tested) / len(tested)
    caught = [r.predicted for r in tested if labels[r.doc_id] == 1]
    assert right > 0.97 and sum(caught) > 0.85 * len(caught)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_documents(spark):
    rows = tx.score_documents(odd_documents(spark), tx.Model()).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    assert rows[0].score == rows[1].score < 0.5
    assert tx.score_documents(empty_documents(spark), tx.Model()).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.learn(odd_documents(spark), labels).words == {}


def test_features_follow_lines_and_punctuation():
    x = tx.Model().features(pa.array(["you idiot\nyou moron, you scum. fine", "fine", ""]))
    assert x[0, 0] > x[0, 2] > 0 and x[1].tolist() == [0, 0, 0] == x[2].tolist()
