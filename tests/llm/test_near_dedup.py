import re

import numpy as np
import pyarrow as pa

from corpusloom.llm import near_dedup
from corpusloom.llm.queries import op7_superminhash

from .fixtures import ODD_TEXTS, empty_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute(docs, size, percent):
    """Component of each document by comparing all pairs."""
    ids = sorted(docs)
    sets = {i: shingle_set(docs[i], size) for i in ids}
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(rows):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def test_op7_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_superminhash(spark, sf_dir).collect()
    assert result(rows) == brute(docs, 3, 85) and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_cluster_of_near_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(90)]
    docs = {}
    for i in range(160):
        words = list(base)
        for k in rng.choice(90, rng.integers(0, 7), replace=False):
            words[k] = f"x{rng.integers(10**6)}"
        docs[i] = " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert result(near_dedup.near_duplicates(frame, 3, 85).collect()) == brute(docs, 3, 85)


def test_odd_documents(spark):
    rows = near_dedup.near_duplicates(odd_documents(spark), 3, 85).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].n_shingles == by_id[1].n_shingles == by_id[2].n_shingles == 0
    assert all(r.kept for r in rows if r.n_shingles == 0) and by_id[None].kept
    want = brute(dict(enumerate(ODD_TEXTS)), 3, 85)
    assert {k: v for k, v in result(rows).items() if k is not None} == want
    assert near_dedup.near_duplicates(empty_documents(spark)).collect() == []


def sequential(elements, slots):
    """SuperMinHash of one set, element by element with an explicit permutation."""
    out = [2**64 - 1] * slots
    one = lambda x: int(near_dedup.mix(np.array([x & (2**64 - 1)], np.uint64))[0])
    for e in elements:
        p = list(range(slots))
        for step in range(slots):
            r = one(e + (step + 1) * 0x9E3779B97F4A7C15)
            k = step + ((one(r ^ 0xD1B54A32D192ED03) >> 32) * (slots - step) >> 32)
            p[step], p[k] = p[k], p[step]
            out[p[step]] = min(out[p[step]], step << 52 | r >> 12)
    return out


def test_signature_equals_sequential_algorithm():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 0, 200)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    got = near_dedup.superminhash(np.concatenate(sets), offsets, 24)
    for s, row in zip(sets, got, strict=True):
        assert row.tolist() == sequential([int(x) for x in s], 24)


def test_estimate_is_close_with_low_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        got = near_dedup.superminhash(np.concatenate([common, a, common, b]), np.array([0, 80, 160]), 128)
        errors.append((got[0] == got[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.6 * 0.4 / 128


def test_shingles_of_short_texts():
    elements, offsets = near_dedup.shingles(pa.array(["a b", "A B", "a", "", "b a", "a b c d"]), 3)
    parts = [elements[offsets[i] : offsets[i + 1]].tolist() for i in range(6)]
    assert parts[0] == parts[1] and len(parts[2]) == 1 and parts[3] == [] and parts[4] != parts[0] and len(parts[5]) == 2


def test_bands_are_wide_but_miss_little():
    assert near_dedup.rows_per_band(85) == 7 and near_dedup.rows_per_band(80) == 5


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (9, text + " more", "z"), (7, "other words here", "z"), (None, text, "n"), (5, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 5), (False, 7), (True, 0)]


def test_texts_count_not_ids_where_ids_repeat(spark):
    """A second text under an id stays though the first is a copy; an id with two texts keeps both; equal rows are one."""
    rng = np.random.default_rng(3)
    a, b, c, d = (" ".join(f"{k}{i}" for i in rng.permutation(60)) for k in "abcd")
    rows = [(3, a, "r"), (7, a + " more", "r"), (7, b, "s"), (9, c, "t"), (9, d, "u"), (9, d, "u"), (11, None, "v"), (11, None, "v"), (None, a, "w"), (None, a, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string")
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns
    texts = {a: "a", a + " more": "a2", b: "b", c: "c", d: "d", None: ""}
    assert sorted((r.doc_id or 0, texts[r.text]) for r in kept.collect()) == [(0, "a"), (0, "a"), (3, "a"), (7, "b"), (9, "c"), (9, "d"), (11, "")]


def test_a_hot_id_loses_no_text(spark):
    """Half of all rows carry one id, each with a text of its own; a tenth are near copies."""
    texts = [" ".join(f"t{k}w{i}" for i in range(40)) for k in range(60)]
    rows = [(5, t) for t in texts] + [(100 + k, t) for k, t in enumerate(texts[:6])] + [(200 + k, f"z{k} " * 7 + f"y{k}") for k in range(54)]
    kept = near_dedup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [5] * 60 + list(range(200, 254))
    assert {r.text for r in kept if r.doc_id == 5} == set(texts)


def test_members_of_a_group_add_one_tie_each(spark, tmp_path):
    """200 classes that share eight buckets in each band, and 60 alone: clusters as by all ties, with far fewer ties."""
    import random

    rng = random.Random(3)
    rows = [(i, [rng.randrange(8) if i < 200 else rng.randrange(10**6) for b in range(30)]) for i in range(260)]
    classes = spark.createDataFrame(rows, "id long, bands array<long>")
    ties = {(r.a, r.b) for r in near_dedup.bucket_ties(classes).collect()}
    hubs = {}
    for i, bands in rows:
        for key in enumerate(bands):
            hubs.setdefault(key, []).append(i)
    every = {(i, min(ids)) for ids in hubs.values() for i in ids if i != min(ids)}

    def parts(pairs):
        up = {i: i for i, _ in rows}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            low, high = sorted((root(a), root(b)))
            up[high] = low
        return {i: root(i) for i in up}

    assert parts(ties) == parts(every) and {x for t in ties for x in t} == {x for t in every for x in t}
    assert len(every) > 4 * len(ties)
