import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing, simple8b
from corpusloom.llm.byte_tokens import tokenizer
from corpusloom.llm.common import Scratch, forget_encoders
from corpusloom.llm.queries import op2_simple8b, op3_vector_packing, vocabulary

from .fixtures import ODD_TEXTS, empty_documents, odd_documents

PATH = vocabulary("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library_ids(text):
    return tokenizer(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_forgotten_encoder_starts_anew_with_the_same_ids():
    texts = pa.array(["some words and some more", ""])
    before = tokenizer(PATH).encode(texts)
    forget_encoders()
    assert tokenizer.cache_info().currsize == 0
    after = tokenizer(PATH).encode(texts)
    assert all((a == b).all() for a, b in zip(before, after, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**17), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    for block in (7, 1024):
        words, offsets = simple8b.encode_blocks(values, block)
        assert (simple8b.decode_blocks(words, offsets, len(values), block) == values).all()


def test_simple8b_packs_small_values_densely():
    words, _ = simple8b.encode_blocks(np.ones(1020, np.uint64))
    assert len(words) == 17


def test_damaged_file_is_refused():
    data = bytearray(simple8b.pack_file(np.array([1]), np.array([3]), np.array([5, 6, 7])))
    data[70] ^= 1
    with pytest.raises(ValueError):
        simple8b.unpack_file(bytes(data))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8")), max_size=4))
def test_batch_encoder_equals_library(texts):
    ids, offsets = tokenizer(PATH).encode(pa.array([*texts, "tail word, next.\nline"]))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library_ids(t)


def test_token_files_on_odd_documents(spark):
    rows = simple8b.round_trip(spark, odd_documents(spark), PATH, 2).collect()
    assert len(rows) == len(ODD_TEXTS) + 3
    want = sorted([(-1, crc([*library_ids("no id here"), 2]))] + [(i, crc([*library_ids(t), 2])) for i, t in [*enumerate(ODD_TEXTS), (5, ODD_TEXTS[5]), (6, ODD_TEXTS[6])]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start) if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)


def test_token_arrays_read_back(spark):
    scratch = Scratch(spark, "test")
    docs = spark.createDataFrame([(2, "b b"), (1, "a")], "doc_id long, text string")
    files = simple8b.write_tokens(docs, scratch.path("files"), PATH, 2)
    got = {r.doc_id: r.tokens for r in simple8b.read_tokens(files).collect()}
    assert got == {1: [*library_ids("a"), 2], 2: [*library_ids("b b"), 2]}


def test_empty_tables(spark):
    assert simple8b.round_trip(spark, empty_documents(spark), PATH, 2).collect() == []
    assert packing.pack(empty_documents(spark), PATH, 0).collect() == []


def test_op2_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op2_simple8b(spark, sf_dir).collect()}
    at = 0
    for doc_id in sorted(docs):
        ids = [*library_ids(docs[doc_id]), 2]
        assert got[doc_id] == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(docs)


def check_packing(rows, texts, tokens=1024, segments=64):
    """Every id in exactly one piece, sequences gapless and within limits; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, pieces in by_doc.items():
        ids, at = [*library_ids(texts[doc_id]), 0], 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padded = used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tokens and len(pieces) <= segments
        used += at
        padded += at if at & (at - 1) == 0 else tokens
    return padded / used - 1


def test_op3_packs_everything_without_padding(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert check_packing(op3_vector_packing(spark, sf_dir).collect(), texts) < 0.01


def test_packing_odd_documents(spark):
    docs = odd_documents(spark).dropDuplicates(["doc_id"]).na.drop(subset=["doc_id"])
    check_packing(packing.pack(docs, PATH, 0).collect(), dict(enumerate(ODD_TEXTS)))


def test_items_respect_all_limits():
    rng = np.random.default_rng(1)
    limits = np.array([1024.0, 8, 300])
    sizes = np.stack([rng.integers(1, 1024, 500), np.ones(500), rng.integers(0, 300, 500)], axis=1)
    bins = packing.place_items(sizes, limits)
    assert sorted(i for b in bins for i in b) == list(range(500))
    for b in bins:
        assert (sizes[b].sum(axis=0) <= limits).all()
    bound = np.ceil((sizes.sum(axis=0) / limits).max())
    assert len(bins) <= 1.35 * bound


def brute_place(sizes, limits):
    """The dot-product heuristic item by item over plain lists."""
    mean = [sum(row[d] for row in sizes) / len(sizes) / limits[d] for d in range(3)]
    weight = [m / sum(mean) for m in mean]
    order = sorted(range(len(sizes)), key=lambda i: (-round(sum(weight[d] * sizes[i][d] / limits[d] for d in range(3)), 12), i))
    bins, rooms = [], []
    for i in order:
        share = [sizes[i][d] / limits[d] for d in range(3)]
        fit = [k for k, room in enumerate(rooms) if all(room[d] >= share[d] - 1e-12 for d in range(3))]
        if fit:
            k = max(fit, key=lambda k: (round(sum(rooms[k][d] * weight[d] * share[d] for d in range(3)), 12), -k))
        else:
            k = len(bins)
            bins.append([])
            rooms.append([1.0, 1.0, 1.0])
        bins[k].append(i)
        rooms[k] = [r - s for r, s in zip(rooms[k], share, strict=True)]
    return bins


def test_placing_equals_brute_force():
    rng = np.random.default_rng(8)
    for limits in ([1024.0, 8, 300], [1024.0, 3, 1024], [100.0, 50, 20]):
        sizes = np.stack([rng.integers(1, int(limits[0]), 120), np.ones(120), rng.integers(0, int(limits[2]), 120)], axis=1)
        got = packing.place_items(sizes, np.array(limits))
        want = brute_place(sizes.tolist(), limits)
        assert len(got) == len(want) and sum(a == b for a, b in zip(got, want, strict=True)) >= 0.9 * len(want)  # sums may tie to the last bit


def check_bins(bins, length, quiet, limits):
    """Every id of every document once, and no limit broken; tokens, segments and loss of each bin."""
    seen = defaultdict(list)
    sizes = []
    for b in bins:
        for i, s, n in b:
            seen[i] += range(s, s + n)
        sizes.append((sum(n for *_, n in b), len(b), sum(j >= quiet[i] for i, s, n in b for j in range(s, s + n))))
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(length) if n}
    assert all(x <= y for size in sizes for x, y in zip(size, limits, strict=True))
    return sizes


@pytest.mark.parametrize(("limits", "binding"), [([256, 5, 256], 1), ([256, 64, 60], 2), ([256, 64, 256], 0), ([256, 6, 90], None)])
def test_each_limit_binds_by_itself(limits, binding):
    """Segments of very short rows, loss of rows with short prompts, tokens of rows with long ones."""
    rng = np.random.default_rng(3)
    length = rng.integers(1, 30, 400) if binding == 1 else rng.integers(1, 900, 120)
    quiet = np.minimum(length - 1, rng.integers(0, 20, len(length))) if binding == 2 else (length * 0.8).astype(int) if binding == 0 else rng.integers(0, length)
    top = np.array(limits, float)
    made = packing.pieces_of(length, quiet, limits[0], limits[2])
    sizes = np.stack([made[:, 2], np.ones(len(made)), packing.loss_of(made[:, 1], made[:, 2], quiet[made[:, 0]])], axis=1)
    filled = packing.fill_up([[tuple(made[i].tolist()) for i in b] for b in packing.place_items(sizes, top)], top, quiet)
    reached = (np.array(check_bins(filled, length.tolist(), quiet.tolist(), limits)) == top).mean(axis=0)
    if binding is not None:
        assert reached[binding] > 0.6, reached
    sizes = np.array(check_bins(packing.pack_block(length, quiet, top), length.tolist(), quiet.tolist(), limits))
    # Sequences are full, or cut so that they need no padding.
    assert all(t == limits[0] or t & (t - 1) == 0 for t in sizes[:, 0].tolist())


def test_prompts_bear_no_loss(spark):
    talk = [r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()]
    rows = [(n, a.text, b.text) for n, (a, b) in enumerate(zip(talk, talk[1:], strict=False)) if a.conv_id == b.conv_id and a.role != b.role]
    rows += [(1000, None, "answer"), (1001, "question", None), (1002, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, ask string, text string")
    pieces = packing.pack(docs, PATH, 0, tokens=128, segments=4, loss=48, prompt="ask").collect()
    whole = {i: [*library_ids(q), *library_ids(t), 0] for i, q, t in rows}
    quiet = {i: len(library_ids(q)) for i, q, _ in rows}
    bins, seen = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r.ids_crc32 == crc(whole[r.doc_id][r.start : r.start + r.length])
        bins[r.sequence_id].append(r)
        seen[r.doc_id] += range(r.start, r.start + r.length)
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(len(x))) for i, x in whole.items()}
    for b in bins.values():
        loss = sum(j >= quiet[r.doc_id] for r in b for j in range(r.start, r.start + r.length))
        assert sum(r.length for r in b) <= 128 and len(b) <= 4 and loss <= 48


def test_many_short_items_stay_within_segment_limit():
    bins = [[(i, 0, 2)] for i in range(100)]
    filled = packing.fill_up(bins, np.array([1024.0, 8, 1024]), np.zeros(100, int))
    assert sorted((i, s, n) for b in filled for i, s, n in b) and sum(n for b in filled for *_, n in b) == 200
    assert all(len(b) <= 8 for b in filled)
