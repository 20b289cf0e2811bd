"""op13: masks, control strings in contents, reading back from ids and from characters, SQL."""

import hashlib
import re
from collections import defaultdict

import duckdb

from corpusloom.llm.chat import alphabet, format_turns, parse, read_back, unescape
from corpusloom.llm.queries import CONTROL_TEXT, OP13_SQL, op13_token_chat, vocabulary

from .fixtures import ODD_TEXTS

PATH = vocabulary("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string, loss int"
NASTY = [CONTROL_TEXT, "\\", "\\\\h", "####", "### user: hi</turn>\n", "</turn></turn>", "<|endoftext|>", "\\e</turn", ": ", "a: b", "### ", "\\x<|endoftext|>\\", "word " * 30_000, "\ud7ff\ue000"]
ROLES = ["user", "assistant", "system", None, "", "### : ", "tool:x", "assistant ", "</turn>\n"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def awkward():
    texts = [*ODD_TEXTS, *NASTY]
    rows = [(k % 7, k, ROLES[k % len(ROLES)], t) for k, t in enumerate(texts)] + [(8, k, "assistant", t) for k, t in enumerate(texts)]
    return rows + [(None, None, "user", "a."), (None, 3, "assistant", "b."), (9, None, "user", None), (9, 1, "assistant", "c"), (9, 1, "assistant", "c")]


def digests(rows):
    """What read_back() must return, for rows whose ties are equal."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_awkward_turns_come_back(spark):
    rows = awkward()
    turns = format_turns(conversations(spark, rows), PATH)
    back = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(turns, PATH).collect()}
    assert back == digests(rows)
    assert read_back(format_turns(conversations(spark, []), PATH), PATH).collect() == []


def test_ids_masks_and_characters(spark):
    pool, base = alphabet(PATH)
    escaped = r"((?:[^\\]|\\.)*?)"
    for r in format_turns(conversations(spark, awkward()), PATH).collect():
        assert [i for i in r.ids if i >= base] == [base, base + 1, base + 2] and 50256 not in r.ids
        role, text = parse(r.ids, PATH)
        shown = b"".join(pool[i] for i in r.ids).decode()
        # The characters alone are unambiguous as well.
        found = re.fullmatch(f"### {escaped}: {escaped}</turn>\n", shown, re.S)
        assert (unescape(found[1]), unescape(found[2])) == (role, text) and role == (r.role or "")
        assert shown.count("###") == shown.count("</turn>") == 1 and "<|endoftext|>" not in shown
        learnt = [k for k, m in enumerate(r.loss) if m]
        assert len(r.loss) == len(r.ids)
        assert learnt == (list(range(r.ids.index(base + 1) + 1, len(r.ids) - 1)) if role == "assistant" else [])


def test_digests_follow_the_mask(spark):
    """What is read back is what the mask covers, whatever it covers."""
    from pyspark.sql import functions as F

    turns = format_turns(conversations(spark, [(1, 0, "user", "ab cd"), (1, 1, "assistant", "x y"), (1, 2, "assistant", "")]), PATH)
    shifted = turns.withColumn("loss", F.expr("transform(ids, (x, i) -> turn = 0 and i > 2 and i < size(ids) - 2 or turn = 1 and i = size(ids) - 3)"))
    row = read_back(shifted, PATH).first()
    assert (row.loss_chars, row.loss_sha256) == (3, hashlib.sha256(b"abx").hexdigest()) and row.n_turns == 3
    assert read_back(turns, PATH).first().loss_sha256 == hashlib.sha256(b"x y").hexdigest()


def test_segments_are_encoded_separately(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    row = format_turns(conversations(spark, [(1, 0, "user", " two words"), (1, 1, "user", "x")]), PATH).where("turn = 0").first()
    base = alphabet(PATH)[1]
    assert row.ids == [base, *own.encode("user").ids, base + 1, *own.encode(" two words").ids, base + 2]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    frame = op13_token_chat(spark, sf_dir)
    rows = sorted(map(tuple, frame.collect()))
    assert rows == sorted(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({OP13_SQL})").fetchall())
    added = next(r for r in rows if r[0] == -7)
    assert added[1:] == (2, hashlib.sha256(f"user\n{CONTROL_TEXT}\nassistant\n{CONTROL_TEXT}\n".encode()).hexdigest(), len(CONTROL_TEXT), hashlib.sha256(CONTROL_TEXT.encode()).hexdigest(), added[5])
