"""op11: exhaustive search on small conversations, a plain DP on long ones, SQL on the tables."""

import hashlib
import itertools
import random
import re
from collections import defaultdict
from zlib import crc32

import duckdb

from corpusloom.llm.queries import OP11_SQL, op11_viterbi_repair
from corpusloom.llm.repair import damage, repair, summarize

SCHEMA = "conv_id long, turn long, role string, text string, cost string, gaps int"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """(conv_id, turn, role, text) -> the same after damage, in order, by conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        conversation = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        conversation += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """Least (cost, audit) over every edit of every row and up to two inserts in every gap, and its repaired text."""
    found = faults(rows)
    edits = []
    for (_, role, text), fault in zip(rows, found, strict=True):
        more = 5 if fault == "truncated" else 0
        stay = [] if fault in ("blank", "duplicate") else [("K", more, [(role, text)]), ("R", 1 + more, [("user", text)]), ("R", 1 + more, [("assistant", text)])]
        edits.append([("D", 2, []), *stay])
    gap = [("I" * len(g), 5 * len(g), [(r, "") for r in g]) for g in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user"))]
    slots = [gap]
    for e in edits:
        slots += [e, gap]
    best = None
    for choice in itertools.product(*slots):
        cost = sum(c[1] for c in choice)
        if best is not None and cost > best[0]:
            continue
        turns = [t for c in choice for t in c[2]]
        if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)) or any(not r for r, _ in turns):
            continue
        offer = (cost, "".join(c[0] for c in choice), "\n".join(f"{r}:{t}" for r, t in turns))
        best = offer if best is None else min(best, offer)
    return best


def plain_dp(rows):
    """The automaton with whole audits and texts, and inserts closed to a fixpoint."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def close(layer):
        for _ in range(4):
            for at, (cost, audit, text) in list(layer.items()):
                for to in set(step[at]) - {"s"}:
                    offer = (cost + 5, audit + "I", [*text, names[to] + ":"])
                    layer[to] = min(layer.get(to, offer), offer)
        return layer

    layer = close({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for at, (cost, audit, kept) in layer.items():
            offers = [(at, (cost + 2, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in step[at]:
                    offers.append((step[at][role[:1]], (cost + more, audit + "K", [*kept, f"{role}:{text}"])))
                offers += [(to, (cost + 1 + more, audit + "R", [*kept, f"{names[to]}:{text}"])) for to in set(step[at]) - {"s"}]
            for to, offer in offers:
                new[to] = min(new.get(to, offer), offer)
        layer = close(new)
    cost, audit, kept = min(layer[s] for s in ("", "a") if s in layer)
    return cost, audit, "\n".join(kept)


def expected(rows, solve):
    out = {}
    for conv, turns in damaged(rows).items():
        known = [t for t, _, _ in turns if t is not None]
        found = faults(turns)
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
        cost, audit, text = solve(turns)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_small_conversations_equal_exhaustive_search(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Well?", "So.", "Then!", "cut", " ", None, "Why?\n", "tail. x"]
    rows = [(c, rng.choice([0, 1, 2, 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "admin", "", None]), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(0, 3))]
    rows += [rows[0]] * 2
    want = expected(rows, exhaustive)
    assert got(summarize(damage(conversations(spark, rows)))) == want
    assert len({w[6] for w in want.values()}) > 12


def test_long_conversations_settle_their_audits(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Turn {rng.randint(0, 4000)}{rng.choice(['.', '', '!'])}") for t in range(3000)]
    rows += [(2, t, "user", "Same.") for t in range(1500)]  # all but one are duplicates
    rows += [(3, t, "system", f"{t}") for t in range(1500)]  # nothing is kept
    rows += [(4, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(1500)] + [(5, 0, "user", "word. " * 100_000)]
    assert got(summarize(damage(conversations(spark, rows)))) == expected(rows, plain_dp)


def test_edits_give_the_repaired_conversation(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = defaultdict(list)
    audit = defaultdict(str)
    for r in repair(damage(table)).collect():
        audit[r.conv_id] += r.edit
        if r.edit != "D":
            said[r.conv_id].append((r.role, r.text))
    for conv, row in got(op11_viterbi_repair(spark, sf_dir)).items():
        assert audit[conv] == row[6] and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said[conv]))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said[conv]).encode()).hexdigest() == row[7]


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    frame = op11_viterbi_repair(spark, sf_dir)
    assert sorted(map(tuple, frame.collect())) == sorted(con.sql(f"SELECT {', '.join(frame.columns)} FROM ({OP11_SQL})").fetchall())


def test_empty_table_and_lost_conversation(spark):
    assert summarize(damage(conversations(spark, []))).collect() == []
    gone = next(t for t in range(100) if crc32(f"9:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(summarize(damage(conversations(spark, [(9, gone, "user", "Hi.")])))) == {9: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repair(damage(conversations(spark, [(9, gone, "user", "Hi.")]))).collect() == []
