"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are classed: insult, threat, target (someone addressed), negation, reported speech, or other; punctuation and line
ends end clauses. Five small transducers are composed into one non-deterministic automaton over the product of their
states. A path through it marks one word of the clause, and its weight is the product of what the five emit:

  insult    marks an insult word and emits the word's own weight
  threat    marks a threat word and emits its weight; the path lives on only if a target follows within REACH words
  target    reads the marked words: a factor if a target stands within REACH words before or behind the mark (the
            factor behind is emitted late, when the target is met)
  negation  a factor if a negation stands within NEAR words before the mark
  reported  a factor if a verb of reporting stands before the mark in the clause

A clause's score is the sum of the weights of all accepting paths, by the forward algorithm; clauses, not isolated
words, are what a document's score is made of: log(1 + sum), log(1 + number of scoring clauses) and log(1 + best
clause) enter a logistic model.

What is learnt (from labelled rows that are not held out, at most `sample` expected rows; rows that share LEAST
SuperMinHash slots of their 3-word shingles, as near copies do, are thinned to one): insult words and word beginnings
whose presence marks label 1, found by covering the toxic documents greedily, each with its log ratio as weight; the
threat words' weights and the factors of target, negation and reported speech, as shrunk ratios of how often marks are
in toxic documents; and the logistic model. Seed lists (SEEDS) are fixed; a seed insult's weight is 2 unless learnt
otherwise. Without labelled rows the seeds and default factors and coefficients remain. What reaches the driver (counts
of marks, marks of toxic documents, three features a row) is bounded by the sample.

A null or empty text has no clause and gets the score of an empty one; repeated rows and other columns do not matter;
marks that tie go to whole words, then longer ones, then the greater; an empty table gives no row.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Words, annotate, bounded_batches, mix, text_array
from corpusloom.llm.near_dedup import shingles, superminhash

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORTED, END = range(7)
#: Words within which a target, and a negation, counts.
REACH, NEAR = 3, 2
#: Seed words of each class, by class.
SEEDS = {
    INSULT: "idiot idiots moron morons loser losers scum worthless pathetic stupid trash clown disgusting dumb filth vermin idiota imbécil estúpido basura asqueroso idiote imbécile ordure minable dégoûtant trottel dummkopf abschaum wertlos widerlich".split(),
    THREAT: "kill hurt destroy beat smash murder töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split(),
    TARGET: "you your yours yourself they them he she du dich dir ihr euch sie tu toi vous ils elles tú te ti vosotros ustedes usted ellos".split(),
    NEGATION: "not no never isn't aren't don't won't cannot nicht kein keine nie pas jamais ni nunca jamás tampoco".split(),
    REPORTED: "said says told claimed wrote quoted reported sagte schrieb behauptete dit écrit déclare dijo escribió".split(),
}
#: Rows expected in the sample that is learnt from.
SAMPLE = 12_000
STEMS = (4, 5, 6)
#: Slots that near copies share, and how many marks weigh as much as the default of a factor or weight.
LEAST, SHRINK = 4, 20
#: Default factors of the context transducers.
FACTORS = {"target": 1.5, "negation": 0.5, "reported": 0.5}


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(False))


#: A transducer's arcs: (state, class, marked or not) -> [(next state, factor)]; no arc, no path. State 0 is the start.
Transducer = dict[tuple, list[tuple]]


def _arcs(step) -> Transducer:
    """Follow step(state, class, marked) -> [(next state, factor)] from the start to all states that can be reached."""
    table, known = {}, [("start",)]
    for state in known:
        for c in range(END):
            for marked in (False, True):
                if found := step(state, c, marked):
                    table[state, c, marked] = found
                    known += [t for t, _ in found if t not in known]
    return table


def insult_transducer() -> Transducer:
    def step(state, c, marked):
        if state == ("start",):
            return [(("insult",), 1.0)] if marked and c == INSULT else [] if marked else [(state, 1.0)]
        return [] if marked else [(state, 1.0)]

    return _arcs(step)


def threat_transducer() -> Transducer:
    """A marked threat waits for a target: ("wait", k) has k words left."""

    def step(state, c, marked):
        if state == ("start",):
            return [(("wait", REACH), 1.0)] if marked and c == THREAT else [] if marked else [(state, 1.0)]
        if marked:
            return []
        if state[0] == "wait":
            return [(("threat",), 1.0)] if c == TARGET else [(("wait", state[1] - 1), 1.0)] if state[1] > 1 else []
        return [(state, 1.0)]

    return _arcs(step)


def _before(c: int, reach: int | None, factor: float, behind: int = 0) -> Transducer:
    """A factor if class c stands within `reach` words (None: anywhere) before the mark or, emitted late, `behind` it."""

    def step(state, k, marked):
        left = state[1] if state[0] == "seen" else 0
        if state[0] in ("start", "seen"):
            if marked:
                return [(("done",), factor)] if left else [(("ahead", behind), 1.0)] if behind else [(("done",), 1.0)]
            if k == c:
                return [(("seen", reach or 1), 1.0)]
            left = left if reach is None else left - 1
            return [(("seen", left) if left > 0 else ("start",), 1.0)]
        if marked:
            return []
        if state[0] == "ahead":
            return [(("done",), factor)] if k == c else [(("ahead", state[1] - 1) if state[1] > 1 else ("done",), 1.0)]
        return [(state, 1.0)]

    return _arcs(step)


def compose(factors: dict[str, float]) -> tuple[list[list[list[tuple[int, float, bool]]]], list[bool]]:
    """The five transducers as one: arcs[state][class] = [(next state, factor, whether the word is marked)], accepting."""
    context = [_before(TARGET, REACH, factors["target"], REACH), _before(NEGATION, NEAR, factors["negation"]), _before(REPORTED, None, factors["reported"])]
    marks = [insult_transducer(), threat_transducer()]
    start = (("start",),) * 4
    number, arcs, todo = {start: 0}, [], [start]
    for state in todo:
        rows = []
        for c in range(END):
            found: dict[tuple, float] = defaultdict(float)
            for table in marks:  # insult or threat: whatever either can read
                for marked in (False, True):
                    steps = [table.get((state[0], c, marked), []), *[t.get((s, c, marked), []) for t, s in zip(context, state[1:], strict=True)]]
                    for a, f in steps[0]:
                        if all(steps[1:]):
                            following = (a, *[x[0][0] for x in steps[1:]])
                            # Both read an unmarked start alike: one path, not two.
                            found[following, marked] = f * float(np.prod([x[0][1] for x in steps[1:]]))
            for following, _ in found:
                if following not in number:
                    number[following] = len(number)
                    todo.append(following)
            rows.append([(number[t], f, marked) for (t, marked), f in found.items()])
        arcs.append(rows)
    return arcs, [s[0] in (("insult",), ("threat",)) for s in number]


def clause_scores(classes: list[int], weights: list[float], automaton) -> list[float]:
    """Sum of the weights of all accepting paths, for each clause that has any; weights: those of the words themselves."""
    arcs, accepting = automaton
    out, active = [], {0: 1.0}
    for c, w in zip([*classes, END], [*weights, 0.0], strict=True):
        if c == END:
            if total := sum(v for s, v in active.items() if accepting[s]):
                out.append(total)
            active = {0: 1.0}
            continue
        moved: dict[int, float] = {}
        for s, v in active.items():
            for t, f, marked in arcs[s][c]:
                moved[t] = moved.get(t, 0.0) + v * f * (w if marked else 1.0)
        active = moved
    return out


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    threats: dict[str, float] = field(default_factory=dict)
    factors: dict[str, float] = field(default_factory=lambda: dict(FACTORS))
    #: Intercept and coefficients of the three clause features, for seeds alone.
    weights: tuple[float, ...] = (-3.5, 1.5, 1.0, 1.5)

    def classify(self, word: str) -> tuple[int, float, bool]:
        """Class and weight of a raw word, and whether a clause ends behind it."""
        bare = word.strip(".,;:!?\"'()[]{}«»“”„*#&%$|-").lower()
        ends = word[-1:] in ".;!?:"
        weight = self.words.get(bare, 0.0)
        if not weight and len(bare) > min(STEMS):
            weight = max((self.stems.get(bare[:k], 0.0) for k in STEMS if len(bare) > k), default=0.0)
        if weight > 0:
            return INSULT, weight, ends
        for c in (INSULT, THREAT, TARGET, NEGATION, REPORTED):
            if bare in _SEED_SETS[c]:
                return c, self.threats.get(bare, 2.0) if c == THREAT else 2.0, ends
        return OTHER, 0.0, ends

    def clauses(self, texts: pa.Array):
        """(text's number, classes, weights) of each clause with an insult or a threat. Line ends also end clauses."""
        words = Words(pc.replace_substring(texts, "\n", " \x00 "))
        if not len(words.codes):
            return
        found = [(END, 0.0, False) if w == "\x00" else self.classify(w) for w in words.unique.to_pylist()]
        kind, weight, ends = (np.array(x) for x in zip(*found, strict=True))
        kinds, last = kind[words.codes], ends[words.codes] | (kind[words.codes] == END)
        last[words.offsets[1:][np.diff(words.offsets) > 0] - 1] = True
        clause = np.cumsum(last) - last  # a clause ends with its last word
        hot = np.unique(clause[(kinds == INSULT) | (kinds == THREAT)])
        owner, stops = words.owner(), np.flatnonzero(last)
        begins = np.concatenate([[0], stops[:-1] + 1])
        for a, z in zip(begins[hot].tolist(), (stops[hot] + 1).tolist(), strict=True):
            own = kinds[a:z].tolist()
            if own[-1] == END:
                own.pop()
            yield owner[a], own, weight[words.codes[a : a + len(own)]].tolist()

    def features(self, texts: pa.Array) -> np.ndarray:
        """texts x 3 clause features, for texts without nulls."""
        automaton = compose(self.factors)
        held: dict[int, list[float]] = defaultdict(list)
        for i, classes, weights in self.clauses(texts):
            held[i] += clause_scores(classes, weights, automaton)
        out = np.zeros((len(texts), 3))
        for i, scores in held.items():
            out[i] = np.log1p(sum(scores)), np.log1p(len(scores)), np.log1p(max(scores, default=0.0))
        return out

    def contexts(self, texts: pa.Array) -> np.ndarray:
        """texts x 4: marks that paths accept, and those that each context transducer would weigh."""
        automata = [compose({k: 2.0 if k == name else 1.0 for k in FACTORS}) for name in (None, *FACTORS)]
        out = np.zeros((len(texts), 4))
        for i, classes, _ in self.clauses(texts):
            out[i] += [sum(clause_scores(classes, [1.0] * len(classes), a)) for a in automata]
        out[:, 1:] -= out[:, :1]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


_SEED_SETS = {c: frozenset(w) for c, w in SEEDS.items()}


def _marks(text: str) -> set[str]:
    """Words and word beginnings ('=' and '^' tell them apart) of a text."""
    out = set()
    for w in {x.strip(".,;:!?\"'()[]{}«»“”„*#&%$|-").lower() for x in text.split()}:
        if 3 <= len(w) <= 40:
            out.add("=" + w)
            out.update("^" + w[:k] for k in STEMS if len(w) > k)
    return out


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic and text of a bounded sample of the labelled rows that may be learnt from."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id").select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and coefficients from the bounded sample; counting and feature extraction run on the executors."""
    from corpusloom.llm.common import Scratch

    spark = docs.sparkSession
    bounded_batches(spark)

    def thinned(batches):
        for batch in batches:
            texts = text_array(batch.column(1))
            elements, offsets = shingles(texts, 3)
            slots = superminhash(elements, offsets, LEAST)
            key = np.zeros(len(texts), np.uint64)
            for k in range(LEAST):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + slots[:, k])
            take = pa.array(np.flatnonzero(np.diff(offsets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take).cast(pa.int32()), texts.take(take), pa.array(key.view(np.int64)).take(take)], ["toxic", "text", "least"])

    rows = sample_rows(docs, labels, sample).mapInArrow(thinned, "toxic int, text string, least long")
    # Near copies mostly share the slots: one row of each stands for them.
    rows = Scratch(spark, "toxic").keep(rows.groupBy("least", "toxic").agg(F.min("text").alias("text")), "sample")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    model = Model()
    if bad < 3 or good < 3:
        return model
    least = max(3, bad // 100)

    def emit(batches):
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                marks = sorted(_marks(text))
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array([toxic] * len(marks), pa.int32())], ["mark", "toxic"])

    tally = rows.select("toxic", "text").mapInArrow(emit, "mark string, toxic int").groupBy("mark").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    seeds = [f"={w}" for w in SEEDS[THREAT]]
    # At most 100 marks for each mark that a toxic row of the sample has: every one here stands in a hundredth of them.
    listed = tally.where(((F.col("bad") >= least) & (F.col("good") * bad <= F.col("bad") * good * 0.02)) | F.col("mark").isin(seeds)).collect()
    known = {r["mark"]: (r["bad"], r["good"]) for r in listed}
    for mark in known.keys() & set(seeds):
        b, g = known[mark]
        ratio = np.log((b + 0.5) / (bad + 1)) - np.log((g + 0.5) / (good + 1))
        model.threats[mark[1:]] = float(np.clip(2.0 + (b + g) / (b + g + SHRINK) * (ratio - 2.0), 0.1, 6.0))
    counts = {m: (b, g) for m, (b, g) in known.items() if b >= least and g * bad <= b * good * 0.02}

    def hits(batches):
        for batch in batches:
            listed = [sorted(_marks(t) & counts.keys()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.list_(pa.string()))], ["marks"])

    covers = [r["marks"] for r in rows.where("toxic = 1").select("text").mapInArrow(hits, "marks array<string>").collect()]
    chosen = _cover(covers, counts, least)
    for mark in chosen:
        b, g = counts[mark]
        weight = float(np.clip(np.log((b + 0.5) / (bad + 1)) - np.log((g + 0.5) / (good + 1)), 0.5, 6.0))
        (model.words if mark[0] == "=" else model.stems)[mark[1:]] = weight

    def weigh(batches):
        for batch in batches:
            x = model.contexts(text_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(4))], ["toxic", *names])

    names = ["marks", *FACTORS]
    sums = rows.select("toxic", "text").mapInArrow(weigh, ", ".join(["toxic int", *[f"{n} double" for n in names]])).groupBy("toxic").agg(*[F.sum(n).alias(n) for n in names]).collect()
    model.factors = learnt_factors({r["toxic"]: [r[n] for n in names] for r in sums})

    def measure(batches):
        for batch in batches:
            x = model.features(text_array(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    data = rows.select("toxic", "text").mapInArrow(measure, "toxic int, a double, b double, c double").toPandas().sort_values(["toxic", "a", "b", "c"])
    model.weights = tuple(logistic(data[["a", "b", "c"]].to_numpy(), data["toxic"].to_numpy()))
    return model


def learnt_factors(sums: dict[int, list[float]]) -> dict[str, float]:
    """Factors from the sums of contexts() by label: odds that a mark in the context is in a toxic row, over those of other marks."""
    good, bad = sums.get(0, [0.0] * 4), sums.get(1, [0.0] * 4)
    out = {}
    for k, (name, default) in enumerate(FACTORS.items(), 1):
        inside, outside = np.log((bad[k] + 1) / (good[k] + 1)), np.log((bad[0] - bad[k] + 1) / (good[0] - good[k] + 1))
        often = bad[k] + good[k]
        out[name] = float(np.exp(np.clip(np.log(default) + often / (often + SHRINK) * (inside - outside - np.log(default)), np.log(0.2), np.log(4))))
    return out


def _cover(covers: list[list[str]], counts: dict[str, tuple[int, int]], least: int, times: int = 2) -> list[str]:
    """Greedily choose marks until every toxic document has `times` of them or no mark adds `least` documents."""
    holders: dict[str, list[int]] = {}
    for n, marks in enumerate(covers):
        for m in marks:
            holders.setdefault(m, []).append(n)
    need = np.full(len(covers), times)
    chosen: list[str] = []
    gain = {m: len(h) for m, h in holders.items()}
    while gain:
        # Ties: the longer mark says more; a whole word before a beginning.
        best = max(gain, key=lambda m: (gain[m], m[0] == "=", len(m), m))
        now = int((need[holders[best]] > 0).sum())
        if now < gain[best]:
            gain[best] = now
            if now < least:
                del gain[best]
            continue
        if now < least:
            break
        chosen.append(best)
        need[holders[best]] -= 1
        # What the mark implies (its own beginnings, or words that begin so) adds nothing.
        for m in [m for m in gain if m != best and (m[1:].startswith(best[1:]) or best[1:].startswith(m[1:]))]:
            del gain[m]
        del gain[best]
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Intercept and coefficients by damped Newton steps with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Each row with score (0 to 1) and predicted (score at least 0.5)."""

    def run(_, texts: pa.Array) -> dict[str, pa.Array]:
        score = model.score(model.features(text_array(texts)))
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return annotate(docs, run, "score double, predicted int")
