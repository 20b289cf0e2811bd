"""Deep and awkward graphs against plain Python: contraction must give what level-by-level rounds give."""

import random
import time

import pytest

from corpusloom.operators import contract
from corpusloom.operators import graph as g

from . import local_graph

DEPTH = 1000


def frames(spark, arcs, more=()):
    names = sorted({x for a in arcs for x in a} | set(more))
    return spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame([(*a, "link") for a in arcs], "src string, dst string, type string")


def chain(rng=None):
    names = [f"d{k:03d}.md" for k in range(DEPTH)]
    if rng:
        rng.shuffle(names)
    return names, list(zip(names, names[1:], strict=False))


@pytest.mark.parametrize("shuffled", [True])
def test_chain_and_ring(spark, shuffled):
    names, arcs = chain(random.Random(1) if shuffled else None)
    began = time.time()
    paths, edges = frames(spark, arcs)
    assert dict(map(tuple, g.topological_levels(paths, edges).collect())) == {n: k for k, n in enumerate(names)}
    assert time.time() - began < 60
    began = time.time()
    ring = frames(spark, [*arcs, (names[-1], names[0])])
    assert g.topological_levels(*ring).count() == 0
    assert {(r.path, r.scc) for r in g.strong_components(*ring).collect()} == {(n, min(names)) for n in names}
    assert time.time() - began < 120


def test_deep_traversal(spark):
    names, arcs = chain(random.Random(2))
    arcs += [(names[k], names[k + 40]) for k in range(0, 900, 100)] + [(names[k], names[k - 7]) for k in range(50, 1000, 50)] + [("x0", names[500]), ("x1", "x0")]
    paths, edges = frames(spark, arcs)
    start = paths.where(paths.path == names[3])
    got = lambda df: sorted(map(tuple, df.select("path", "depth", "via").collect()), key=str)
    assert got(g.traverse(start, edges)) == sorted(local_graph.levels([names[3]], sorted(arcs), None), key=str)
    assert got(g.traverse(start, edges, 30)) == sorted(local_graph.levels([names[3]], sorted(arcs), 30), key=str)


@pytest.mark.parametrize("seed", [3, 5])
def test_random_graphs(spark, monkeypatch, seed):
    """Diamonds, trees, cross links and cycles; the traversal contracts from its second level on."""
    monkeypatch.setattr(g, "PLAIN_LEVELS", 1)
    rng = random.Random(seed)
    names = [f"n{k:03d}" for k in range(120)]
    arcs = {(names[k], names[k + rng.randint(1, 3)]) for k in range(110) for _ in range(rng.randint(0, 2))}
    arcs |= {(names[k], names[k - rng.randint(1, 9)]) for k in rng.sample(range(20, 120), seed)}
    paths, edges = frames(spark, sorted(arcs), names)
    levels = dict(map(tuple, g.topological_levels(paths, edges).collect()))
    behind = local_graph.unpeeled(names, sorted(arcs))
    assert sorted(set(names) - set(levels)) == behind
    for n in levels:
        above = [levels[a] for a, b in arcs if b == n]
        assert levels[n] == (max(above) + 1 if above else 0)
    got = sorted(map(tuple, g.traverse(paths.where("path in ('n000', 'n007')"), edges).select("path", "depth", "via").collect()), key=str)
    assert got == sorted(local_graph.levels(["n000", "n007"], sorted(arcs), None), key=str)
    assert sorted(map(tuple, g.strong_components(paths, edges).select("path", "scc").collect())) == sorted((n, part[0]) for part in local_graph.strong(sorted(arcs)) for n in part)


def test_core_of_cycles(spark):
    """No node on a cycle is left out: two rings, trees into and out of them, and a dense part without cycles."""
    rng = random.Random(6)
    arcs = [("a0", "a1"), ("a1", "a2"), ("a2", "a0"), ("b0", "b1"), ("b1", "b0"), ("b1", "a0"), ("b0", "b2"), ("b2", "b1")]
    arcs += [(f"i{k:02d}", f"i{k // 2:02d}") for k in range(1, 60)] + [("i00", "b0"), ("a1", "o00")] + [(f"o{k // 2:02d}", f"o{k:02d}") for k in range(1, 60)]
    arcs += sorted({(f"d{a:02d}", f"d{b:02d}") for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(150))} | {("o07", "d00")})
    core = {r.path for r in contract.cyclic_core(spark.createDataFrame(arcs, "src string, dst string")).collect()}
    assert {"a0", "a1", "a2", "b0", "b1", "b2"} <= core


@pytest.mark.parametrize("tail", [1 << 17, 300])
def test_levels_of_many_predecessors_take_few_turns(spark, monkeypatch, tail):
    """A tree towards its root with arcs that lead up again: nodes have two predecessors or more, and levels go by dozens."""
    turns = []
    keep = contract.Tables.keep
    monkeypatch.setattr(contract.Tables, "keep", lambda self, df, name: (turns.append(name), keep(self, df, name))[1])
    monkeypatch.setattr(contract, "TAIL", tail)
    n = 2000
    pairs = {(i, i // 2) for i in range(1, n)} | {(i, (5 * i + 3) % n) for i in range(1, n, 4)}
    arcs = sorted((f"{a:04d}", f"{b:04d}") for a, b in pairs if a != b)
    paths, edges = frames(spark, arcs, ["lone"])
    got = dict(map(tuple, g.topological_levels(paths, edges).collect()))
    names = sorted({x for a in arcs for x in a} | {"lone"})
    assert sorted(set(names) - set(got)) == local_graph.unpeeled(names, arcs)
    above = {}
    for a, b in arcs:
        above.setdefault(b, []).append(a)
    assert all(got[x] == max((got[a] + 1 for a in above.get(x, ())), default=0) for x in got)
    assert max(got.values()) > 30
    assert len([x for x in turns if x.startswith("single")]) < 24
