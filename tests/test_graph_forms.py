"""Graph operators against plain Python."""

import random

import pytest

from corpusloom.operators import graph as g

from . import local_graph


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(4)
    names = [f"n{k:02d}" for k in range(40)]
    arcs = [(rng.choice(names), rng.choice(names), "link") for _ in range(46)]
    return spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame([a for a in arcs if a[0] != a[1]], "src string, dst string, type string")


def test_spark_equals_plain_python(random_graph):
    paths, edges = random_graph
    nodes, arcs = [r.path for r in paths.collect()], sorted({(r.src, r.dst) for r in edges.collect()})
    starts, back = ["n01", "n07"], [(b, a) for a, b in arcs]
    got = lambda df: sorted(map(tuple, df.collect()), key=str)
    some = paths.where("path in ('n01', 'n07')")
    assert got(g.traverse(some, edges).select("path", "depth", "via")) == sorted(local_graph.levels(starts, arcs, None), key=str)
    assert got(g.traverse(some, edges, 2, reverse=True).select("path", "depth", "via")) == sorted(local_graph.levels(starts, back, 2), key=str)
    assert dict(got(g.components(paths, edges).select("path", "component"))) == local_graph.parts(nodes, arcs)
    assert [p for (p,) in got(g.peel(edges, paths).select("path"))] == local_graph.unpeeled(nodes, arcs)
    assert got(g.strong_components(paths, edges).select("path", "scc")) == sorted((n, part[0]) for part in local_graph.strong(arcs) for n in part)
    levels = dict(got(g.topological_levels(paths, edges).select("path", "level")))
    assert sorted(set(nodes) - set(levels)) == local_graph.unpeeled(nodes, arcs)
    assert all(levels[b] == max(levels[a] for a, t in arcs if t == b) + 1 if any(t == b for _, t in arcs) else levels[b] == 0 for b in levels)


def backtracking(out):
    """The first closed simple path by a search that takes steps back."""
    path, choice = [0], [iter(out[0])]
    while True:
        following = next(choice[-1], None)
        if following is None:
            choice.pop()
            path.pop()
        elif following == 0 and len(path) > 1:
            return [*path, 0]
        elif following not in path:
            path.append(following)
            choice.append(iter(out[following]))


def test_cycle_paths_equal_a_backtracking_search():
    rng = random.Random(8)
    for _ in range(500):
        n = rng.randint(2, 11)
        ring = rng.sample(range(n), n)
        arcs = set(zip(ring, ring[1:] + ring[:1], strict=True)) | {tuple(rng.sample(range(n), 2)) for _ in range(rng.randint(0, 2 * n))}
        out = [sorted(b for a, b in arcs if a == k) for k in range(n)]
        assert g.cycle_path(out) == backtracking(out)


def test_a_search_that_would_take_exponential_time():
    """Every step leads into a dense part that only its entrance leaves."""
    k = 40
    out = [[1]] + [[*range(2, k + 2), k + 2]] + [sorted({*range(2, k + 2)} - {v} | {1}) for v in range(2, k + 2)] + [[0]]
    assert g.cycle_path(out) == [0, 1, k + 2, 0]


def test_every_part_has_a_walk(spark):
    arcs = [(f"{r}{k}", f"{r}{(k + 1) % 5}") for r in "abc" for k in range(5)] + [("c0", "c3"), ("a0", "b0")]
    paths = spark.createDataFrame([(n,) for n in sorted({x for a in arcs for x in a})], "path string")
    edges = spark.createDataFrame([(*a, "link") for a in arcs], "src string, dst string, type string")
    assert g.cycles(paths, edges) == [[f"{r}{k}" for k in (0, 1, 2, 3, 4, 0)] for r in "abc"]
