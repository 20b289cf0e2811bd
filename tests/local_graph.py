"""Graph algorithms over arcs held by the driver, for graphs of a checked, small size. All are iterative."""

from __future__ import annotations

from collections import defaultdict


def adjacency(arcs: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in arcs:
        out[a].append(b)
    return out


def levels(starts: list[str], arcs: list[tuple[str, str]], depth: int | None) -> list[tuple[str, int, str | None]]:
    """(node, depth, least predecessor at the depth above)."""
    out, seen = adjacency(arcs), dict.fromkeys(starts)
    found = [(s, 0, None) for s in seen]
    frontier, level = sorted(seen), 0
    while frontier and (depth is None or level < depth):
        level += 1
        via: dict[str, str] = {}
        for a in frontier:  # ascending, so the first to reach a node is its least predecessor
            for b in out.get(a, ()):
                if b not in seen:
                    via.setdefault(b, a)
        seen.update(via)
        found += [(b, level, a) for b, a in via.items()]
        frontier = sorted(via)
    return found


def parts(nodes: list[str], arcs: list[tuple[str, str]]) -> dict[str, str]:
    """node -> least node of its weakly connected part."""
    parent = {n: n for n in nodes}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in arcs:
        if a in parent and b in parent:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return {n: root(n) for n in nodes}


def unpeeled(nodes: list[str], arcs: list[tuple[str, str]]) -> list[str]:
    """What remains after removing nodes without incoming arcs repeatedly."""
    known, out = set(nodes), adjacency(arcs)
    degree = dict.fromkeys(nodes, 0)
    for a, b in arcs:
        if a in known and b in known:
            degree[b] += 1
    ready = [n for n, d in degree.items() if not d]
    while ready:
        a = ready.pop()
        known.discard(a)
        for b in out.get(a, ()):
            if b in degree:
                degree[b] -= 1
                if not degree[b]:
                    ready.append(b)
    return sorted(known)


def strong(arcs: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected parts of two nodes or more: finishing order on the graph, then reverse reachability."""
    out, back = adjacency(arcs), adjacency([(b, a) for a, b in arcs])
    done: set[str] = set()
    order: list[str] = []
    for start in sorted({*out, *back}):
        if start in done:
            continue
        done.add(start)
        stack = [(start, iter(out.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            following = next((b for b in rest if b not in done), None)
            if following is None:
                order.append(node)
                stack.pop()
            else:
                done.add(following)
                stack.append((following, iter(out.get(following, ()))))
    taken: set[str] = set()
    found = []
    for start in reversed(order):
        if start in taken:
            continue
        taken.add(start)
        part = [start]
        for a in part:
            for b in back.get(a, ()):
                if b not in taken:
                    taken.add(b)
                    part.append(b)
        if len(part) > 1:
            found.append(sorted(part))
    return found
