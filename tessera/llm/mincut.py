"""Minimum cuts of small graphs with two labels, by augmenting along shortest paths (Dinic, 1970)."""

from __future__ import annotations


def min_cut(unary: list[int], edges: list[tuple[int, int, int, int]]) -> list[bool]:
    """Labels that minimise the cost: ``unary[i]`` (positive: label True saves so much) and, for each edge
    (i, j, forth, back), ``forth`` if i is True and j False, ``back`` if it is the other way round. Whole numbers only,
    so the result is exact.

    Nodes whose own cost outweighs all their edges are settled first and passed on to their neighbours;
    that never loses the optimum. What remains is cut by maximum flow from the True to the False terminal.
    """
    n = len(unary)
    cost, near = list(unary), [[] for _ in range(n)]
    for i, j, forth, back in edges:
        if (forth > 0 or back > 0) and i != j:
            near[i].append((j, forth, back))
            near[j].append((i, back, forth))
    held = [[sum(forth for _, forth, _ in x), sum(back for _, _, back in x)] for x in near]  # what being True, or False, can cost at most
    label: list[bool | None] = [None] * n

    def sure(i: int) -> bool:
        return cost[i] >= held[i][0] or -cost[i] >= held[i][1]

    ready = [i for i in range(n) if sure(i)]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        # with a tie between both, neither costs anything
        label[i] = cost[i] > 0 if cost[i] >= held[i][0] and -cost[i] >= held[i][1] else cost[i] >= held[i][0]
        for j, forth, back in near[i]:
            if label[j] is None:
                cost[j] += forth if label[i] else -back
                held[j][0] -= back
                held[j][1] -= forth
                if sure(j):
                    ready.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _flow(rest, cost, near, label)
        for i in rest:
            label[i] = side[i]
    return label  # type: ignore[return-value]


def _flow(rest: list[int], cost: list[int], near: list[list[tuple[int, int, int]]], label: list) -> dict[int, bool]:
    number = {x: k for k, x in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    out: list[list[int]] = [[] for _ in range(t + 1)]
    to: list[int] = []
    cap: list[int] = []

    def add(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for x, k in number.items():
        if cost[x] > 0:
            add(s, k, cost[x], 0)
        elif cost[x] < 0:
            add(k, t, -cost[x], 0)
        for y, forth, back in near[x]:
            if y in number and x < y:
                add(k, number[y], forth, back)
    while True:
        depth = [-1] * (t + 1)
        depth[s] = 0
        queue = [s]
        for a in queue:
            for e in out[a]:
                if cap[e] and depth[to[e]] < 0:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if depth[t] < 0:
            return {x: depth[k] >= 0 for x, k in number.items()}
        at, path, a = [0] * (t + 1), [], s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, a = [], s
                continue
            while at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] and depth[to[e]] == depth[a] + 1:
                    break
                at[a] += 1
            else:
                if a == s:
                    break
                depth[a] = -2
                a = to[path.pop() ^ 1]
                continue
            path.append(out[a][at[a]])
            a = to[path[-1]]
