"""Small graphs and plain Python reference solutions for the tests."""

import heapq
import random


def grid(width, height, seed=1, uniform=False, oneway_every=9):
    """Directed edges (u, v, cost) of a grid with pseudo-random costs."""
    rng = random.Random(seed)
    edges = []
    for y in range(height):
        for x in range(width):
            a = y * width + x
            for b, ok in ((a + 1, x + 1 < width), (a + width, y + 1 < height)):
                if ok:
                    cost = 100 if uniform else rng.randint(1, 60)
                    edges.append((a, b, cost))
                    if oneway_every == 0 or a % oneway_every:
                        edges.append((b, a, cost))
    return edges


def adjacency(edges):
    out = {}
    for u, v, c in edges:
        best = out.setdefault(u, {})
        out.setdefault(v, {})
        if u != v:
            best[v] = min(c, best.get(v, c))
    return out


def labels(edges, source):
    """(cost, hops, smallest predecessor) of every node reached from source."""
    out = adjacency(edges)
    best = {source: (0, 0)}
    queue = [(0, 0, source)]
    while queue:
        c, h, u = heapq.heappop(queue)
        if (c, h) > best[u]:
            continue
        for v, w in out.get(u, {}).items():
            if (c + w, h + 1) < best.get(v, (1 << 60, 0)):
                best[v] = (c + w, h + 1)
                heapq.heappush(queue, (c + w, h + 1, v))
    prev = {source: None}
    for v, (c, h) in best.items():
        if v != source:
            prev[v] = min(u for u in best if v in out[u] and (best[u][0] + out[u][v], best[u][1] + 1) == (c, h))
    return {v: (c, h, prev[v]) for v, (c, h) in best.items()}


def walk(tree, target):
    path = [target]
    while tree[path[-1]][2] is not None:
        path.append(tree[path[-1]][2])
    return path[::-1]


def pair_betweenness(edges):
    """Edge and node credit by the pair formula, independent of dependency sums."""
    out = adjacency(edges)
    nodes = sorted(out)
    dist = {s: {v: l[0] for v, l in labels(edges, s).items()} for s in nodes}
    sigma = {}
    for s in nodes:
        count = {s: 1.0}
        for v in sorted(dist[s], key=dist[s].get):
            if v != s:
                count[v] = sum(
                    count[u] for u in dist[s] if v in out[u] and dist[s][u] + out[u][v] == dist[s][v]
                )
        sigma[s] = count
    edge, node = {}, {}
    for s in nodes:
        for t in dist[s]:
            if s == t:
                continue
            for u in dist[s]:
                for v, w in out[u].items():
                    if t in dist[v] and dist[s][u] + w + dist[v][t] == dist[s][t]:
                        share = sigma[s][u] * sigma[v][t] / sigma[s][t]
                        edge[u, v] = edge.get((u, v), 0.0) + share
                if u not in (s, t) and t in dist[u] and dist[s][u] + dist[u][t] == dist[s][t]:
                    node[u] = node.get(u, 0.0) + sigma[s][u] * sigma[u][t] / sigma[s][t]
    return edge, node
