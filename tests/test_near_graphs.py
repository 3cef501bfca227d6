"""Searches over the embedding graph keep no table of its edges and agree with plain searches."""

import heapq
import math
import random

from chronomesh.operators import traversal as T
from chronomesh.operators import walker as Wk
from chronomesh.operators.spatial import Near
from chronomesh.plans import graphs, storage


def test_no_edge_is_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(graphs, "stored", lambda df, name: kept.append(name) or storage.stored(df, name))
    graph = graphs.embedding_graph(spark, "/root/testdata/sf0.001")
    assert kept == ["nodes"]
    assert "Window" not in graph.edges.select("src", "dst")._jdf.queryExecution().optimizedPlan().toString()


def test_searches_and_walks(spark):
    draw = random.Random(3)
    nodes = [(k, draw.random(), draw.random(), draw.random(), b, b + 30, {}) for k in range(40) for b in [draw.randrange(25)]]
    nodes[7] = (7, *nodes[3][1:])  # two nodes in one place
    links = {}
    for a in nodes:
        for b in nodes:
            w, begin, end = math.dist(a[1:4], b[1:4]), max(a[4], b[4]), min(a[5], b[5])
            if a[0] != b[0] and w <= 0.35 and begin < end:
                links.setdefault(a[0], []).append((b[0], w, begin, end))
    schema = "id bigint, x double, y double, z double, begin_ts bigint, end_ts bigint, props map<string,string>"
    graph = Near(storage.stored(spark.createDataFrame(nodes, schema), "nodes")[0], 0.35)

    cost, heap = {}, [(0.0, 3)]
    while heap:
        c, u = heapq.heappop(heap)
        if u not in cost:
            cost[u] = c
            for v, w, _, _ in links.get(u, []):
                heapq.heappush(heap, (c + w, v))
    got = {r.node: r.cost for r in T.least_cost(graph, 3, paths=False).collect()}
    assert set(got) == set(cost) and all(math.isclose(got[n], cost[n], abs_tol=1e-9) for n in cost) and len(got) > 20

    first, heap = {}, [(5, 3)]
    while heap:
        t, u = heapq.heappop(heap)
        if u not in first:
            first[u] = t
            for v, w, begin, end in links.get(u, []):
                if max(t, begin) < end:
                    heapq.heappush(heap, (max(t, begin) + math.ceil(w), v))
    reached = T.signal(graph, 3, 5)[0].collect()
    assert {r.node: r.arrival for r in reached} == first
    for r in reached:  # a path is a way to what was found
        at, total = 5, 0.0
        for u, v in zip(r.path, r.path[1:]):
            _, w, begin, end = next(e for e in links[u] if e[0] == v)
            assert max(at, begin) < end
            at, total = max(at, begin) + math.ceil(w), total + w
        assert r.path[0] == 3 and r.path[-1] == r.node and at == r.arrival and math.isclose(total, r.cost, abs_tol=1e-9)

    starts = spark.createDataFrame([(w, w) for w in range(3)], "walker bigint, node bigint")
    walked = {(r.walker, r.step): r.node for r in Wk.random_walk(graph, starts, 2).collect()}
    for w in range(3):
        at = w
        for k in (1, 2):
            if at not in links:  # a sink ends the walk
                assert (w, k) not in walked
                break
            at = links[at][(at + k) % len(links[at])][0]
            assert walked[w, k] == at
