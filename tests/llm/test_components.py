import random

import numpy as np
from pyspark.sql import functions as F

from voucherlens.llm.components import bloom, candidate_edges, components, in_blocks, may_hold, spanning


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


def test_components_of_random_graphs_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(40)]  # a chain
    edges += [(5000, 5001 + i) for i in range(60)] + [(7, 7)]  # a star, a loop
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_candidate_edges_connect_members_without_pairs(spark):
    rows = [(k, m) for k in range(3) for m in range(k * 10, k * 10 + 30)] + [(9, 99)]
    edges = candidate_edges(spark.createDataFrame(rows, "k long, m long"), "k", "m").collect()
    assert len(edges) == 3 * 29
    assert {x for e in edges for x in e} == set(range(50))


def test_blocks_bring_every_two_members_together(spark):
    rows = [(i, 1, 1) for i in range(600)] + [(1000, 2, 1), (1001, 2, 1), (2000, 3, 1)]
    members = spark.createDataFrame(rows, "key long, component long, weight long")
    tasks = {}
    for r in in_blocks(members).collect():
        tasks.setdefault((r["component"], r["left_block"], r["right_block"]), set()).add(r["key"])
    met = {(c, a, b) for (c, _, _), own in tasks.items() for a in own for b in own if a < b}
    assert len(met) == 600 * 599 // 2 + 1


def test_spanning_labels_are_components():
    linked = np.zeros((6, 6), bool)
    for a, b in ((5, 3), (3, 1), (4, 2)):
        linked[a, b] = linked[b, a] = True
    assert spanning(linked).tolist() == [0, 1, 2, 1, 2, 1]


def test_bloom_never_misses(spark):
    keys = spark.range(-50, 500).select(F.xxhash64("id").alias("k"))
    filled = bloom(keys, "k")
    own = np.array([r["k"] for r in keys.collect()], np.int64)
    assert may_hold(filled, own).all()
    assert may_hold(filled, np.arange(10_000, dtype=np.int64)).mean() < 0.01
