import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keysift.llm import cover_tree as T

SCHEMA = "vec_id long, embedding array<float>, vector string, asks string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, k=10):
    usable = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    every = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in every if j != i and len(v) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, k=10):
    return sorted(tuple(r) for r in T.top_k(frame(spark, rows), F.col("vec_id") % 100 == 0, k).collect())


def vectors(n, dims, seed, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + spread * draw.gauss(0, 0.2) for c in draw.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("n,dims", [(1500, 3), (900, 16), (205, 64)])
def test_against_brute_force(spark, n, dims):
    rows = vectors(n, dims, n)
    assert found(spark, rows) == brute(rows)


def test_blocks_of_queries_and_data(spark, monkeypatch):
    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    rows = vectors(1200, 4, 8)
    assert found(spark, rows) == brute(rows)


def test_no_vectors_pass_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("vectors brought to the driver")

    monkeypatch.setattr(T, "QUERY_BLOCK", 3)
    monkeypatch.setattr(DataFrame, "toArrow", refused)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    rows = vectors(900, 4, 5) + [(i, [*v, 1.0]) for i, v in vectors(300, 4, 6)]
    assert found(spark, rows) == brute(rows)


def test_ties_and_one_vector_in_a_third_of_all_rows(spark):
    rows = [(i, [0.5, 0.25] if i % 3 == 0 else v) for i, v in vectors(600, 2, 4)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("sign", [1, -1])
def test_scores_that_floats_do_not_hold(spark, sign):
    draw = random.Random(sign)
    rows = [(i, [1e6, draw.choice([1e6, 999_999.0]), sign * draw.choice([1e6, -1e6]), draw.randint(-9, 9) / 1024, draw.randint(0, 3) / 1024])
            for i in range(700)]
    assert found(spark, rows) == brute(rows)
    large = [(100, [2.0 ** 60, 0.0]), (1, [1 / 1024, 3.0]), (2, [0.0, 5.0]), (3, [-1 / 1024, 7.0])]
    assert found(spark, large) == [(100, 1, 1, 2 ** 63 - 1), (100, 2, 2, 0), (100, 3, 3, -(2 ** 63 - 1))]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0]), (200, []), (300, None), (400, [float("nan"), 1.0]), (500, [None, 1.0]), (600, [float("inf")]),
            (1, [1.0, -1.0]), (2, [3.0]), (3, []), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (700, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [-0.0004, 1.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, [1.0])]) == [] and found(spark, [(100, [1.0])]) == []


def test_repeated_queries(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 5.0])]
    assert found(spark, rows) == [(100, 1, 1, 2 * 1024 * 1024), (100, 2, 2, 1024 * 1024)]


def test_nodes_cover_their_points():
    rows = np.array([v for _, v in vectors(800, 5, 1)]) * 100
    tree = T.CoverTree(np.floor(rows), np.arange(len(rows)))
    todo, leaves = [tree.root], []
    while todo:
        node = todo.pop()
        assert tree._distance(node.points, node.centre).max() <= node.radius + 1e-9
        for child in node.children:
            assert len(child.points) < len(node.points)
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        else:
            leaves += node.points.tolist()
        todo += node.children
    assert sorted(leaves) == list(range(800))
