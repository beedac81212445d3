"""Graphs whose edges stay a table of blocks give what those on the driver give."""

import runpy
from pathlib import Path

import numpy as np
import pytest

from penumbra.operators import graphs
from penumbra.operators.base import spread

R = np.random.default_rng(11)


def edges_of(spark, n=40, m=150, weights=True):
    s, d = R.integers(0, n, m), R.integers(0, n, m)
    w = R.integers(1, 4, m) if weights else np.ones(m)
    rows = [(int(a) * 10 - 60, int(b) * 10 - 60, float(x)) for a, b, x in zip(s, d, w)]
    return spark.createDataFrame([*rows, *rows[:20], (None, 1, 1.0), (1, 1, 2.0), (1, 2, None), (1, 3, float("nan"))], "src bigint, dst bigint, w double")


@pytest.fixture
def in_blocks(spark, monkeypatch):
    """From on() till off() there are more edges than the driver may hold."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def on():
        monkeypatch.setattr(graphs, "EDGES", 10)
        monkeypatch.setattr(graphs, "BLOCK", 7)
        spark.conf.set(batch, "3")

    def off():
        monkeypatch.undo()
        spark.conf.unset(batch)

    on.off = off
    yield on
    off()


def u_of(m):
    return np.array([r["u"] for r in m.memberships.orderBy("id", "k").collect()])


def test_blocks_hold_the_graph(spark, in_blocks):
    nodes = spark.createDataFrame([(5,), (None,), (10**15,)], "id bigint")
    for weights in (True, False):
        e = edges_of(spark, weights=weights)
        a = graphs.Graph(e, nodes)
        in_blocks()
        b = graphs.Graph(e, nodes)
        in_blocks.off()
        assert a.local and not b.local and b.blocks.count() > 10 and (a.ids == b.ids).all() and 10**15 in a.ids and 5 in a.ids
        assert all((x == y).all() for x, y in zip(a.arrays, b.arrays))
        want = {(r["src"], r["dst"]): r["w"] for r in graphs.symmetric(e).collect()}
        assert {(a.ids[s], a.ids[d]): w for s, d, w in zip(*a.arrays)} == want
        x = R.normal(size=(a.n, 3))
        assert np.allclose(a.sum(x), b.sum(x)) and np.allclose(a.count, b.count) and np.allclose(a.degree, b.degree) and a.total == b.total
    with spread():
        none = graphs.Graph(spark.createDataFrame([(1, 1)], "src bigint, dst bigint"), nodes)
    assert none.n == 2 and none.m == 0 and (none.count == 0).all()


def test_affiliations_of_more_edges_than_the_driver_holds(spark, in_blocks):
    e = edges_of(spark)
    op = graphs.BIGCLAM(k=3, max_iter=4)
    a = u_of(op.fit(e))
    in_blocks()
    assert np.allclose(a, u_of(op.fit(e)))


def test_factors_of_more_edges_than_the_driver_holds(spark, in_blocks):
    e = edges_of(spark)
    op = graphs.BayesianNMF(k=3, max_iter=3)
    a = op.fit(e)
    in_blocks()
    b = op.fit(e)
    assert np.allclose(u_of(a), u_of(b)) and np.allclose(a.extras["H"], b.extras["H"])


def test_normalised_edges_of_more_than_the_driver_holds(spark, in_blocks):
    e = edges_of(spark)
    rows = lambda: {(r["src"], r["dst"]): r["w"] for r in graphs.normalised_edges(graphs.Graph(e)).collect()}
    a = rows()
    in_blocks()
    b = rows()
    assert a.keys() == b.keys() and len(a) == graphs.symmetric(e).count() and all(abs(a[x] - b[x]) < 1e-12 for x in a)
    deg = {r["src"]: r["count"] + 1 for r in graphs.symmetric(e).groupBy("src").count().collect()}
    assert all(abs(w - (deg[s] * deg[d]) ** -0.5) < 1e-12 for (s, d), w in a.items())


@pytest.mark.parametrize("op", [graphs.CDCGS(k=3).value, graphs.CDCGS(k=3, objective="block_diagonal").value, graphs.DMoN(k=3).loss], ids=["modularity", "blocks", "dmon"])
def test_losses_of_more_edges_than_the_driver_holds(spark, in_blocks, op):
    e = edges_of(spark)
    a = graphs.Graph(e)
    c = graphs.softmax(R.normal(size=(a.n, 3)))
    in_blocks()
    (x, gx), (y, gy) = op(a, c), op(graphs.Graph(e), c)
    assert np.isclose(x, y) and np.allclose(gx, gy)


def test_bernoulli_poisson_loss_of_more_edges_than_the_driver_holds(spark, in_blocks):
    e = edges_of(spark)
    a = graphs.Graph(e)
    z = R.random((a.n, 2))
    in_blocks()
    b = graphs.Graph(e)
    assert all(np.isclose(graphs.berpo(a, z, x), graphs.berpo(b, z, x)) for x in (True, False))


def test_blockmodel_sweeps_alike_nodes_once(spark, monkeypatch):
    """Two kinds of nodes that are all linked, loose nodes and a tail: fewer classes than nodes, and what single pairs give."""
    blocks_by_pairs = runpy.run_path(str(Path(__file__).with_name("test_estimators.py")))["blocks_by_pairs"]
    n, links = 46, [(i, j) for i in range(24) for j in range(24, 36)] + [(36, 0), (36, 1), (40, 41), (42, 43), (44, 45)]
    y = np.zeros((n, n))
    for i, j in links:
        y[i, j] = y[j, i] = 0.5 if i >= 40 else 1.0
    e = spark.createDataFrame([(i, j, float(y[i, j])) for i, j in links], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    z = np.arange(n) % 3
    soft = np.full((n, 3), 0.1 / 3) + 0.9 * np.eye(3)[z]
    g = graphs.Graph(e, nodes)
    c = graphs.Classes(g.s, g.d, g.w, z)
    assert 2 * len(c.size) <= n and c.size.sum() == n
    alone = []
    for rounds in (graphs.Classes.ROUNDS, 1):  # 1: not settled, so each node is alone
        monkeypatch.setattr(graphs.Classes, "ROUNDS", rounds)
        alone.append(len(graphs.Classes(g.s, g.d, g.w, z).size))
        for limit in (10**9, 0):
            monkeypatch.setattr(graphs.MMSB, "LOCAL", limit)
            monkeypatch.setattr(graphs.MMSB, "TILE", 300)
            # the states of all pairs are more than there may be, those of the classes are not
            monkeypatch.setattr(graphs.MMSB, "PAIRS", n * n * 3 - 1 if rounds > 1 else 10**9)
            m = graphs.MMSB(k=3, init=z, max_iter=3, n_inner=2, tol=0.0).fit(e, nodes)
            want = blocks_by_pairs(y, soft, 0.5, 3, 2)
            assert np.allclose(m.extras["block_matrix"], want[0]) and np.allclose(m.extras["gamma"], want[1])
    assert alone[1] == n > alone[0]


def test_nodes_with_the_same_neighbours_are_summed_up_once(spark, in_blocks):
    e = spark.createDataFrame([(i, j, 1.0 + i % 3) for i in range(20) for j in range(100, 104)] + [(0, 1, 1.0), (200, 5, 2.0)], "src bigint, dst bigint, w double")
    nodes = spark.createDataFrame([(999,)], "id bigint")
    g = graphs.Graph(e, nodes)
    a = np.zeros((g.n, g.n))
    a[g.s, g.d] = 1
    x = R.normal(size=(g.n, 5))
    assert g.alike[3] < 9 and len(g.alike[1]) < g.m / 2 and np.allclose(g.near(x), a @ x)
    loops = a + np.eye(g.n)
    half = loops.sum(1) ** -0.5
    assert np.allclose(graphs.normalised(g)(x), (half[:, None] * loops * half) @ x)
    in_blocks()
    assert np.allclose(graphs.Graph(e, nodes).near(x), a @ x)
