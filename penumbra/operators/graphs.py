"""Communities in graphs: edges (src, dst, w), taken as symmetric, without loops.

Sums over neighbours run as joins of the edge table with a table of node states, so that a graph of any size has one step in SQL
operators (`neighbour_sums`, `affiliation_step`, `modularity`). Fits hold what belongs to nodes on the driver; edges are held there too up to
EDGES of them, beyond that they are a table of blocks, and a step is a pass over it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions.membership import dirichlet, digamma, softmax, uniform
from penumbra.functions.optimise import Adam
from penumbra.operators.base import Estimator, Model, held, long_form, register
from penumbra.session import forget, materialize

EDGES = 4_000_000
COLLECTED = 20_000_000  # edges that NOCD and MMSB, which draw or compare single edges, bring to the driver at most
BLOCK = 250_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, pairs as often as they are there; loops, nulls and weights that are not positive are left out."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    e = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), w.alias("w")).where("src <> dst and w > 0 and not isnan(w)")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, each pair once, the larger weight; loops, nulls and weights that are not positive are left out."""
    return both_ways(edges).groupBy("src", "dst").agg(F.max("w").alias("w"))


class Graph:
    """Sparse adjacency. Nodes are those of the edges and of `nodes` (id), in the order of their ids.

    Up to EDGES edges are arrays on the driver, in the order of sender and receiver; more stay a table of blocks of about BLOCK edges, a
    sender's edges being in few of them. What is summed up by node comes back to the driver either way.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None):
        self.spark = edges.sparkSession
        # one shuffle, by sender; pairs that are there more than once lie side by side
        e = both_ways(edges).repartition("src").sortWithinPartitions("src", "dst")
        most = BLOCK
        raw = materialize(e.mapInArrow(lambda it: _blocks(it, most), "m bigint, who binary, s binary, d binary, w binary"), "edges")
        t = raw.select("m", "who").toArrow()
        ids = [np.frombuffer(x.as_buffer(), np.int64) for x in t["who"]]
        if nodes is not None:
            ids.append(nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("id")).where("id is not null").distinct().toArrow()["id"].to_numpy())
        self.ids = np.unique(np.concatenate([np.zeros(0, np.int64), *ids]))
        self.n, self.m = len(self.ids), sum(t["m"].to_pylist())
        self.local = self.m <= held(EDGES)
        if self.local:
            self.blocks = raw
            s, d, w = self._collect(np.int64)
            self.arrays = self._ordered(np.searchsorted(self.ids, s), np.searchsorted(self.ids, d), w)
        else:
            told = self.spark.sparkContext.broadcast(self.ids)

            def number(batches):
                for b in batches:
                    for i in range(b.num_rows):
                        s, d = (np.searchsorted(told.value, np.frombuffer(b.column(c)[i].as_buffer(), np.int64)).astype(np.int32) for c in (0, 1))
                        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()]), pa.array([d.tobytes()]), b.column(2).slice(i, 1)], names=["s", "d", "w"])

            self.blocks = materialize(raw.select("s", "d", "w").mapInArrow(number, "s binary, d binary, w binary"), "edges")
            told.destroy()
        forget(raw)

    def _collect(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = self.blocks.select("s", "d", "w").toArrow()
        parts = [_edges(*x, kind) for x in zip(t["s"], t["d"], t["w"])]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, kind), np.zeros(0, kind), np.zeros(0))

    def _ordered(self, s: np.ndarray, d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.argsort(s.astype(np.int64) * self.n + d)
        return s[o].astype(np.int64), d[o].astype(np.int64), w[o]

    @cached_property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sender, receiver, weight) of all edges, by number, in their order."""
        if self.m > COLLECTED:
            raise ValueError(f"{self.m} edges: single edges are brought to the driver up to {COLLECTED}")
        return self._ordered(*self._collect(np.int32))

    s = property(lambda self: self.arrays[0])
    d = property(lambda self: self.arrays[1])
    w = property(lambda self: self.arrays[2])

    def close(self) -> None:
        """Removes the table of blocks once no pass over it follows."""
        forget(self.blocks)

    def tasks(self, fn: Callable, schema: str) -> DataFrame:
        """The batches that fn(s, d, w), with numbers of nodes, gives for the blocks."""
        told = self.spark.sparkContext.broadcast(cloudpickle.dumps(fn))

        def run(batches):
            f = pickle.loads(told.value)
            for b in batches:
                for i in range(b.num_rows):
                    yield from f(*_edges(*(b.column(c)[i] for c in range(3)), np.int32))

        out = self.blocks.select("s", "d", "w").mapInArrow(run, schema)
        out._told = told  # lives as long as the frame
        return out

    def over(self, fn: Callable) -> list:
        """What fn(s, d, w) gives for each block of edges, in a fixed order."""
        if self.local:
            return [fn(self.s, self.d, self.w)]

        def packed(s, d, w):
            yield pa.RecordBatch.from_pydict({"first": [int(s[0]) << 32 | int(d[0])], "got": [pickle.dumps(fn(s, d, w), 5)]})

        rows = self.tasks(packed, "first bigint, got binary")
        t = rows.toArrow()
        rows._told.destroy()
        first = t["first"].to_pylist()
        return [pickle.loads(t["got"][i].as_buffer()) for i in np.argsort(first)]

    def sum(self, x: np.ndarray, weigh: Callable | None = None) -> np.ndarray:
        """For each node the sum over its edges of weight times the neighbour's row; weigh(s, d, w) gives other weights of edges."""
        if self.local:
            w = self.w if weigh is None else weigh(self.s, self.d, self.w)
            return np.column_stack([np.bincount(self.s, w * x[self.d, k], self.n) for k in range(x.shape[1])])

        def rows(s, d, w):
            w = w if weigh is None else weigh(s, d, w)
            new = np.diff(s, prepend=-1) != 0
            at, v = np.cumsum(new) - 1, x[d]
            return s[new], np.column_stack([np.bincount(at, w * v[:, k]) for k in range(x.shape[1])])

        out = np.zeros((self.n, x.shape[1]))
        for who, v in self.over(rows):
            out[who] += v
        return out

    @cached_property
    def alike(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(the set of neighbours of each node, sets and their neighbours as pairs, number of sets): nodes with the same neighbours share a set."""
        cuts, seen = np.searchsorted(self.s, np.arange(self.n + 1)), {}
        of = np.array([seen.setdefault(self.d[a:b].tobytes(), len(seen)) for a, b in zip(cuts, cuts[1:])], int)
        sets = [np.frombuffer(x, self.d.dtype) for x in seen]
        return of, np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([self.d[:0], *sets]), len(sets)

    def near(self, x: np.ndarray) -> np.ndarray:
        """For each node the sum of its neighbours' rows, whatever the weights; on the driver each set of neighbours is summed up once."""
        if not self.local:
            return self.sum(x, _ones)
        of, s, d, n = self.alike
        return np.column_stack([np.bincount(s, x[d, k], n) for k in range(x.shape[1])])[of]

    @cached_property
    def count(self) -> np.ndarray:
        """Edges of each node."""
        return self.sum(np.ones((self.n, 1)), _ones)[:, 0]

    @cached_property
    def degree(self) -> np.ndarray:
        """Sum of the weights of each node's edges."""
        return self.sum(np.ones((self.n, 1)))[:, 0]

    @cached_property
    def total(self) -> float:
        return float(self.degree.sum())


def _ones(s, d, w):
    return np.ones(len(s))


def _edges(s: pa.Scalar, d: pa.Scalar, w: pa.Scalar, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of a block; weights that are all 1 are not kept."""
    s, d = (np.frombuffer(x.as_buffer(), kind) for x in (s, d))
    return s, d, np.frombuffer(w.as_buffer(), float) if w.is_valid else np.ones(len(s))


def _blocks(batches, most: int):
    """Batches of rows in the order of (src, dst) as blocks of at least `most` edges, but for the last, each pair once with the larger weight."""
    rows, size = [], 0

    def block(s, d, w):
        new = np.append(True, (np.diff(s) != 0) | (np.diff(d) != 0))
        w = np.maximum.reduceat(w, np.flatnonzero(new))
        s, d = s[new], d[new]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(s)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (s[np.diff(s, prepend=s[0] - 1) != 0], s, d)), pa.array([None if (w == 1).all() else w.tobytes()], pa.binary())],
            names=["m", "who", "s", "d", "w"],
        )

    for b in batches:
        rows.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        size += b.num_rows
        if size >= most:
            s, d, w = (np.concatenate(x) for x in zip(*rows))
            other = np.flatnonzero((s != s[-1]) | (d != d[-1]))
            end = other[-1] + 1 if len(other) else 0  # the last pair may go on
            if end:
                yield block(s[:end], d[:end], w[:end])
            rows = [[s[end:], d[end:], w[end:]]]
            size = len(s) - end
    if size:
        yield block(*(np.concatenate(x) for x in zip(*rows)))


def neighbour_sums(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(node, k, v): for each node and column k, the sum over its edges of w times the neighbour's value; state is (node, k, v)."""
    e, s = edges.alias("e"), state.alias("s")
    return e.join(s, F.col("e.dst") == F.col("s.node")).groupBy(F.col("e.src").alias("node"), F.col("s.k").alias("k")).agg(F.sum(F.col("e.w") * F.col("s.v")).alias("v"))


def affiliation_step(edges: DataFrame, state: DataFrame, lr: float) -> DataFrame:
    """One gradient step of the affiliation model on (node, k, v); nodes without edges stay as they are.

    A node's values travel as one array, so that an edge is one row however many columns there are.
    """
    ordered = F.array_sort(F.collect_list(F.struct("k", "v")))
    rows = state.groupBy("node").agg(ordered.alias("f"))
    a, b = rows.select(F.col("node").alias("src"), F.col("f.v").alias("a")), rows.select(F.col("node").alias("dst"), F.col("f").alias("b"))
    dot = F.aggregate(F.zip_with("a", F.col("b.v"), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    x = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "b", dot.alias("x"))
    pull = x.select("src", (F.exp(-F.col("x")) / (1 - F.exp(-F.col("x")) + 1e-10)).alias("w"), F.explode("b").alias("b"))
    pull = pull.groupBy(F.col("src").alias("node"), F.col("b.k").alias("k")).agg(F.sum(F.col("w") * F.col("b.v")).alias("p"))
    totals = state.groupBy("k").agg(F.sum("v").alias("t"))
    new = state.join(pull, ["node", "k"], "left").join(F.broadcast(totals), "k")  # one row for each column
    grad = F.when(F.col("p").isNull(), 0.0).otherwise(F.col("p") - (F.col("t") - F.col("v")))
    return new.select("node", "k", F.greatest(F.col("v") + lr * grad, F.lit(1e-10)).alias("v"))


def modularity(edges: DataFrame, state: DataFrame) -> DataFrame:
    """One row q: the modularity of soft memberships (node, k, v) over symmetric edges; 0 for no edges."""
    inside = neighbour_sums(edges, state).withColumnRenamed("v", "nv").join(state, ["node", "k"]).agg(F.sum(F.col("nv") * F.col("v")).alias("a"))
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    null = state.join(degree, "node").groupBy("k").agg(F.sum(F.col("v") * F.col("deg")).alias("p")).agg(F.sum(F.col("p") * F.col("p")).alias("b"))
    total = edges.agg(F.sum("w").alias("m"))
    return inside.crossJoin(null).crossJoin(total).select(F.coalesce((F.col("a") - F.col("b") / F.col("m")) / F.col("m"), F.lit(0.0)).alias("q"))  # one row each


class _GraphFit(Estimator):
    def graph(self, edges: DataFrame | Graph, nodes: DataFrame | None) -> Graph:
        g = edges if isinstance(edges, Graph) else Graph(edges, nodes)
        if self.k > g.n:
            raise ValueError(f"k={self.k} is more than the {g.n} nodes")
        return g

    def result(self, g: Graph, u: np.ndarray, **more) -> Model:
        g.close()
        spark, ids = g.spark, g.ids
        return Model(type(self).__name__, lambda: long_form(spark, ids, u), u.shape[1], constrained=self.CONSTRAINED, **more)


@register
class BIGCLAM(_GraphFit):
    """Affiliations whose products explain the edges, by gradient ascent with a fixed step. Not a partition."""

    PARAMS = {"k": 3, "max_iter": 100, "lr": 0.01, "seed": 0, "init": None, "in_memory": True}
    CONSTRAINED = False

    def fit(self, edges, nodes=None):
        if not self.in_memory:
            return self.fit_joins(edges, nodes)
        g = self.graph(edges, nodes)
        f = uniform(g.ids, self.k, self.seed) if self.init is None else np.array(self.init, float)
        linked = g.count[:, None] > 0

        def weigh(s, d, w, f):
            x = (f[s] * f[d]).sum(1)
            return np.exp(-x) / (1 - np.exp(-x) + 1e-10)

        for _ in range(self.max_iter):
            pull = g.sum(f, lambda s, d, w, f=f: weigh(s, d, w, f))
            f = np.maximum(f + self.lr * np.where(linked, pull - (f.sum(0) - f), 0.0), 1e-10)
        return self.result(g, f, n_iter=self.max_iter)

    def fit_joins(self, edges, nodes=None):
        """The same steps as joins, for graphs of any size; the state is written out every few steps."""
        e = materialize(symmetric(edges), "edges")
        ids = e.select(F.col("src").alias("node")).distinct()
        if nodes is not None:
            ids = ids.unionByName(nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("node"))).where("node is not null").distinct()
        f, kept = ids.mapInPandas(lambda it: (_start(b, self.k, self.seed) for b in it), "node bigint, k int, v double"), None
        for i in range(self.max_iter):
            f = affiliation_step(e, f, self.lr)
            if i % 3 == 2:
                before, kept = kept, materialize(f, "affiliation")
                f = kept
                if before is not None:
                    forget(before)
        return Model("BIGCLAM", f.select(F.col("node").alias("id"), "k", F.col("v").alias("u")), self.k, n_iter=self.max_iter, constrained=False)


def _start(b, k, seed):
    ids = b["node"].to_numpy()
    return pd.DataFrame({"node": np.repeat(ids, k), "k": np.tile(np.arange(k, dtype=np.int32), len(ids)), "v": uniform(ids, k, seed).ravel()})


@register
class BayesianNMF(_GraphFit):
    """Non-negative factors of the adjacency with automatic relevance. Only edges enter the products. extras: H (k, n), beta."""

    PARAMS = {"k": 3, "max_iter": 100, "a": 1.0, "b": 1.0, "tol": 1e-5, "seed": 0, "init_w": None, "init_h": None}
    CONSTRAINED = False

    def fit(self, edges, nodes=None):
        g = self.graph(edges, nodes)
        w = uniform(g.ids, self.k, self.seed) if self.init_w is None else np.array(self.init_w, float)
        h = uniform(g.ids, self.k, self.seed + 1) if self.init_h is None else np.array(self.init_h, float)  # (n, k)
        beta, steps = np.ones(self.k), 0
        for _ in range(self.max_iter):
            # the graph is symmetric: sums over columns are sums over rows of the edges turned round
            h = h * g.sum(w, self.share(h, w)) / (w.sum(0) + h * beta + 1e-10)
            old_w = w
            w = w * g.sum(h, self.share(w, h)) / (h.sum(0) + w * beta + 1e-10)
            beta, steps = ((w**2).sum(0) + (h**2).sum(0)) / 2 + self.b / (g.n + self.a - 1), steps + 1
            d = w - old_w
            if np.sqrt(max(((d.T @ d) * (h.T @ h)).sum(), 0.0)) < self.tol:
                break
        return self.result(g, w, n_iter=steps, extras={"H": h.T, "beta": beta})

    @staticmethod
    def share(a: np.ndarray, b: np.ndarray) -> Callable:
        """Weights of edges by what the factors make of them."""
        return lambda s, d, y: y / ((a[s] * b[d]).sum(1) + 1e-10)


class Classes:
    """Nodes that start alike and have as many neighbours of each class and weight: all that is told of their pairs stays equal in every sweep.

    of: the class of each node; size: nodes of each class. a, b, y, m: for every class of senders, class of receivers and weight that are
    linked, the receivers m of each sender. In a graph without such nodes each is a class of its own.
    """

    ROUNDS = 20

    def __init__(self, s: np.ndarray, d: np.ndarray, y: np.ndarray, start: np.ndarray):
        n = len(start)
        kind = np.unique(y, return_inverse=True)[1] if len(y) else np.zeros(0, int)
        of, cuts = np.unique(start, return_inverse=True)[1], np.searchsorted(s, np.arange(n + 1))
        for _ in range(self.ROUNDS):
            label = of[d] * (kind.max(initial=0) + 1) + kind
            label = label[np.lexsort((label, s))]
            seen: dict[tuple[int, bytes], int] = {}
            new = np.array([seen.setdefault((int(of[i]), label[cuts[i] : cuts[i + 1]].tobytes()), len(seen)) for i in range(n)], int)
            before, of = of.max(initial=-1) + 1, new
            if len(seen) == before or 2 * len(seen) > n:
                break
        if len(seen) != before:  # not settled, or hardly any alike
            of = np.arange(n)
        first = np.unique(of, return_index=True)[1]
        # classes in the order of their first nodes, what they are linked to from any of these
        rank = np.empty(len(first), int)
        rank[np.argsort(first)] = np.arange(len(first))
        self.of, first = rank[of], np.sort(first)
        self.size = np.bincount(self.of, minlength=len(first))
        at = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in first]) if len(first) else np.zeros(0, int)
        pairs, self.m = np.unique(np.stack([self.of[s[at]], self.of[d[at]], kind[at]]), axis=1, return_counts=True)
        self.a, self.b, self.y = pairs[0], pairs[1], np.unique(y)[pairs[2]] if len(y) else y


class Tile:
    """The ordered pairs of some classes of senders with all classes. Only the receivers' shares are state.

    Rows are the pairs of classes without a link, then the linked ones by weight, each standing for some receivers of each sender, or none.
    """

    def __init__(self, lo: int, hi: int, size: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, m: np.ndarray):
        c = len(size)
        free = np.tile(size.astype(float), (hi - lo, 1))
        free[np.arange(hi - lo), np.arange(lo, hi)] -= 1  # nodes with themselves count for nothing
        np.subtract.at(free, (a - lo, b), m)
        self.lo, self.hi, self.size = lo, hi, size
        self.a, self.b = np.concatenate([np.repeat(np.arange(lo, hi), c), a]), np.concatenate([np.tile(np.arange(c), hi - lo), b])
        self.y, self.m = np.concatenate([np.zeros((hi - lo) * c), y]), np.concatenate([free.ravel(), m])

    def sweep(self, into: np.ndarray | None, soft: np.ndarray, el: np.ndarray, bm: np.ndarray, inner: int) -> tuple[np.ndarray, ...]:
        """(receivers' shares, sums of senders' shares by sender, of receivers' by receiver, pairs by blocks, edges by blocks)."""
        into = soft[self.b] if into is None else into
        no, gain, k, y = np.log1p(-bm), np.log(bm) - np.log1p(-bm), el.shape[1], self.y[:, None]
        linked = np.flatnonzero(self.y)
        send, receive = el[self.a], el[self.b]
        for _ in range(inner):
            out = send + into @ no.T
            out[linked] += y[linked] * (into[linked] @ gain.T)
            out = softmax(out)
            into = receive + out @ no
            into[linked] += y[linked] * (out[linked] @ gain)
            into = softmax(into)
        each = self.m * self.size[self.a]  # pairs of nodes that a row stands for
        by = lambda at, x, w, n: np.column_stack([np.bincount(at, x[:, i] * w, n) for i in range(k)])
        by_sender = by(self.a - self.lo, out, self.m, self.hi - self.lo)
        by_receiver = by(self.b, into, each / self.size[self.b], len(self.size))
        return into, by_sender, by_receiver, (each[:, None] * out).T @ into, ((each * self.y)[linked, None] * out[linked]).T @ into[linked]


@register
class MMSB(_GraphFit):
    """Mixed-membership stochastic blockmodel by variational sweeps over all pairs of nodes. extras: block_matrix, gamma.

    Pairs of nodes of the same two classes (see Classes) stay equal, so that one of them is swept for all. They are taken in tiles of some
    classes of senders with all classes. Up to LOCAL numbers are swept on the driver; beyond that tiles are rows of a table that each sweep reads
    and writes, and only sums over classes and blocks come back. init is spectral, random, or a block for each node in the order of ids.
    """

    PARAMS = {"k": 3, "alpha": 0.5, "max_iter": 100, "n_inner": 5, "tol": 1e-4, "init": "spectral", "seed": 0}
    SOFT = 0.9  # fixed value: what a starting block holds of its nodes; the rest is spread over all
    TILE, LOCAL, PAIRS = 2_000_000, 20_000_000, 4_000_000_000

    def fit(self, edges, nodes=None):
        g = self.graph(edges, nodes)
        n, k = g.n, self.k
        y, blocks = np.minimum(g.w, 1.0), self.starting_blocks(g)
        c = Classes(g.s, g.d, y, blocks)
        states = len(c.size) ** 2 * k
        if states > self.PAIRS and self.max_iter:
            raise ValueError(f"{n} nodes of {len(c.size)} classes: the state of their pairs is limited to {self.PAIRS} numbers")
        soft = np.full((n, k), (1 - self.SOFT) / k)
        soft[np.arange(n), blocks] += self.SOFT
        # at the start the shares of a pair are those of its nodes, so that all sums are products of totals
        pairs, linked = np.outer(soft.sum(0), soft.sum(0)) - soft.T @ soft, (y[:, None] * soft[g.s]).T @ soft[g.d]
        # from here by class
        soft = soft[np.unique(c.of, return_index=True)[1]]
        gamma = self.alpha + 2 * (n - 1) * soft
        steps = 0
        sweep = (self.local if states <= held(self.LOCAL) else self.spread)(g, c, soft) if self.max_iter else None
        for steps in range(1, self.max_iter + 1):
            el = digamma(gamma) - digamma(gamma.sum(1, keepdims=True))
            before = gamma / gamma.sum(1, keepdims=True)
            sent, received, pairs, linked = sweep(el, self.rates(pairs, linked))
            gamma = self.alpha + sent + received
            if c.size @ np.abs(gamma / gamma.sum(1, keepdims=True) - before).mean(1) / n < self.tol:
                break
        gamma = gamma[c.of]
        return self.result(g, gamma / gamma.sum(1, keepdims=True), n_iter=steps, extras={"block_matrix": self.rates(pairs, linked), "gamma": gamma})

    @staticmethod
    def rates(pairs: np.ndarray, linked: np.ndarray) -> np.ndarray:
        return np.clip(linked / (pairs + 1e-10), 1e-10, 1 - 1e-10)

    def tiles(self, c: Classes) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first class, last class, senders, receivers, weights, receivers of each sender) of each tile."""
        n = len(c.size)
        step = max(1, self.TILE // max(1, n * self.k))
        cuts = [(lo, min(lo + step, n)) for lo in range(0, n, step)]
        at = np.searchsorted(c.a, [x for lo, hi in cuts for x in (lo, hi)]).reshape(-1, 2)  # links are in the order of senders
        return [(lo, hi, c.a[a:b], c.b[a:b], c.y[a:b], c.m[a:b]) for (lo, hi), (a, b) in zip(cuts, at)]

    def local(self, g: Graph, c: Classes, soft: np.ndarray):
        tiles = [Tile(lo, hi, c.size, *links) for lo, hi, *links in self.tiles(c)]
        state = [None] * len(tiles)

        def sweep(el, bm):
            got = [t.sweep(s, soft, el, bm, self.n_inner) for t, s in zip(tiles, state)]
            state[:] = [x[0] for x in got]
            return np.concatenate([x[1] for x in got]), *(sum(x[i] for x in got) for i in (2, 3, 4))

        return sweep

    def spread(self, g: Graph, c: Classes, soft: np.ndarray):
        size, k, inner = c.size, self.k, self.n_inner
        columns = "lo int, hi int, a binary, b binary, y binary, m binary, state binary"
        tiles = [(lo, hi, a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes(), y.tobytes(), m.astype(np.int64).tobytes(), None) for lo, hi, a, b, y, m in self.tiles(c)]
        now = [materialize(g.spark.createDataFrame(tiles, columns).repartition(len(tiles)), "tiles")]

        def sweep(el, bm):
            def run(batches):
                for b in batches:
                    for r in b.itertuples(index=False):
                        t = Tile(r.lo, r.hi, size, np.frombuffer(r.a, np.int32).astype(int), np.frombuffer(r.b, np.int32).astype(int), np.frombuffer(r.y), np.frombuffer(r.m, np.int64))
                        into, *sums = t.sweep(None if r.state is None else np.frombuffer(r.state).reshape(-1, k), soft, el, bm, inner)
                        yield pd.DataFrame([(r.lo, r.hi, r.a, r.b, r.y, r.m, into.tobytes(), *(x.tobytes() for x in sums))], columns=names)

            sums = ("sent", "received", "pairs", "linked")
            names = [x.split()[0] for x in columns.split(", ")] + list(sums)
            new = materialize(now[0].mapInPandas(run, columns + "".join(f", {x} binary" for x in sums)), "tiles")
            got = [(r["lo"], *(np.frombuffer(r[x]).reshape(-1, k) for x in sums)) for r in new.select("lo", *sums).toLocalIterator()]
            forget(now[0])
            now[0] = new
            got.sort(key=lambda x: x[0])
            return np.concatenate([x[1] for x in got]), *(sum(x[i] for x in got) for i in (2, 3, 4))

        return sweep

    def starting_blocks(self, g: Graph) -> np.ndarray:
        if not isinstance(self.init, str):
            return np.asarray(self.init, int)
        rng = np.random.default_rng(self.seed)
        if self.init == "random" or self.k == 1 or g.n <= self.k:
            return rng.integers(0, self.k, g.n)
        e = leading_vectors(g, self.k, rng)
        return small_kmeans(e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-10), self.k, self.seed)

    def sample_graph(self, model: Model, n: int | None = None, seed: int = 0) -> np.ndarray:
        """A drawn adjacency of n nodes (default: the fitted ones)."""
        rng, b = np.random.default_rng(seed), model.extras["block_matrix"]
        pi = model.extras["gamma"] / model.extras["gamma"].sum(1, keepdims=True)
        if n is not None and n != len(pi):
            pi = rng.dirichlet(np.full(self.k, self.alpha), n)
        draw = lambda: (rng.random((len(pi), len(pi), 1)) > np.cumsum(pi, 1)[:, None, :-1]).sum(2)
        return (rng.random((len(pi), len(pi))) < b[draw(), draw().T]).astype(float)


def leading_vectors(g: Graph, k: int, rng: np.random.Generator, steps: int = 100) -> np.ndarray:
    """Eigenvectors of the k eigenvalues of largest size of the adjacency, by sparse products with a few vectors more than asked for."""
    capped = lambda s, d, w: np.minimum(w, 1.0)
    q = np.linalg.qr(rng.standard_normal((g.n, min(g.n, 2 * k + 6))))[0]
    for _ in range(steps):
        q = np.linalg.qr(g.sum(q, capped))[0]
    val, vec = np.linalg.eigh(q.T @ g.sum(q, capped))
    return q @ vec[:, np.argsort(-np.abs(val), kind="stable")[:k]]


def small_kmeans(x: np.ndarray, k: int, seed: int, n_init: int = 10) -> np.ndarray:
    """Labels of k-means on a small array."""
    from penumbra.functions.membership import sqdist

    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(n_init):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = sqdist(x, c).min(1)
            c = np.vstack([c, x[[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]]])
        for _ in range(100):
            lab = sqdist(x, c).argmin(1)
            new = np.array([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
            if np.abs(new - c).max() < 1e-9:
                break
            c = new
        inertia = sqdist(x, c).min(1).sum()
        if inertia < best[0]:
            best = (inertia, sqdist(x, c).argmin(1))
    return best[1]


def soft_modularity(g: Graph, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Modularity of soft memberships and its gradient."""
    if g.total <= 0:
        return 0.0, np.zeros_like(c)
    ac, p = g.sum(c), g.degree @ c
    return float(((c * ac).sum() - (p**2).sum() / g.total) / g.total), 2 * (ac - np.outer(g.degree, p) / g.total) / g.total


def through_softmax(c: np.ndarray, grad: np.ndarray) -> np.ndarray:
    return c * (grad - (grad * c).sum(1, keepdims=True))


@register
class CDCGS(_GraphFit):
    """Free logits with Gumbel noise and a cooling temperature, trained for modularity (or a block-diagonal cluster graph)."""

    PARAMS = {"k": 3, "tau": 1.0, "tau_min": 0.1, "objective": "modularity", "max_epochs": 500, "n_init": 5, "lr": 0.05, "tol": 1e-6, "seed": 0}

    def value(self, g: Graph, c: np.ndarray) -> tuple[float, np.ndarray]:
        """Loss and its gradient by the memberships."""
        if self.objective == "modularity":
            q, grad = soft_modularity(g, c)
            return -q, -grad
        ac = g.sum(c)
        o = softmax(c.T @ ac)
        e = o - np.eye(self.k)
        dr = through_softmax(o, 2 * e / self.k**2)
        return float((e**2).mean()), ac @ (dr + dr.T)

    def fit(self, edges, nodes=None):
        g = self.graph(edges, nodes)
        decay, best = (self.tau_min / self.tau) ** (1 / max(self.max_epochs - 1, 1)), (np.inf, None, [])
        for restart in range(self.n_init):
            rng = np.random.default_rng(self.seed + restart)
            par, adam, curve = {"w": rng.standard_normal((g.n, self.k))}, Adam(self.lr), []
            for epoch in range(self.max_epochs):
                tau = max(self.tau * decay**epoch, self.tau_min)
                c = softmax((par["w"] + rng.gumbel(size=par["w"].shape)) / tau)
                loss, grad = self.value(g, c)
                adam.step(par, {"w": through_softmax(c, grad) / tau})
                curve.append(loss)
                if tau <= self.tau_min and len(curve) > 1 and abs(curve[-2] - loss) < self.tol:
                    break
            final = self.value(g, softmax(par["w"] / self.tau_min))[0]
            if final < best[0]:
                best = (final, softmax(par["w"] / self.tau_min), curve)
        return self.result(g, best[1], history=best[2], n_iter=len(best[2]), extras={"loss": best[0]})


def normalised_edges(g: Graph) -> DataFrame:
    """(src, dst, w) of the symmetrically normalised adjacency with loops, without the loops."""
    ids, n = g.ids, g.count + 1.0

    def batch(s, d, w):
        for i in range(0, len(s), BLOCK):
            a, b = s[i : i + BLOCK], d[i : i + BLOCK]
            yield pa.RecordBatch.from_pydict({"src": pa.array(ids[a]), "dst": pa.array(ids[b]), "w": pa.array(1 / np.sqrt(n[a] * n[b]))})

    if g.local:
        return g.spark.createDataFrame(pa.Table.from_batches(batch(g.s, g.d, g.w), pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())])))
    return g.tasks(batch, "src bigint, dst bigint, w double")


def normalised(g: Graph) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the symmetrically normalised adjacency, loops included, with rows of nodes."""
    half = 1 / np.sqrt(g.count + 1.0)[:, None]
    return lambda x: half * (g.near(half * x) + half * x)


def features_of(nodes: DataFrame, g: Graph) -> np.ndarray:
    """Feature rows in the order of the graph's nodes; a node without features gets zeros."""
    t = nodes.select(F.col(nodes.columns[0]).cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("f")).where("f is not null").dropDuplicates(["id"]).toArrow()
    f = np.array(t["f"].to_pylist(), float)
    x = np.zeros((g.n, f.shape[1]))
    x[np.searchsorted(g.ids, t["id"].to_numpy())] = f
    return x


@register
class DMoN(_GraphFit):
    """A two-layer graph network trained for modularity with a penalty on collapse. nodes: (id, features)."""

    PARAMS = {"k": 3, "hidden": 16, "collapse_weight": 1.0, "max_epochs": 300, "lr": 1e-2, "tol": 1e-6, "seed": 0}

    def loss(self, g: Graph, c: np.ndarray) -> tuple[float, np.ndarray]:
        q, grad = soft_modularity(g, c)
        size = c.sum(0)
        norm = np.linalg.norm(size)
        return -q + self.collapse_weight * (np.sqrt(self.k) / g.n * norm - 1), -grad + self.collapse_weight * np.sqrt(self.k) / g.n * size / max(norm, 1e-300)

    def fit(self, edges, nodes):
        g = self.graph(edges, nodes)
        x = features_of(nodes, g)
        prop = normalised(g)
        rng = np.random.default_rng(self.seed)
        glorot = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        par = {"w1": glorot(x.shape[1], self.hidden), "b1": np.zeros(self.hidden), "w2": glorot(self.hidden, self.k), "b2": np.zeros(self.k)}
        px, adam, curve = prop(x), Adam(self.lr), []

        def forward():
            z = px @ par["w1"] + par["b1"]
            h = np.maximum(z, 0)
            ph = prop(h)
            return z, ph, softmax(ph @ par["w2"] + par["b2"])

        for _ in range(self.max_epochs):
            z, ph, c = forward()
            loss, grad = self.loss(g, c)
            d2 = through_softmax(c, grad)
            d1 = prop(d2 @ par["w2"].T) * (z > 0)  # the propagation is symmetric
            adam.step(par, {"w2": ph.T @ d2, "b2": d2.sum(0), "w1": px.T @ d1, "b1": d1.sum(0)})
            curve.append(loss)
            if len(curve) > 1 and abs(curve[-2] - loss) < self.tol:
                break
        return self.result(g, forward()[2], history=curve, n_iter=len(curve))


def berpo(g: Graph, z: np.ndarray, balance: bool = True) -> float:
    """Bernoulli-Poisson loss of affiliations over all pairs: edges against non-edges, each by its mean if balanced."""
    eps = -np.log(1 - 1 / max(1, g.n) if g.n > 1 else 0.5)

    def sums(s, d, w):
        p = (z[s] * z[d]).sum(1)
        return -np.log(-np.expm1(-eps - p)).sum(), p.sum()

    edge, linked = (sum(x) for x in zip((0.0, 0.0), *g.over(sums)))
    s = z.sum(0)
    rest = s @ s - (z * z).sum() - linked
    n_edge, n_rest = g.m, g.n**2 - g.n - g.m
    if balance:
        return float((edge / max(n_edge, 1) + rest / max(n_rest, 1)) / 2)
    return float((edge + rest) / (g.n**2))


@register
class NOCD(_GraphFit):
    """Overlapping communities by a graph network under a Bernoulli-Poisson model; the best validated weights are kept. Not a partition.

    Inputs are the node features beside the adjacency rows; the first layer is applied to the adjacency as a sparse product. hidden_sizes are
    the widths of the layers before the last (hidden gives one); batch_norm is whether they are brought to one scale over all nodes.
    """

    PARAMS = {
        "k": 3, "hidden": 128, "hidden_sizes": None, "batch_norm": True, "weight_decay": 1e-2, "dropout": 0.5, "lr": 1e-3, "max_epochs": 500, "balance_loss": True, "stochastic_loss": True,
        "batch_size": 20000, "patience": 10, "seed": 0,
    }
    CONSTRAINED = False

    def network(self, g: Graph, x: np.ndarray, rng: np.random.Generator):
        """(parameters, forward, backward) of the layers. forward takes what is kept of each hidden layer and gives (output, what backward needs)."""
        sizes = [*(self.hidden_sizes or [self.hidden]), self.k]
        prop = normalised(g)
        glorot = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
        inv = 1 / np.sqrt(g.count).clip(1)
        par = {"wx": glorot(max(1, x.shape[1]), sizes[0])[: x.shape[1]], "wa": glorot(g.n, sizes[0]), "b0": np.zeros(sizes[0])}
        for i, (m, n) in enumerate(zip(sizes, sizes[1:]), 1):
            par |= {f"w{i}": glorot(m, n), f"b{i}": np.zeros(n)}

        def forward(keep: list):
            seen, out = [], prop(x @ par["wx"] + inv[:, None] * g.near(par["wa"])) + par["b0"]
            for i in range(1, len(sizes)):
                scale = out.std(0) + 1e-5 if self.batch_norm else 1.0
                norm = (out - out.mean(0)) / scale if self.batch_norm else out
                below = prop(np.maximum(norm, 0) * keep[i - 1])
                seen.append((norm, scale, below))
                out = below @ par[f"w{i}"] + par[f"b{i}"]
            return out, seen

        def backward(grad: np.ndarray, seen: list, keep: list) -> dict[str, np.ndarray]:
            out = {}
            for i in range(len(sizes) - 1, 0, -1):
                norm, scale, below = seen[i - 1]
                out |= {f"w{i}": below.T @ grad, f"b{i}": grad.sum(0)}
                grad = prop(grad @ par[f"w{i}"].T) * keep[i - 1] * (norm > 0)
                if self.batch_norm:
                    spread = np.maximum(scale - 1e-5, 1e-12)
                    grad = (grad - grad.mean(0) - norm * (grad * norm).mean(0) * scale / spread) / scale
            pulled = prop(grad)
            return out | {"b0": grad.sum(0), "wa": g.near(inv[:, None] * pulled), "wx": x.T @ pulled}

        return par, forward, backward, sizes

    def fit(self, edges, nodes=None):
        g = self.graph(edges, nodes)
        x = features_of(nodes, g) if nodes is not None and "features" in nodes.columns else np.zeros((g.n, 0))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rng = np.random.default_rng(self.seed)
        par, forward, backward, sizes = self.network(g, x, rng)
        whole = [1.0] * (len(sizes) - 1)
        code = np.sort(g.s * g.n + g.d)
        adam, best, waited, curve = Adam(self.lr, self.weight_decay), (np.inf, None), 0, []
        for epoch in range(self.max_epochs):
            if epoch % 25 == 0:
                u = np.maximum(forward(whole)[0], 0)
                val = berpo(g, u, self.balance_loss)
                if val < best[0]:
                    best, waited = (val, u), 0
                else:
                    waited += 1
                    if waited > self.patience:
                        break
            keep = [(rng.random((g.n, n)) >= self.dropout) / (1 - self.dropout) for n in sizes[:-1]]
            out, seen = forward(keep)
            u = np.maximum(out, 0)
            # a batch of edges and as many pairs that are none; or all
            m = min(self.batch_size, len(g.s)) if self.stochastic_loss else len(g.s)
            pick = rng.choice(len(g.s), m, replace=False) if m < len(g.s) else np.arange(len(g.s))
            s, d = g.s[pick], g.d[pick]
            a, b = rng.integers(0, g.n, m), rng.integers(0, g.n, m)
            at = np.minimum(np.searchsorted(code, a * g.n + b), max(len(code) - 1, 0))
            free = (a != b) & (code[at] != a * g.n + b) if len(code) else a != b
            a, b = a[free], b[free]
            eps = -np.log(1 - 1 / max(2, g.n))
            e = np.exp(-eps - (u[s] * u[d]).sum(1))
            gu, ce, cn = np.zeros_like(u), -e / (1 - e) / max(len(s), 1) / 2, 0.5 / max(len(a), 1)
            np.add.at(gu, s, ce[:, None] * u[d])
            np.add.at(gu, d, ce[:, None] * u[s])
            np.add.at(gu, a, cn * u[b])
            np.add.at(gu, b, cn * u[a])
            adam.step(par, backward(gu * (out > 0), seen, keep))
            curve.append(berpo(g, u, self.balance_loss))
        val, u = best
        last = np.maximum(forward(whole)[0], 0)
        u = last if berpo(g, last, self.balance_loss) < val else u
        span = u.max() - u.min()
        return self.result(g, (u - u.min()) / span if span > 0 else u, history=curve, n_iter=len(curve), extras={"loss": min(val, berpo(g, u, self.balance_loss))})


__all__ = ["BIGCLAM", "BayesianNMF", "MMSB", "CDCGS", "DMoN", "NOCD", "Graph", "dirichlet"]
