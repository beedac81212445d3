"""The estimator contract: parameters in, an immutable model of memberships out.

Points are a DataFrame (id, features array<double>). A fit is a loop on the driver over one reduction per step: each block of
rows gives partial sums, which are added up in the order of the partitions. Tables of up to LOCAL_VALUES numbers are held as one block on
the driver, where a step takes less than a job's start; larger ones are cached on the executors and swept in Arrow batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.session import cached, materialize

LOCAL_VALUES = 4_000_000
_SPREAD: ContextVar[bool] = ContextVar("spread", default=False)


@contextmanager
def spread():
    """Within it every fit runs over partitions, as it does beyond the bounds of what is held on the driver."""
    token = _SPREAD.set(True)
    try:
        yield
    finally:
        _SPREAD.reset(token)


def held(limit: int) -> int:
    """How much of something the driver may hold: `limit`, or nothing within `spread`."""
    return 0 if _SPREAD.get() else limit


K_NAMES = ("n_clusters", "c", "k", "K", "n_topics", "n_components", "n_communities", "n_blocks", "c_clusters")


def _block(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(ids, matrix, further columns) of a batch."""
    col = b.column(1)
    d = len(col[0]) if len(col) else 0
    x = col.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(col), d)
    return b.column(0).to_numpy(zero_copy_only=False), x, [_column(b.column(i)) for i in range(2, b.num_columns)]


def _column(a: pa.Array) -> np.ndarray:
    """A column as an array; lists, all of one length, as rows of a matrix."""
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
    return a.to_numpy(zero_copy_only=False)


def _joined(t: pa.Table, extra: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    b = t.combine_chunks().to_batches()
    return _block(b[0]) if b else (np.zeros(0, np.int64), np.zeros((0, 0)), [np.zeros(0)] * extra)


def _once(block: tuple) -> tuple:
    """The rows in the order of their ids; of one id the least by its values, nulls first."""
    ids, x, extra = block
    if len(ids) and (np.diff(ids) > 0).all():
        return block
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():
        more = [np.where(np.isnan(e), -np.inf, e) for e in (np.asarray(e, float) for e in extra)]
        order = np.lexsort([*more[::-1], *x.T[::-1], ids])
        order = order[np.append(True, np.diff(ids[order]) != 0)]
    return ids[order], x[order], [e[order] for e in extra]


class Points:
    """Rows (id, features, further columns) ready for repeated sweeps.

    Rows with a null id or null, NaN or infinite features are left out; a repeated id counts once, by its least values. Features of different lengths raise.
    """

    def __init__(self, df: DataFrame, extra: tuple[str, ...] = (), local_values: int | None = None):
        self.spark: SparkSession = df.sparkSession
        id_col, feat = df.columns[0], "features" if "features" in df.columns else df.columns[1]
        clean = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(feat).cast("array<double>").alias("features"), *extra)
        clean = clean.where("id is not null and features is not null and size(features) > 0 and forall(features, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
        s = clean.agg(F.count(F.lit(1)), F.min(F.size("features")), F.max(F.size("features"))).first()
        self.n, self.d = s[0], s[2] or 0
        if s[1] != s[2]:
            raise ValueError(f"features have {s[1]} to {s[2]} values")
        self.df, self.local = clean, None
        if self.n * max(1, self.d) <= (held(LOCAL_VALUES) if local_values is None else local_values):
            self.local = _once(_joined(clean.toArrow(), len(extra)))
            self.n = len(self.local[0])
            return
        self.df = clean.groupBy("id").agg(F.min(F.struct("features", *extra)).alias("_r")).select("id", "_r.*")
        cached(self.df, self)
        self.n = self.df.count()

    def reduce(self, fn: Callable[..., tuple]) -> list[np.ndarray]:
        """Sums over all blocks of what fn(ids, x, *extra) gives (a tuple of arrays)."""
        if self.local is not None:
            ids, x, extra = self.local
            return [np.asarray(a, float) for a in fn(ids, x, *extra)]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = None
            for b in batches:
                if b.num_rows:
                    ids, x, extra = _block(b)
                    got = [np.asarray(a, float) for a in fn(ids, x, *extra)]
                    acc = got if acc is None else [p + q for p, q in zip(acc, got)]
            if acc is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(acc)])], names=["v"])

        parts = self.df.mapInArrow(part, "v binary").withColumn("p", F.spark_partition_id()).orderBy("p").collect()
        total = None
        for r in parts:
            got = pickle.loads(r["v"])
            total = got if total is None else [a + b for a, b in zip(total, got)]
        return total or []

    def assign(self, fn: Callable[..., np.ndarray]) -> DataFrame:
        """Rows (id, k, u) of what fn(ids, x, *extra) gives, an (n, k) array."""
        if self.local is not None:
            ids, x, extra = self.local
            return long_form(self.spark, ids, fn(ids, x, *extra))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids, x, extra = _block(b)
                    u = np.asarray(fn(ids, x, *extra), float)
                    n, k = u.shape
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(u.ravel())], names=["id", "k", "u"])

        return self.df.mapInArrow(run, "id bigint, k int, u double")

    def attach(self, fn: Callable[..., np.ndarray], replace: bool = False) -> "Points":
        """The same points with what fn(ids, x, *extra) gives, an (n, k) array, as one column more, or in place of the last; written out if they are spread."""
        q = Points.__new__(Points)
        q.spark, q.n, q.d, q.local, q.df = self.spark, self.n, self.d, self.local, self.df
        if self.local is not None:
            ids, x, extra = self.local
            q.local = (ids, x, [*(extra[:-1] if replace else extra), np.asarray(fn(ids, x, *extra), float)])
            return q
        fields = [(f.name, f.dataType.simpleString()) for f in self.df.schema.fields]
        fields = fields[:-1] if replace else fields

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = np.asarray(fn(*(blk := _block(b))[:2], *blk[2]), float)
                    cut = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], pa.ListArray.from_arrays(cut, pa.array(v.ravel()))], names=[*(f for f, _ in fields), f"_state{len(fields)}"])

        q.df = materialize(self.df.mapInArrow(run, ", ".join(f"`{f}` {t}" for f, t in [*fields, (f"_state{len(fields)}", "array<double>")])), "points")
        return q

    def first(self, key: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, features) of the k rows of least key(ids, x); of equal ones the least id."""

        def top(ids, x):
            v = key(ids, x)
            o = np.lexsort((ids, v))[:k]
            return ids[o], x[o], v[o]

        if self.local is not None:
            ids, x, _ = self.local
            return top(ids, x)[:2]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    ids, x, v = top(*_block(b)[:2])
                    yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(ids), pa.array(list(x))], names=["v", "id", "features"])

        rows = self.df.mapInArrow(run, "v double, id bigint, features array<double>").orderBy("v", "id").limit(k).collect()
        return np.array([r["id"] for r in rows]), np.array([r["features"] for r in rows])

    def all(self, limit: int, why: str) -> tuple:
        """All rows as (ids, x, extra) on the driver, for steps that are not linear in them; more than `limit` rows raise."""
        if self.n > limit:
            raise ValueError(f"{self.n} rows: {why} is limited to {limit}")
        if self.local is None:
            return _once(_joined(self.df.toArrow(), 0))
        return self.local


def long_form(spark: SparkSession, ids: np.ndarray, u: np.ndarray) -> DataFrame:
    n, k = u.shape
    return spark.createDataFrame(pa.table({"id": pa.array(np.repeat(ids, k).astype(np.int64)), "k": pa.array(np.tile(np.arange(k, dtype=np.int32), n)), "u": pa.array(np.asarray(u, float).ravel())}))


class Extras(dict):
    """What else an operator publishes; what is given as a function is made when it is first asked for."""

    def __init__(self, now: dict[str, Any], later: dict[str, Callable[[], Any]]):
        super().__init__({**now, **dict.fromkeys(later)})
        self.later = dict(later)

    def __getitem__(self, name: str) -> Any:
        if name in self.later:
            self[name] = self.later.pop(name)()
        return super().__getitem__(name)


@dataclass
class Model:
    """What a fit gives. memberships: (id, k, u). centers: (k, d) or None. extras: by name, what else the operator publishes.

    source is the memberships or makes them when they are first asked for.
    """

    name: str
    source: DataFrame | Callable[[], DataFrame]
    n_clusters: int
    centers: np.ndarray | None = None
    history: list[float] = field(default_factory=list)
    n_iter: int = 0
    constrained: bool = True
    extras: dict[str, Any] = field(default_factory=dict)
    rule: Callable[[np.ndarray], np.ndarray] | None = None

    @property
    def memberships(self) -> DataFrame:
        if callable(self.source):
            self.source = self.source()
        return self.source

    def labels(self) -> DataFrame:
        """(id, label): the cluster of largest membership, the lowest of equal ones."""
        return self.memberships.groupBy("id").agg((-F.max(F.struct("u", (-F.col("k")).alias("m")))["m"]).alias("label"))

    predict = labels

    def predict_proba(self) -> DataFrame:
        return self.memberships

    def crisp(self) -> DataFrame:
        return self.labels().select("id", F.col("label").alias("k"), F.lit(1.0).alias("u"))

    def centers_df(self, spark: SparkSession) -> DataFrame:
        c = self.centers if self.centers is not None else np.zeros((0, 0))
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "k int, c array<double>")

    def transform(self, df: DataFrame) -> DataFrame:
        """Memberships of new points; only operators with a rule for points not fitted have one."""
        if self.rule is None:
            raise NotImplementedError(f"{self.name} has no rule for points that were not fitted")
        rule = self.rule
        return Points(df).assign(lambda ids, x: rule(x))

    def is_partition(self, tol: float = 1e-6) -> bool:
        r = self.memberships.groupBy("id").agg(F.sum("u").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]
        return r is not None and r <= tol


REGISTRY: dict[str, type] = {}


def register(cls: type) -> type:
    REGISTRY[cls.__name__] = cls
    return cls


class Estimator:
    """Base of all operators: PARAMS are names and defaults; the number of clusters may be given under any of K_NAMES."""

    PARAMS: dict[str, Any] = {}
    CONSTRAINED = True
    FINDS_K = False

    def __init__(self, **params: Any):
        self.params = dict(self.PARAMS)
        self.set_params(**params)

    def set_params(self, **params: Any) -> "Estimator":
        for name, value in params.items():
            if name not in self.PARAMS and name in K_NAMES and (own := [n for n in K_NAMES if n in self.PARAMS]):
                name = own[0]
            if name == "random_state":
                name = "seed"
            if name not in self.PARAMS:
                raise ValueError(f"{type(self).__name__} has no parameter {name}; it has {sorted(self.PARAMS)}")
            self.params[name] = value
        self.check()
        return self

    def check(self) -> None:
        """Raises ValueError on parameters that make no sense."""
        p = self.params
        if p.get("m", 2.0) <= 1.0:
            raise ValueError(f"m must be larger than 1: {p['m']}")
        if p.get("k") is not None and p["k"] < 1:
            raise ValueError(f"k must be at least 1: {p['k']}")

    def get_params(self) -> dict[str, Any]:
        return dict(self.params)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.params.items())})"

    def __getattr__(self, name: str) -> Any:
        params = self.__dict__.get("params", {})
        if name in params:
            return params[name]
        raise AttributeError(name)

    def fit(self, df: DataFrame, *args: Any) -> Model:
        raise NotImplementedError

    def fit_predict(self, df: DataFrame, *args: Any) -> DataFrame:
        return self.fit(df, *args).labels()

    def points(self, df: DataFrame | Points, extra: tuple[str, ...] = ()) -> Points:
        p = df if isinstance(df, Points) else Points(df, extra)
        k = self.params.get("k")
        if k is not None and k > p.n:
            raise ValueError(f"k={k} is more than the {p.n} points")
        return p

    def start(self, p: Points, how: str = "random") -> np.ndarray:
        """The centres given as `init`, else drawn: kmeans++ by distance, or k rows at random, both by a hash of id and seed."""
        init = self.params.get("init")
        if init is not None and not isinstance(init, str):
            return np.array(init, float)
        return kmeanspp(p, self.k, self.seed or 0) if how == "kmeans++" else random_rows(p, self.k, self.seed or 0)

    def model(self, p: Points, fn: Callable[..., np.ndarray], k: int, **more: Any) -> Model:
        return Model(type(self).__name__, lambda: p.assign(fn), k, constrained=self.CONSTRAINED, **more)


def random_rows(p: Points, k: int, seed: int) -> np.ndarray:
    from penumbra.functions.membership import uniform

    return p.first(lambda ids, x: uniform(ids, 1, seed)[:, 0], k)[1]


def kmeanspp(p: Points, k: int, seed: int) -> np.ndarray:
    """Rows drawn with a chance in proportion to the squared distance to those drawn before; one sweep each (exponential races)."""
    from penumbra.functions.membership import sqdist, uniform

    c = p.first(lambda ids, x: uniform(ids, 1, seed)[:, 0], 1)[1]
    while len(c) < k:

        def race(ids, x, c=c, s=seed + len(c)):
            d = sqdist(x, c).min(1)
            return -np.log(uniform(ids, 1, s)[:, 0]) / np.maximum(d, 1e-300)

        c = np.vstack([c, p.first(race, 1)[1]])
    return c


def frame(spark: SparkSession, pdf: pd.DataFrame, schema: str) -> DataFrame:
    return spark.createDataFrame(pdf, schema)
