"""Data sets: generators of synthetic points on the cluster, and readers of tables in files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.functions.membership import uniform

SCHEMA = "id bigint, features array<double>, label int"


def normal(ids: np.ndarray, d: int, seed: int) -> np.ndarray:
    """Standard normals that depend on id, column and seed only."""
    a, b = uniform(ids, d, seed), uniform(ids, d, seed + 7_777_777)
    return np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)


def _blobs(k: int, d: int, spread: Callable[[np.ndarray], np.ndarray], turn: np.ndarray | None = None, box: float = 10.0):
    def make(ids: np.ndarray, n: int, seed: int):
        c = uniform(np.arange(k), d, seed + 1) * 2 * box - box
        y = (ids * k) // max(n, 1)
        x = c[y] + normal(ids, d, seed + 2) * spread(y)[:, None]
        return (x @ turn if turn is not None else x), y

    return make


def _moons(ids, n, seed):
    y = (2 * ids >= n).astype(int)
    t = np.pi * uniform(ids, 1, seed)[:, 0]
    x = np.where(y[:, None] == 0, np.column_stack([np.cos(t), np.sin(t)]), np.column_stack([1 - np.cos(t), 0.5 - np.sin(t)]))
    return x + 0.05 * normal(ids, 2, seed + 2), y


def _circles(ids, n, seed):
    y = (2 * ids >= n).astype(int)
    t = 2 * np.pi * uniform(ids, 1, seed)[:, 0]
    return np.column_stack([np.cos(t), np.sin(t)]) * np.where(y == 0, 1.0, 0.5)[:, None] + 0.05 * normal(ids, 2, seed + 2), y


one = lambda y: np.ones(len(y))
# fixed values: names of data sets and groups, numbers of clusters and dimensions, spreads and the turn of the usual synthetic sets
SYNTHETIC: dict[str, Callable] = {
    "blobs": _blobs(3, 2, one),
    "moons": _moons,
    "circles": _circles,
    "anisotropic_blobs": _blobs(3, 2, one, np.array([[0.6, -0.6], [-0.4, 0.8]])),
    "varied_blobs": _blobs(3, 2, lambda y: np.array([1.0, 2.5, 0.5])[y]),
    "high_dimensional_blobs": _blobs(5, 50, one),
}
# read from a folder of files, as they are not made here: a CSV or Parquet file of this name with a last column or a column `label`
REAL = ("iris", "wine", "digits", "breast_cancer", "olivetti_faces")
OPENML = ("glass", "vehicle", "ecoli", "yeast", "segment", "satimage", "letter", "pendigits", "optdigits")
GROUPS = {"synthetic": tuple(SYNTHETIC), "real": REAL, "openml": OPENML}


def available_groups() -> list[str]:
    return sorted(GROUPS)


def available_datasets() -> list[str]:
    return [n for g in GROUPS.values() for n in g]


def datasets_in_group(group: str) -> list[str]:
    if group not in GROUPS:
        raise ValueError(f"no group {group}; there are {available_groups()}")
    return list(GROUPS[group])


def get_dataset(spark: SparkSession, name: str, n: int = 500, seed: int = 42, folder: str | None = None) -> DataFrame:
    """(id, features, label) of a data set; names are taken in any letter case. Synthetic ones are the same however they are partitioned."""
    key = name.lower()
    if key in SYNTHETIC:
        make = SYNTHETIC[key]

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in it:
                ids = b["id"].to_numpy()
                x, y = make(ids, n, seed)
                yield pd.DataFrame({"id": ids, "features": list(x), "label": y})

        return spark.range(n).mapInPandas(run, SCHEMA)
    if key not in available_datasets():
        raise ValueError(f"no data set {name}; there are {available_datasets()}")
    if folder is None:
        raise ValueError(f"{name} is read from files: give their folder")
    return read_table(spark, f"{folder}/{key}")


def read_table(spark: SparkSession, path: str, label: str = "label") -> DataFrame:
    """(id, features, label) of a Parquet or CSV table of numbers. Ids are given by the place of a row in its files, so that equal rows stay apart."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    label = label if label in df.columns else df.columns[-1]
    feats = [c for c, t in df.dtypes if c != label and t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    return df.select(F.monotonically_increasing_id().alias("id"), F.array(*[F.col(c).cast("double") for c in feats]).alias("features"), F.col(label).alias("label"))


def dataset_info(df: DataFrame) -> dict[str, int]:
    r = df.agg(F.count(F.lit(1)), F.max(F.size("features")), F.countDistinct("label")).first()
    return {"rows": r[0], "features": r[1], "classes": r[2]}


def benchmark_suite(spark: SparkSession, groups: tuple[str, ...] = ("synthetic",), n: int = 500, seed: int = 42, folder: str | None = None) -> dict[str, DataFrame]:
    return {name: get_dataset(spark, name, n, seed, folder) for g in groups for name in datasets_in_group(g)}
