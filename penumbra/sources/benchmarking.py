"""Benchmarks of operators: time, memory, growth and quality, one row per model, with a report."""

from __future__ import annotations

import threading
import time
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions import metrics
from penumbra.operators.base import Estimator, Model


class Adapter:
    """Gives an estimator of another library (with fit and transform of Spark ML) the contract of ours: memberships from its probability."""

    def __init__(self, estimator: Any, features: str = "features", probability: str = "probability"):
        self.estimator, self.features, self.probability = estimator, features, probability

    def fit(self, df: DataFrame) -> Model:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        v = df.select("id", array_to_vector(F.col(self.features)).alias(self.features))
        m = self.estimator.fit(v)
        t = m.transform(v)
        if self.probability in t.columns:
            u = t.select("id", F.posexplode(vector_to_array(self.probability)).alias("k", "u"))
        else:
            u = t.select("id", F.col("prediction").cast("int").alias("k"), F.lit(1.0).alias("u"))
        centers = getattr(m, "clusterCenters", lambda: None)()
        return Model(type(self.estimator).__name__, u, self.estimator.getK(), centers=pd.DataFrame(centers).to_numpy() if centers is not None else None)


def model_name(model: Any) -> str:
    return type(getattr(model, "estimator", model)).__name__


class Benchmark:
    """Base: evaluate gives a dict of numbers for one model."""

    def evaluate(self, model: Estimator, df: DataFrame, truth: DataFrame | None = None) -> dict[str, float]:
        raise NotImplementedError

    @staticmethod
    def validate_result(result: Any) -> dict[str, float]:
        """The result, if it is a dict of names and numbers; else an error."""
        if not isinstance(result, dict) or not result:
            raise TypeError(f"a benchmark gives a dict of numbers, not {type(result).__name__}")
        for name, value in result.items():
            if not isinstance(name, str):
                raise TypeError(f"{name!r} is no name")
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f"{name} is no number: {value!r}")
        return result

    @staticmethod
    def to_dataframe(results: dict[str, dict[str, float]]) -> pd.DataFrame:
        """One row for each model, its name in front."""
        return pd.DataFrame([{"model": name, **row} for name, row in results.items()])


def _run(model: Estimator, df: DataFrame) -> Model:
    m = model.fit(df)
    m.memberships.agg(F.sum("u")).collect()
    return m


class RuntimeBenchmark(Benchmark):
    def __init__(self, n_repeats: int = 3):
        self.n_repeats = n_repeats

    def evaluate(self, model, df, truth=None):
        fit, read = [], []
        for _ in range(self.n_repeats):
            t = time.perf_counter()
            m = _run(model, df)
            fit.append(time.perf_counter() - t)
            t = time.perf_counter()
            m.labels().agg(F.count(F.lit(1))).collect()
            read.append(time.perf_counter() - t)
        s = pd.Series
        return {"fit_time_mean": s(fit).mean(), "fit_time_std": s(fit).std(ddof=0), "predict_time_mean": s(read).mean(), "predict_time_std": s(read).std(ddof=0)}


def rss_mb() -> float:
    with open("/proc/self/status") as f:
        return next(int(x.split()[1]) / 1024 for x in f if x.startswith("VmRSS"))


class MemoryBenchmark(Benchmark):
    """Resident memory of the driver, sampled while the model is fitted."""

    def __init__(self, poll_interval: float = 0.01, warmup: bool = True):
        self.poll_interval, self.warmup = poll_interval, warmup

    def evaluate(self, model, df, truth=None):
        if self.warmup:
            _run(model, df)
        base, seen, stop = rss_mb(), [], threading.Event()

        def sample():
            while not stop.is_set():
                seen.append(rss_mb())
                stop.wait(self.poll_interval)

        t = threading.Thread(target=sample, daemon=True)
        t.start()
        try:
            _run(model, df)
        finally:
            stop.set()
            t.join()
        peak = max([base, *seen])
        return {"memory_peak_mb": peak, "memory_increase_mb": peak - base}


class ScalabilityBenchmark(Benchmark):
    """Time and memory on subsets chosen by a hash of the id."""

    def __init__(self, sizes: tuple[int, ...] = (100, 500, 1000, 5000, 10000), seed: int = 42):
        self.sizes, self.seed = sizes, seed

    def evaluate(self, model, df, truth=None):
        n, out = df.count(), {}
        for size in self.sizes:
            if size > n:
                continue
            sub = df.where(F.pmod(F.xxhash64("id", F.lit(self.seed)), F.lit(1_000_000)) < int(1_000_000 * size / n))
            out[f"runtime_{size}"] = RuntimeBenchmark(1).evaluate(model, sub)["fit_time_mean"]
            out[f"memory_{size}"] = MemoryBenchmark(warmup=False).evaluate(model, sub)["memory_increase_mb"]
        return out


class ClusteringQualityBenchmark(Benchmark):
    def __init__(self, m: float = 2.0):
        self.m = m

    def evaluate(self, model, df, truth=None):
        m = _run(model, df)
        centers = m.centers_df(df.sparkSession) if m.centers is not None else None
        return {**metrics.membership_metrics(df, m.memberships, centers, self.m), **metrics.clustering_metrics(df, m.labels(), truth)}


class ClusteringBenchmark:
    """Every model by every benchmark; a model that fails gets a row with its error."""

    def __init__(self, models: list, benchmarks: list[Benchmark]):
        self.models, self.benchmarks = models, benchmarks

    def run(self, df: DataFrame, truth: DataFrame | None = None) -> "BenchmarkReport":
        rows = []
        for model in self.models:
            row: dict[str, Any] = {"model": model_name(model), "error": None}
            for b in self.benchmarks:
                try:
                    row.update(b.validate_result(b.evaluate(model, df, truth)))
                except Exception as e:  # noqa: BLE001
                    row["error"] = f"{type(e).__name__}: {str(e)[:200]}"
            rows.append(row)
        return BenchmarkReport(pd.DataFrame(rows))


class BenchmarkReport:
    def __init__(self, rows: pd.DataFrame):
        self.rows = rows

    def to_csv(self, path: str) -> None:
        self.rows.to_csv(path, index=False)

    def to_markdown(self) -> str:
        cols = list(self.rows.columns)
        cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(cell(v) for v in r) + " |" for r in self.rows.itertuples(index=False))]) + "\n"

    def to_json(self, path: str | None = None) -> str:
        """A JSON list with an object for each model, NaN as null; also written to `path`."""
        text = self.rows.to_json(orient="records", indent=2)
        if path:
            with open(path, "w") as f:
                f.write(text)
        return text

    def to_latex(self, path: str | None = None, caption: str | None = None) -> str:
        """A booktabs table; numbers with four significant digits, missing ones as a dash, characters that LaTeX reads as commands escaped."""
        special = {**{c: "\\" + c for c in "&%$#_{}"}, "\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}

        def cell(v: Any) -> str:
            if v is None or (isinstance(v, float) and pd.isna(v)):
                return "--"
            return f"{v:.4g}" if isinstance(v, float) else "".join(special.get(c, c) for c in str(v))

        cols = list(self.rows.columns)
        line = lambda row: " & ".join(cell(v) for v in row) + r" \\"
        head = [r"\begin{table}", r"\centering", *([r"\caption{" + cell(caption) + "}"] if caption else []), r"\begin{tabular}{l" + "r" * (len(cols) - 1) + "}", r"\toprule", line(cols), r"\midrule"]
        text = "\n".join([*head, *(line(r) for r in self.rows.itertuples(index=False)), r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"
        if path:
            with open(path, "w") as f:
                f.write(text)
        return text

    def summary(self) -> pd.DataFrame:
        return self.rows.describe()

    def leaderboard(self, metric: str, ascending: bool = False) -> pd.DataFrame:
        return self.rows.sort_values(metric, ascending=ascending)[["model", metric]].reset_index(drop=True)
