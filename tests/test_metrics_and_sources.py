import json

import numpy as np
import pytest

from penumbra.functions import metrics
from penumbra.operators.mixtures import GMM
from penumbra.operators.prototypes import FCM
from penumbra.sources import benchmarking, datasets


def test_constants(spark):
    u = spark.createDataFrame([(i, k, 0.5) for i in range(4) for k in range(2)], "id bigint, k int, u double")
    r = metrics.partition_indices(u).first()
    assert abs(r["partition_coefficient"] - 0.5) < 1e-9 and abs(r["modified_partition_coefficient"]) < 1e-9 and abs(r["partition_entropy"] - np.log(2)) < 1e-9
    off = u.withColumn("u", u["u"] * 1.5)
    assert np.isnan(metrics.partition_indices(off).first()["partition_coefficient"]) and metrics.is_partition(u) and not metrics.is_partition(off)
    p = spark.createDataFrame([(i, [float(i % 2) * 3, float(i % 2) * 4]) for i in range(4)], "id bigint, features array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "k int, c array<double>")
    assert metrics.prototype_indices(p, u, c).first()["fuzzy_separation_index"] == 5.0
    same = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 1.0])], "k int, c array<double>")
    assert metrics.prototype_indices(p, u, same).first()["xie_beni_index"] == float("inf")


def test_silhouette_by_brute_force(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(40, 2)), r.integers(0, 3, 40)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(40):
        own = [d[i, j] for j in range(40) if y[j] == y[i] and j != i]
        other = min(np.mean([d[i, j] for j in range(40) if y[j] == c]) for c in set(y) - {y[i]})
        s.append((other - np.mean(own)) / max(other, np.mean(own)) if own else 0.0)
    p = spark.createDataFrame([(i, [float(v) for v in q]) for i, q in enumerate(x)], "id bigint, features array<double>")
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id bigint, label int")
    assert abs(metrics.silhouette(p, lab, block=7) - np.mean(s)) < 1e-9
    assert np.isnan(metrics.silhouette(p, lab.selectExpr("id", "0 as label")))
    text = lab.selectExpr("id", "concat('c', label) as label").unionByName(spark.createDataFrame([(999, None)], "id bigint, label string"))
    assert abs(metrics.silhouette(p, text) - np.mean(s)) < 1e-9


def test_datasets(spark):
    for name in datasets.datasets_in_group("synthetic"):
        a = datasets.get_dataset(spark, name.upper(), n=60)
        assert datasets.dataset_info(a)["rows"] == 60
        assert sorted(map(str, a.collect())) == sorted(map(str, datasets.get_dataset(spark, name, n=60).repartition(3).collect()))
    with pytest.raises(ValueError):
        datasets.get_dataset(spark, "nothing")


def test_benchmark(spark, tmp_path):
    d = datasets.get_dataset(spark, "blobs", n=60)
    run = benchmarking.ClusteringBenchmark([FCM(k=3), GMM(k=3), FCM(k=500)], [benchmarking.RuntimeBenchmark(1), benchmarking.MemoryBenchmark(warmup=False), benchmarking.ClusteringQualityBenchmark()])
    rep = run.run(d, d.select("id", "label"))
    assert rep.rows["error"].isna().tolist() == [True, True, False] and rep.rows["ari"][0] > 0.3
    rep.to_csv(str(tmp_path / "r.csv"))
    assert [r["model"] for r in json.loads(rep.to_json(str(tmp_path / "r.json")))] == ["FCM", "GMM", "FCM"] and (tmp_path / "r.json").exists()
    tex = rep.to_latex(str(tmp_path / "r.tex"), caption="Fits & times")
    assert tex.count(r"\\") == 4 and r"fit\_time\_mean" in tex and r"Fits \& times" in tex and "--" in tex
    for bad in (None, {}, {1: 2.0}, {"a": "x"}, {"a": True}):
        with pytest.raises(TypeError):
            benchmarking.Benchmark.validate_result(bad)
    assert benchmarking.Benchmark.to_dataframe({"a": {"t": 1.0}, "b": {"t": 2.0}}).values.tolist() == [["a", 1.0], ["b", 2.0]]
    assert rep.to_markdown().count("\n") == 5 and rep.leaderboard("ari").shape == (3, 2)
    assert "runtime_30" in benchmarking.ScalabilityBenchmark((30, 5000)).evaluate(FCM(k=2), d)
