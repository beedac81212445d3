"""Validity indices of soft and crisp partitions, as aggregations.

Memberships are (id, k, u), points (id, features), labels (id, label), centres (k, c array<double>). Undefined indices are NaN. Ids must be
unique in points and labels; rows without a partner do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators.base import Points
from penumbra.functions.membership import sqdist

NAN = float("nan")
LABELS = 100_000


def sq(a: str, b: str):
    """Squared distance of two array columns."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")


def is_partition(u: DataFrame, tol: float = 1e-6) -> bool:
    r = u.groupBy("id").agg(F.sum("u").alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]
    return r is not None and r <= tol


def partition_indices(u: DataFrame) -> DataFrame:
    """One row: partition_coefficient, partition_entropy, modified_partition_coefficient; NaN unless the rows sum to one."""
    rows = u.groupBy("id").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"), F.sum(-F.col("u") * F.ln(F.col("u") + 1e-12)).alias("e"), F.max("k").alias("k"))
    a = rows.agg(F.avg("q").alias("pc"), F.avg("e").alias("pe"), (F.max("k") + 1).alias("k"), F.max(F.abs(F.col("s") - 1)).alias("off"))
    ok = F.col("off") <= 1e-6
    mpc = F.when(ok & (F.col("k") > 1), (F.col("pc") - 1 / F.col("k")) / (1 - 1 / F.col("k"))).otherwise(NAN)
    return a.select(F.when(ok, F.col("pc")).otherwise(NAN).alias("partition_coefficient"), F.when(ok, F.col("pe")).otherwise(NAN).alias("partition_entropy"), mpc.alias("modified_partition_coefficient"))


def weighted(points: DataFrame, u: DataFrame, centers: DataFrame, m: float) -> DataFrame:
    """(id, k, w, d2, x, c): points with their weights u**m and squared distances to the centres, which are few and sent to all tasks."""
    c = F.broadcast(centers.select(F.col("k").cast("int").alias("k"), F.col("c")))
    j = u.join(points.select("id", F.col("features").alias("x")), "id").join(c, "k")
    return j.select("id", "k", F.pow("u", F.lit(m)).alias("w"), sq("x", "c").alias("d2"), "x", "c")


def prototype_indices(points: DataFrame, u: DataFrame, centers: DataFrame, m: float = 2.0) -> DataFrame:
    """One row: xie_beni_index, fuzzy_separation_index, fuzzy_compactness."""
    a, b = centers.alias("a"), centers.alias("b")
    pairs = a.join(b, F.col("a.k") < F.col("b.k")).select(sq("a.c", "b.c").alias("d2"))  # pairs of centres
    sep = pairs.agg(F.avg(F.sqrt("d2")).alias("sep"), F.min(F.when(F.col("d2") > 0, F.col("d2"))).alias("least"), F.count(F.lit(1)).alias("p"))
    t = weighted(points, u, centers, m).agg(F.sum(F.col("w") * F.col("d2")).alias("comp"), F.countDistinct("id").alias("n"))
    xb = F.when(F.col("p") == 0, NAN).when(F.col("least").isNull(), float("inf")).otherwise(F.col("comp") / (F.col("n") * F.col("least")))
    return t.crossJoin(sep).select(xb.alias("xie_beni_index"), F.when(F.col("p") == 0, NAN).otherwise(F.col("sep")).alias("fuzzy_separation_index"), F.col("comp").alias("fuzzy_compactness"))  # one row each


def fuzzy_hypervolume(points: DataFrame, u: DataFrame, centers: DataFrame, m: float = 2.0) -> float:
    """Sum of the square roots of the determinants of the fuzzy covariances."""
    import numpy as np

    d = len(centers.first()["c"])
    w = weighted(points, u, centers, m)
    cross = [F.sum(F.col("w") * (F.col("x")[i] - F.col("c")[i]) * (F.col("x")[j] - F.col("c")[j])).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]
    total = 0.0
    for r in w.groupBy("k").agg(F.sum("w").alias("n"), *cross).collect():
        s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / max(r["n"], 1e-300)
        total += float(np.sqrt(max(np.linalg.det(s), 0.0)))
    return total


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ari, nmi (by the arithmetic mean) of two labellings (id, label), from their contingency table."""
    t = a.select("id", F.col("label").cast("string").alias("x")).join(b.select("id", F.col("label").cast("string").alias("y")), "id").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    total = t.agg(F.sum("n").alias("tot"))
    tx, ty = t.groupBy("x").agg(F.sum("n").alias("nx")), t.groupBy("y").agg(F.sum("n").alias("ny"))
    cell = t.agg(F.sum(choose("n")).alias("sxy"))
    ax = tx.crossJoin(F.broadcast(total)).agg(F.sum(choose("nx")).alias("sx"), F.sum(-F.col("nx") / F.col("tot") * F.ln(F.col("nx") / F.col("tot"))).alias("hx"))  # one row on the right
    ay = ty.crossJoin(F.broadcast(total)).agg(F.sum(choose("ny")).alias("sy"), F.sum(-F.col("ny") / F.col("tot") * F.ln(F.col("ny") / F.col("tot"))).alias("hy"))
    mi = t.join(tx, "x").join(ty, "y").crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") / F.col("tot") * F.ln(F.col("n") * F.col("tot") / (F.col("nx") * F.col("ny")))).alias("mi"))
    one = cell.crossJoin(ax).crossJoin(ay).crossJoin(mi).crossJoin(total)
    expected, most = F.col("sx") * F.col("sy") / choose("tot"), (F.col("sx") + F.col("sy")) / 2
    ari = F.when(most == expected, 1.0).otherwise((F.col("sxy") - expected) / (most - expected))
    h = (F.col("hx") + F.col("hy")) / 2
    return one.select(ari.alias("ari"), F.when(h == 0, 1.0).otherwise(F.col("mi") / h).alias("nmi"))


def _clusters(points: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined points, per-cluster means as arrays)."""
    j = points.select("id", F.col("features").alias("x")).join(labels.select("id", "label"), "id")
    long = j.select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return j, long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("c"), F.max("n").alias("n"))


def calinski_davies(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: calinski_harabasz, davies_bouldin; NaN unless there are 2 to n - 1 clusters."""
    j, means = _clusters(points, labels)
    within = j.join(F.broadcast(means.drop("n")), "label").groupBy("label").agg(F.sum(sq("x", "c")).alias("w"), F.avg(F.sqrt(sq("x", "c"))).alias("s"), F.first("c").alias("c"), F.count(F.lit(1)).alias("n"))
    every = j.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("g"))
    between = within.crossJoin(F.broadcast(every)).agg(F.sum(F.col("n") * sq("c", "g")).alias("b"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    a, b = within.alias("a"), within.alias("b")
    worst = a.join(b, F.col("a.label") != F.col("b.label")).groupBy("a.label").agg(F.max((F.col("a.s") + F.col("b.s")) / F.sqrt(sq("a.c", "b.c"))).alias("r")).agg(F.avg("r").alias("db"))
    ok = (F.col("k") > 1) & (F.col("k") < F.col("n"))
    return between.crossJoin(worst).select(F.when(ok, F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).otherwise(NAN).alias("calinski_harabasz"), F.when(ok, F.col("db")).otherwise(NAN).alias("davies_bouldin"))


def silhouette(points: DataFrame, labels: DataFrame, block: int = 4096) -> float:
    """Mean Euclidean silhouette, exact. Queries are taken in blocks and held against all points, whose distances are summed by cluster.

    Labels of any type are numbered, up to LABELS of them; points without one do not count.
    """
    import numpy as np

    kind = labels.schema["label"].dataType.simpleString()
    found = [r[0] for r in labels.select("label").where("label is not null").distinct().orderBy("label").limit(LABELS + 1).collect()]
    if len(found) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    number = points.sparkSession.createDataFrame([(v, i) for i, v in enumerate(found)], f"label {kind}, g int")
    lab = labels.join(F.broadcast(number), "label").select("id", "g")
    p = Points(points.select("id", "features").join(lab, "id").select("id", "features", F.col("g").cast("double").alias("g")), ("g",))
    size_of = {r["g"]: r["n"] for r in p.df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = np.array(sorted(size_of))
    k = len(names)
    if not 1 < k < p.n:
        return NAN
    size = np.array([size_of[v] for v in names], float)
    ids, x, extra = p.all(200_000, "silhouette")
    g, total = np.searchsorted(names, extra[0]), 0.0
    for a in range(0, p.n, block):
        xb, gb = x[a : a + block], g[a : a + block]
        s = p.reduce(lambda i, y, e, xb=xb: (np.sqrt(sqdist(xb, y)) @ np.eye(k)[np.searchsorted(names, e)],))[0]
        own = s[np.arange(len(xb)), gb] / np.maximum(size[gb] - 1, 1)
        mean = s / size
        mean[np.arange(len(xb)), gb] = np.inf
        other = mean.min(1)
        total += float(np.where(size[gb] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0).sum())
    return total / p.n


def membership_metrics(points: DataFrame, u: DataFrame, centers: DataFrame | None, m: float = 2.0) -> dict[str, float]:
    """All seven soft indices; those that need centres are NaN without them."""
    out = partition_indices(u).first().asDict()
    if centers is None or centers.isEmpty():
        return {**out, "fuzzy_hypervolume": NAN, "xie_beni_index": NAN, "fuzzy_separation_index": NAN, "fuzzy_compactness": NAN}
    return {**out, "fuzzy_hypervolume": fuzzy_hypervolume(points, u, centers, m), **prototype_indices(points, u, centers, m).first().asDict()}


def clustering_metrics(points: DataFrame, labels: DataFrame, truth: DataFrame | None = None) -> dict[str, float]:
    """All five crisp indices; ari and nmi are NaN without true labels."""
    out = {"silhouette": silhouette(points, labels), **calinski_davies(points, labels).first().asDict()}
    return {**out, **(agreement(labels, truth).first().asDict() if truth is not None else {"ari": NAN, "nmi": NAN})}
