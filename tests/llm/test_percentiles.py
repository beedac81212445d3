import math
import random

from penumbra.llm import percentiles as pc

QS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def brute(vals):
    v = sorted(vals)
    return [v[max(1, math.ceil(q * len(v))) - 1] for q in QS.values()]


def make(spark, n=3000):
    r = random.Random(1)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, float("nan"), 0.0, -0.0, -3.5, float("inf"), *[math.exp(r.gauss(2, 2)) for _ in range(9)]]), r.randint(1, 3), "x") for _ in range(n)]
    return rows, spark.createDataFrame(rows, "g string, v double, day int, n string")


def test_exact_by_brute_force(spark):
    rows, df = make(spark)
    got = {r["g"]: r for r in pc.percentiles(pc.summarise(df, ["g"], "v"), ["g"], QS).collect()}
    for g in ("hot", "b", None):
        vals = [v for k, v, *_ in rows if k == g and v is not None and not math.isnan(v)]
        assert got[g]["total"] == len(vals) and [got[g][q] for q in QS] == brute(vals)


def test_days_put_together_are_the_whole(spark):
    _, df = make(spark)
    whole = pc.summarise(df, ["g"], "v", 0.01)
    days = [pc.summarise(df.where(f"day = {d}"), ["g"], "v", 0.01) for d in (1, 2, 3)]
    fine = pc.combine(pc.summarise(df, ["g", "day"], "v", 0.01), ["g"])
    a, b, c = ({tuple(r) for r in pc.percentiles(s, ["g"], QS).collect()} for s in (whole, pc.combine(days, ["g"]), fine))
    assert a == b == c


def test_value_error_is_bounded(spark):
    rows, df = make(spark)
    exact = {r["g"]: r for r in pc.percentiles(pc.summarise(df, ["g"], "v"), ["g"], QS).collect()}
    for r in pc.percentiles(pc.summarise(df, ["g"], "v", 0.02), ["g"], QS).collect():
        for q in QS:
            x, y = exact[r["g"]][q], r[q]
            assert x == y or abs(x - y) <= 0.02 * abs(x) * (1 + 1e-9)


def test_nothing_to_count(spark):
    _, df = make(spark, 10)
    assert pc.percentiles(pc.summarise(df.limit(0), ["g"], "v"), ["g"], QS).count() == 0
    assert pc.percentiles(pc.summarise(df.selectExpr("g", "double(null) v"), ["g"], "v"), ["g"], QS).count() == 0


def test_ranks_of_shares_that_doubles_do_not_hold(spark):
    df = spark.range(1, 101).selectExpr("1 as g", "double(id) as v")
    qs = {f"p{q}": q / 100 for q in (0, 7, 14, 28, 55, 56, 57, 100)}
    r = pc.percentiles(pc.summarise(df, ["g"], "v"), ["g"], qs).first()
    assert {n: r[n] for n in qs} == {f"p{q}": float(max(q, 1)) for q in (0, 7, 14, 28, 55, 56, 57, 100)}
