import numpy as np

from penumbra.llm import rankwalk

R = np.random.default_rng(0)
ROWS = [(g, f"a{i:02}", *[None if R.random() < 0.1 else float("nan") if R.random() < 0.05 else float(v) for v in R.integers(0, 9, 3)], "z") for g in (1, 2) for i in range(14)]
SCHEMA = "g bigint, a string, x double, y double, z double, share string"
SCORES = {"x": 1, "y": -1, "z": 1}


def dense(worse):
    n, m = worse.shape
    p = np.zeros((n, n))
    for s in range(m):
        better = (worse[:, s][None, :] < worse[:, s][:, None]).astype(float)
        k = better.sum(1)
        for i in range(n):
            p[i] += (better[i] / k[i] if k[i] else np.full(n, 1 / n)) / m
    pi = np.full(n, 1 / n)
    for _ in range(500):
        pi = 0.15 / n + 0.85 * (pi @ p)
    return pi


def want(g):
    w = np.array([[1e9 if v is None or np.isnan(v) else -s * v for v, s in zip(r[2:5], SCORES.values())] for r in ROWS if r[0] == g])
    return dense(w) / dense(-w)


def test_against_the_dense_chain_in_one_task_and_spread(spark):
    df = spark.createDataFrame(ROWS + ROWS[:6] + [(None, "a", 1.0, 1.0, 1.0, ""), (3, None, 1.0, 1.0, 1.0, ""), (4, "only", None, None, None, "")], SCHEMA)
    for local in (rankwalk.LOCAL, 3):
        got = rankwalk.rank_walk(df, "g", "a", SCORES, local=local).collect()
        assert len(got) == 29
        for g in (1, 2):
            mine = {r["a"]: r for r in got if r["g"] == g}
            w = want(g)
            assert max(abs(mine[f"a{i:02}"]["share"] - w[i]) for i in range(14)) < 1e-6
            assert sorted(r["position"] for r in mine.values()) == list(range(1, 15))
        assert [(r["share"], r["position"]) for r in got if r["g"] == 4] == [(1.0, 1)]


def test_ranges_do_not_matter(spark):
    df = spark.createDataFrame([r for r in ROWS], SCHEMA)
    a = rankwalk.rank_walk(df, "g", "a", SCORES).select("g", "a", "position")
    b = rankwalk.rank_walk(df.selectExpr("g", "a", "x * 1e9 as x", "exp(y) as y", "z / 7 - 3 as z"), "g", "a", SCORES).select("g", "a", "position")
    assert set(map(tuple, a.collect())) == set(map(tuple, b.collect()))


def test_an_all_round_item_beats_a_specialist(spark):
    rows = [(1, "round", 8.0, 8.0, 8.0, 8.0), (1, "special", 9.0, 9.0, 0.0, 0.0), *[(1, f"o{i}", float(i), float(i), float(i) + 0.5, float(i) + 0.5) for i in range(1, 8)]]
    df = spark.createDataFrame(rows, "g bigint, a string, p double, q double, r double, s double")
    assert [r["a"] for r in rankwalk.best(rankwalk.rank_walk(df, "g", "a", dict.fromkeys("pqrs", 1))).collect()] == ["round"]


def test_ties_and_empty(spark):
    df = spark.createDataFrame([(1, n, 5.0, 5.0, 5.0, "") for n in ("b", "a", "c")], SCHEMA)
    assert [r["a"] for r in rankwalk.rank_walk(df, "g", "a", SCORES).orderBy("position").collect()] == ["a", "b", "c"]
    assert rankwalk.rank_walk(df.limit(0), "g", "a", SCORES).count() == 0


def test_groups_walked_together_rank_as_alone(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(g, f"i{i}", *[float(v) for v in r.integers(0, 6, 3)], "") for g in range(40) for i in range(int(r.integers(1, 30)))]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(rankwalk, "BATCH", 300)
    few = {(x["g"], x["a"]): (x["share"], x["position"]) for x in rankwalk.rank_walk(df, "g", "a", SCORES).collect()}
    monkeypatch.setattr(rankwalk, "BATCH", 1_000_000)
    all_ = {(x["g"], x["a"]): (x["share"], x["position"]) for x in rankwalk.rank_walk(df, "g", "a", SCORES).collect()}
    assert few == all_ and len(all_) == len(rows)
    for g in range(40):
        mine = [q for q in rows if q[0] == g]
        w = np.array([[-s * v for v, s in zip(q[2:5], SCORES.values())] for q in mine])
        want = dense(w) / dense(-w)
        assert np.allclose([all_[q[0], q[1]][0] for q in mine], want, atol=1e-6)
