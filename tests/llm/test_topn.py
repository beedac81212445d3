import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penumbra.llm import topn

SCHEMA = "g bigint, h string, s double, f string, i int, score string"


def brute(rows, n):
    groups: dict = {}
    for g, h, s, f, i, _ in set(rows):
        if s is not None and not math.isnan(s):
            groups.setdefault((g, h), set()).add((s, f, i))
    last = lambda v: (v is None, v if v is not None else 0)
    return {(*k, *r) for k, v in groups.items() for r in sorted(v, key=lambda r: (-r[0], last(r[1].encode() if r[1] is not None else None), last(r[2])))[:n]}


def rows_of(seed, n=400):
    r = random.Random(seed)
    pick = lambda *a: r.choice(a)
    return [(pick(1, 1, 1, 2, 3, None), pick("a", "b", "é", None), pick(0.5, 0.5, 1.0, -2.0, None, float("nan"), float("inf"), r.random()), pick("f", "F", "zz", "", "ü", None), r.randint(0, 5), pick("x", None)) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(5)
    got = topn.top_n(df, ["g", "h"], "s", ["f", "i"], 3).collect()
    assert {tuple(r) for r in got} == brute(rows, 3) and len(got) == len(brute(rows, 3))


def test_merge_between_levels(spark, monkeypatch):
    monkeypatch.setattr(topn, "FAN_IN", 2)
    rows = rows_of(3)
    got = topn.top_n(spark.createDataFrame(rows, SCHEMA).repartition(7), ["g", "h"], "s", ["f", "i"], 2, buckets=3).collect()
    assert {tuple(r) for r in got} == brute(rows, 2)


def test_hot_group_and_empty_table(spark):
    df = spark.range(50_000).selectExpr("0 as g", "double(id % 1000) as s", "id as i")
    assert [tuple(r) for r in topn.top_n(df, ["g"], "s", ["i"], 2).orderBy("i").collect()] == [(0, 999.0, 999), (0, 999.0, 1999)]
    assert topn.top_n(df.limit(0), ["g"], "s", ["i"], 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9))), max_size=6), st.integers(1, 4))
def test_loser_tree(runs, n):
    made = [topn.Run([(g,) for g, _ in sorted(r)], [(i,) for _, i in sorted(r)]) for r in runs]
    want: dict = {}
    for r in runs:
        for g, i in r:
            want.setdefault(g, set()).add(i)
    assert [(made[w].groups[at], made[w].items[at]) for w, at in topn.merge_runs(made, n)] == [((g,), (i,)) for g in sorted(want) for i in sorted(want[g])[:n]]


def test_many_buckets_and_runs_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(topn, "BUCKET_ROWS", 20)
    monkeypatch.setattr(topn, "RUN_ROWS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        rows = rows_of(5, 900)
        got = topn.top_n(spark.createDataFrame(rows, SCHEMA).repartition(3), ["g", "h"], "s", ["f", "i"], 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == brute(rows, 9) and len(got) == len(brute(rows, 9))
