"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.llm import bpe, leak, percentiles, rankwalk, topn, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add(fn) if fn else add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query(
    sql="""
with once as (select distinct sweep_id, case_name, profile_id, profile from profile_top where profile is not null),
e as (select sweep_id, case_name, profile_id, i - 1 as item_no, profile[i] as p from once, generate_series(1, len(profile)) g(i)),
r as (select sweep_id, case_name, profile_id, item_no, row_number() over (partition by sweep_id, case_name
      order by p.tottime desc, encode(p.func), profile_id, item_no) as r
      from e where p is not null and p.tottime is not null and not isnan(p.tottime))
select sweep_id, case_name, profile_id, cast(item_no as integer) as item_no from r where r <= 5"""
)
def p2_found(spark, sf):
    t = table(spark, sf, "profile_top").select("sweep_id", "case_name", "profile_id", F.posexplode("profile").alias("item_no", "p"))
    e = t.where(F.col("p").isNotNull()).select("sweep_id", "case_name", "profile_id", "item_no", F.col("p.tottime").alias("tottime"), F.col("p.func").alias("func"))
    return topn.top_n(e, ["sweep_id", "case_name"], "tottime", ["func", "profile_id", "item_no"], 5).select("sweep_id", "case_name", "profile_id", "item_no")


SCORES = {"mean_ari": 1, "mean_silhouette": 1, "mean_fit_time_ms": -1, "mean_peak_traced_mb": -1}


@query
def p3_ranking(spark, sf):
    return rankwalk.rank_walk(table(spark, sf, "main_benchmark_summary"), "suite_id", "algorithm", SCORES)


@query
def p3_found(spark, sf):
    return rankwalk.best(p3_ranking(spark, sf)).select("suite_id", "algorithm")


MEASURES = ("fit_time_ms", "peak_traced_mb")


def _measures(spark, sf) -> DataFrame:
    """One row per result and measure that counts, each result once."""
    ok = table(spark, sf, "results").where("status = 'ok'")
    once = ok.select("result_id", "sweep_id", F.lower(F.trim(F.col("algorithm"), F.lit(" \t"))).alias("algorithm"), *MEASURES, F.to_date("run_at").alias("day")).dropDuplicates(["result_id"])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x")
    long = once.select("sweep_id", "algorithm", "day", pairs).select("sweep_id", "algorithm", "day", "x.measure", "x.v")
    return long.where("v is not null and not isnan(v) and v >= 0 and v < double('infinity')")


GROUP = ["sweep_id", "algorithm", "measure"]
_COUNTED = """
with once as (select distinct on (result_id) result_id, sweep_id, lower(trim(algorithm, ' ' || chr(9))) as algorithm, fit_time_ms, peak_traced_mb
              from results where status = 'ok'),
v as (select sweep_id, algorithm, 'fit_time_ms' as measure, fit_time_ms as v from once
      union all select sweep_id, algorithm, 'peak_traced_mb', peak_traced_mb from once),
c as (select * from v where v is not null and not isnan(v) and not isinf(v) and v >= 0),
r as (select *, row_number() over (partition by sweep_id, algorithm, measure order by v) as r,
      count(*) over (partition by sweep_id, algorithm, measure) as n from c)
"""


@query(
    sql=_COUNTED
    + """select sweep_id, algorithm, measure, n as total, min(v) filter (r >= greatest(ceil(0.25 * n), 1)) as p25, min(v) filter (r >= greatest(ceil(0.5 * n), 1)) as p50,
min(v) filter (r >= greatest(ceil(0.75 * n), 1)) as p75, min(v) filter (r >= greatest(ceil(0.95 * n), 1)) as p95,
min(v) filter (r >= greatest(ceil(0.99 * n), 1)) as p99 from r group by sweep_id, algorithm, measure, n"""
)
def p4_percentiles(spark, sf):
    return percentiles.percentiles(percentiles.summarise(_measures(spark, sf), GROUP, "v"), GROUP, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99})


@query(
    sql=_COUNTED
    + """, p as (select sweep_id, algorithm, measure, n, min(v) filter (r >= ceil(0.5 * n)) as p50, min(v) filter (r >= ceil(0.95 * n)) as p95
from r group by sweep_id, algorithm, measure, n)
select sweep_id, algorithm, measure from p where n >= 20 and p95 >= 10 * p50"""
)
def p4_found(spark, sf):
    p = percentiles.percentiles(percentiles.summarise(_measures(spark, sf), GROUP, "v"), GROUP, {"p50": 0.5, "p95": 0.95})
    return p.where("total >= 20 and p95 >= 10 * p50").select(*GROUP)


@query
def p4_days_together(spark, sf):
    """The days summarised apart with a value error of one percent, then put together."""
    days = percentiles.summarise(_measures(spark, sf), [*GROUP, "day"], "v", relative_error=0.01)
    return percentiles.percentiles(percentiles.combine(days, GROUP), GROUP, {"p50": 0.5, "p95": 0.95})


@query
def p6_ids(spark, sf):
    return bpe.encode(table(spark, sf, "documents"), "doc_id", "text")


@query
def p7_found(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "eval_items")
    return leak.find_leaks(docs, "doc_id", "text", items, "item_id", "text")


@query
def p7_items(spark, sf):
    """How many documents hold each item that leaked."""
    return p7_found(spark, sf).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


@query
def p8_found(spark, sf):
    return truncation.find_cut(table(spark, sf, "documents"), "doc_id", "text")


@query
def p8_sources(spark, sf):
    return truncation.cut_by_source(table(spark, sf, "documents"), "doc_id", "text", "source")
