"""Queries of the core: name -> callable(spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penumbra.operators import drift, nested

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add(fn) if fn else add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_COMPARED = "status string, shape array<int>, max_abs double, mean_abs double, max_rel double, mean_rel double"
_FLAGS = ("non_negative", "finite", "rows_sum_to_one", "labels_are_argmax", "partition_constrained_declared")
_REPORT = "lab_id int, case_name string, n int, d int, k int, seed int, n_clusters_ref int, n_clusters_opt int, label_agreement double, label_ari double, run_at timestamp, loaded_at timestamp"


def _below(name: str, ddl: str) -> str:
    """The columns of a nested object under dotted names."""
    return ", ".join(f"`{name}.{c.split(' ')[0]}` {c.split(' ')[1]}" for c in ddl.split(", "))


_INVARIANTS = _below("invariants", ", ".join(f"{f} boolean" for f in _FLAGS))
P5_TABLES = {
    "report": f"{_REPORT}, {_below('memberships', _COMPARED)}, {_below('centers', _COMPARED)}, {_INVARIANTS}, `detail.env.threads` bigint",
    "retries": f"seed bigint, {_below('memberships', _COMPARED)}, {_INVARIANTS}",
    "profile": "func string, ncalls bigint, tottime double",
    "worst": "row_no bigint, col_no bigint, gap double",
}


def kfcm_nodes(spark: SparkSession, sf: str, null_key: bool = False) -> DataFrame:
    """All tagged rows of the reports from one write by tag; of rows delivered twice the one that was loaded first, of those the one that stands first."""
    own = tuple(c.split(" ")[0] for c in _REPORT.split(", "))
    return nested.store(nested.flatten(table(spark, sf, "kfcm"), "report_id", ("memberships", "centers", "invariants"), ("detail",), order_by=("loaded_at", "_metadata.file_path", "_metadata.row_index"), report_columns=own, null_key=null_key))


def kfcm_tables(spark: SparkSession, sf: str, null_key: bool = False) -> dict[str, DataFrame]:
    """All flat tables of the reports."""
    return nested.tables(kfcm_nodes(spark, sf, null_key), "report_id", P5_TABLES)


@query
def p5_found(spark, sf):
    """The links of all child rows: what the three child tables have in common."""
    return kfcm_nodes(spark, sf).where(F.col("tag").isin([t for t in P5_TABLES if t != "report"])).select("report_id", "parent_path", "node_path")


@query
def p5_profile(spark, sf):
    """The flat table of all profile entries, with their links."""
    return kfcm_tables(spark, sf)["profile"]


@query
def p5_retries(spark, sf):
    """The flat table of all retries, with their memberships and invariants."""
    return kfcm_tables(spark, sf)["retries"]


@query
def p5_worst(spark, sf):
    """The flat table of all worst rows of memberships."""
    return kfcm_tables(spark, sf)["worst"]


@query
def p5_reports(spark, sf):
    """The reports themselves, one row each."""
    return kfcm_tables(spark, sf)["report"]


@query(
    sql="""with one as (select * from kfcm qualify row_number() over (partition by report_id order by loaded_at) = 1)
select report_id, lab_id, case_name, memberships.status as memberships_status, memberships.max_abs as memberships_max_abs, memberships.mean_rel as memberships_mean_rel,
centers.max_abs as centers_max_abs, centers.status as centers_status, invariants.rows_sum_to_one as invariants_rows_sum_to_one, invariants.finite as invariants_finite, label_ari from one"""
)
def p5_report_structs(spark, sf):
    """What the struct columns of the reports hold, of one without report_id too."""
    return kfcm_tables(spark, sf, null_key=True)["report"].select("report_id", "lab_id", "case_name", *(f"memberships_{c}" for c in ("status", "max_abs", "mean_rel")), "centers_max_abs", "centers_status", "invariants_rows_sum_to_one", "invariants_finite", "label_ari")


@query(
    sql="""with one as (select report_id, memberships.worst as w from kfcm qualify row_number() over (partition by report_id order by loaded_at) = 1),
e as (select report_id, i - 1 as position, w[i] as x from one, generate_series(1, len(w)) g(i))
select report_id, 'memberships.worst[' || position || ']' as node_path, cast(position as integer) as position, cast(x.row_no as bigint) as row_no, cast(x.col_no as bigint) as col_no, x.gap as gap from e where x is not null"""
)
def p5_column_worst(spark, sf):
    """The worst rows that the struct column holds, of the table of all worst rows."""
    return p5_worst(spark, sf).where("parent_path = '' and node_path like 'memberships.worst[%'").select("report_id", "node_path", "position", "row_no", "col_no", "gap")


LINES, STREAM = ["lab_id", "stream_name"], ["stream_name"]


@query
def p1_found(spark, sf):
    return drift.changes(drift.file_profiles(table(spark, sf, "raw_lines"), LINES, "file_no", "body", STREAM), LINES, "file_no", STREAM)


@query
def p1_unified(spark, sf):
    """All lines in one table: a typed column for each field, under one name and in one unit."""
    raw = table(spark, sf, "raw_lines").select("line_id", *LINES, "file_no", "body")
    prof = drift.file_profiles(raw, LINES, "file_no", "body", STREAM)
    return drift.unify(raw, drift.changes(prof, LINES, "file_no", STREAM), LINES, "file_no", "body", ["line_id"], pool=STREAM, profiles=prof)
