"""Every query with SQL gives what DuckDB gives on the smallest tables, in the same types; the core stands without the other subpackage."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from penumbra import queries, soft_queries  # noqa: F401

SF = Path("/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"create view {f.stem} as from '{f}'")
    return c


def compare(spark, duck, fn, sql):
    df = fn(spark, str(SF))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(sql)
    assert cols == sorted(rel.columns)
    assert [KINDS[df.schema[c].dataType.simpleString()] for c in cols] == [str(rel.types[rel.columns.index(c)]) for c in cols]
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 3e-5 * max(1, abs(b))) for a, b in zip(g, w)), (g, w)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, duck, name):
    compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name])


def test_core_imports_without_the_subpackage():
    code = "import sys; sys.modules['penumbra.llm'] = None; import __spark_entry__ as e; assert e.llm is None and 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_reports_of_odd_rows_equal_the_sql(spark, tmp_path):
    first = pq.read_table(SF / "kfcm.parquet")
    one = next(r for r in first.to_pylist() if r["memberships"] and r["loaded_at"])

    def row(key, gap, loaded=one["loaded_at"], detail="{}", status="compared"):
        return one | {"report_id": key, "loaded_at": loaded, "detail": detail, "memberships": one["memberships"] | {"max_abs": gap, "status": status}}

    rows = [row(1, 9.5), row(1, 10.5), row(1, None), row(2, 2.0, None), row(2, 1.0), row(3, 20.5), row(3, 3.5), row(3, 1.0, None), row(None, 1.0), row(None, 0.5)]
    rows += [row(4 + i, i + 0.5, detail=d) for i, d in enumerate(('{"env":{"x":"\\ud800"}}', '{"\\ud800":1,"retries":[{"\\ud800":1}]}', f'{{"x":{"9" * 2000}}}', f'{{"{"k" * 60_000}":1,"":2}}', '{"abcdefghij":' * 20_000 + "1" + "}" * 20_000))]
    rows += [row(20 + i, 0.5, status=s) for i, s in enumerate(('{"x": 1}', "[1,  2]", "{ }", '"ok"', "[["))]
    pq.write_table(pa.Table.from_pylist(rows, first.schema), tmp_path / "kfcm.parquet")
    c = duckdb.connect()
    c.sql(f"create view kfcm as from '{tmp_path / 'kfcm.parquet'}'")
    rel = c.sql(queries.ORACLES["p5_report_structs"])
    got = queries.QUERIES["p5_report_structs"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rel.fetchall(), key=repr)
