import json

from penumbra.operators import drift

KEY, FILE = ["lab", "stream"], "file_no"


def lines(spark, files, extra=()):
    rows = [(lab, "s", f, json.dumps(r), "clash") for lab, f, recs in files for r in recs] + list(extra)
    return spark.createDataFrame(rows, "lab int, stream string, file_no int, body string, field string")


def found(spark, files, extra=()):
    p = drift.file_profiles(lines(spark, files, extra), KEY, FILE, "body", ["stream"])
    return {tuple(r) for r in drift.changes(p, KEY, FILE, ["stream"]).collect()}


def recs(name, values, **more):
    return [{"case": f"c{i}", "n": i, name: v, **more} for i, v in enumerate(values)]


def test_renamed_by_name_unit_and_wrapping(spark):
    got = found(spark, [(1, 1, recs("limit_s", [60.0, 300.0, 600.0])), (1, 2, recs("LIMIT_MS", [60000.0, 600000.0, 300000.0])), (1, 5, recs("limitMs", [{"amount": 60000.0, "unit": "x"}] * 3))])
    assert got == {(1, "s", 2, "limit_s", "renamed", "LIMIT_MS"), (1, "s", 5, "LIMIT_MS", "renamed", "limitMs")}


def test_renamed_by_values_when_names_share_nothing(spark):
    words = ["graph", "features", "documents", "ensemble"]
    got = found(spark, [(1, 1, recs("modality", words)), (1, 2, recs("input", words[::-1]))])
    assert got == {(1, "s", 2, "modality", "renamed", "input")}


def test_unlike_fields_are_removed_and_added(spark):
    got = found(spark, [(1, 1, recs("chars", [17, 190, 90, 55])), (1, 2, recs("host", ["node-1", "node-7", "node-3", "node-4"]))])
    assert got == {(1, "s", 2, "chars", "removed", ""), (1, "s", 2, "host", "added", "")}


def test_retyped_against_the_last_known_type(spark):
    files = [(1, 1, recs("x", [1, 2])), (1, 2, recs("x", [None, None])), (1, 3, recs("x", ["1", "2"])), (1, 4, recs("x", [1.5])), (2, 4, recs("x", ["first file has no changes"]))]
    assert found(spark, files) == {(1, "s", 3, "x", "retyped", ""), (1, "s", 4, "x", "retyped", "")}


def test_a_name_that_comes_back_in_another_type_is_renamed_or_added_only(spark):
    files = [(1, 1, recs("limit_s", ["60s", "300s"])), (1, 2, recs("limit_seconds", ["60s", "300s"])), (1, 3, recs("limit_seconds", [60.0, 300.0])), (1, 4, recs("limit_s", [60.0, 300.0])), (1, 5, recs("limit_s", ["60s", "300s"]))]
    assert found(spark, files) == {(1, "s", 2, "limit_s", "renamed", "limit_seconds"), (1, "s", 3, "limit_seconds", "retyped", ""), (1, "s", 4, "limit_seconds", "renamed", "limit_s"), (1, "s", 5, "limit_s", "retyped", "")}


def test_a_long_value_is_compared_whole():
    head = "the same opening words of every report " * 6
    long = lambda tail: [f"{i:016x}" + drift._sketched(head + " ".join(f"{tail}{i}{j}" for j in range(60))) for i in range(4)]
    a, b, c = long("alpha"), long("alpha"), long("q7x")
    assert drift.value_likeness(a, b)[0] > 0.99 and drift.value_likeness(a, c)[0] < 0.9
    many = lambda n, k: [f"{i:016x}" + drift._sketched([v * k for v in range(n)]) for i in range(3)]
    assert drift.value_likeness(many(200, 1), many(200, 1))[0] == 1.0
    assert drift.value_likeness(many(200, 1), many(90, 1))[0] == 0.0


def test_more_names_than_any_bound_and_a_hot_group(spark):
    """Thousands of names, and one group with most of the files over several blocks, are compared as a few are."""
    files = [(1, f, [{"case": f"c{f}", f"field{f // 2}_{w}": f"{w}{f // 2}" + "x" * (f % 3)}]) for f in range(120) for w in ("a",)]
    got = found(spark, files)
    want = {(1, "s", f) for f in range(2, 120, 2)}
    assert {r[:3] for r in got} == want
    p = drift.file_profiles(lines(spark, [(2, 1, [{f"n{i}": i for i in range(6000)}]), (2, 2, [{f"n{i}": i for i in range(5999)}])]), KEY, FILE, "body", ["stream"])
    assert [tuple(r) for r in drift.changes(p, KEY, FILE, ["stream"]).collect()] == [(2, "s", 2, "n5999", "removed", "")]


def test_null_unreadable_repeated_lines_and_empty_table(spark):
    bad = [(1, "s", 2, "{oops", ""), (1, "s", 2, None, ""), (1, "s", 2, "[1]", ""), (None, "s", 2, "{}", ""), (1, "s", 2, "", None)]
    files = [(1, 1, recs("x", [1, 1])), (1, 2, recs("x", [2]) * 3)]
    assert found(spark, files, bad) == set()
    assert found(spark, []) == set()


def test_one_table_under_first_names(spark):
    files = [(1, 1, recs("timeout_s", [60.0, 300.0])), (1, 2, recs("timeoutSeconds", [60.0, 300.0]))]
    df = lines(spark, files, [(1, "s", 2, "{oops", "")])
    ch = drift.changes(drift.file_profiles(df, KEY, FILE, "body", ["stream"]), KEY, FILE, ["stream"])
    got = drift.unify(df, ch, KEY, FILE, "body", [], ["timeout_s"]).collect()
    assert sorted((r["file_no"], float(r["timeout_s"])) for r in got) == [(1, 60.0), (1, 300.0), (2, 60.0), (2, 300.0)]


def test_one_table_of_all_fields_in_one_unit(spark):
    files = [
        (1, 1, recs("timeout_s", [60.0, 300.0], flag=True, note="a")), (1, 2, recs("timeoutMs", [60000.0, "300000 ms"], flag=False, note="b")), (1, 3, recs("timeout_s", [60.0, {"amount": 300.0}])), (1, 4, recs("timeout_s", [60.0, "300s"])),
        (2, 1, recs("timeout_s", ["soon", 60.0], timeoutMs=[1, 2])),
    ]
    df = lines(spark, files, [(3, "t", 1, json.dumps({"timeoutMs": 5.0}), "other stream")])
    ch = drift.changes(drift.file_profiles(df, KEY, FILE, "body", ["stream"]), KEY, FILE, ["stream"])
    only = drift.unify(df.where("lab <> 2"), ch.where("lab <> 2"), KEY, FILE, "body", [], pool=["stream"])
    assert only.columns == ["lab", "stream", "file_no", "case", "flag", "n", "note", "timeoutMs", "timeout_s", "rest"]
    got = sorted(map(tuple, only.select("lab", "file_no", "case", "flag", "note", "timeoutMs", "timeout_s", "rest").collect()), key=str)
    want = [(1, f, f"c{i}", c, d, None, v, None) for f, c, d in ((1, True, "a"), (2, False, "b"), (3, None, None), (4, None, None)) for i, v in enumerate((60.0, 300.0))]
    assert got == [*want, (3, 1, None, None, None, 5.0, None, None)]
    # a file that has both names: they are no names of one field, and nothing is lost
    both = {(r["file_no"], r["case"]): r for r in drift.unify(df, ch, KEY, FILE, "body", [], pool=["stream"]).where("lab = 2").collect()}
    assert json.loads(both[1, "c0"]["rest"])["timeout_s"] == "soon" and both[1, "c1"]["timeout_s"] == 60.0
    assert all(r["timeoutMs"] is not None or "timeoutMs" in r["rest"] for r in both.values())


def test_a_field_renamed_into_another_unit_is_converted(spark):
    df = lines(spark, [(1, 1, recs("timeout_s", [60.0, 300.0])), (1, 2, recs("timeout_ms", [60000.0, 300000.0]))])
    ch = drift.changes(drift.file_profiles(df, KEY, FILE, "body", ["stream"]), KEY, FILE, ["stream"])
    got = drift.unify(df, ch, KEY, FILE, "body", [], ["timeout_s"]).collect()
    assert sorted((r["file_no"], float(r["timeout_s"])) for r in got) == [(1, 60.0), (1, 300.0), (2, 60.0), (2, 300.0)]
