"""Schemas that drift between files: what changed from file to file, and one table out of all of them.

Each field of a file gets a profile: its type, how many lines have it, and how wide those lines are. Each field of a pool of files (a
stream) gets a bottom-k sketch of its values, as one file may hold a field on a single line. Between a file and the one before it, fields that go are matched with fields that come by a bipartite
matching of largest weight over name, values and line width; matched pairs are renames, the rest removals and additions.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penumbra.functions.assign import max_weight_matching
from penumbra.plans.ordered import previous, range_blocks
from penumbra.session import materialize

SKETCH = 48  # values kept for each field of a pool
ACCEPT = 0.5  # least weight of a rename
WHOLE = 160  # characters of a value's JSON text up to which a sketch holds it as it is; of a longer one it holds a summary of the whole
GRAMS, QUANTILES = 64, 32  # of a long value: trigrams of its text, numbers by rank
MERGE = 256  # tasks whose sketches of one field are merged at once
MEMO = 100_000  # pairs of names whose likeness a task remembers
LONG = "\x00"  # the key that marks a summary
UNITS = frozenset("s sec secs second seconds ms us ns millis min minutes h b kb mb gb bytes kib mib gib pct percent".split())
SCALES = (1.0, 1e3, 1e-3, 1e6, 1e-6, 1e9, 1e-9, 60.0, 1 / 60, 3600.0, 1 / 3600, 1024.0, 1 / 1024, 1024.0**2, 1 / 1024**2, 100.0, 0.01)
TYPES = ("string", "number", "boolean", "array", "object")


def json_type(v) -> str | None:
    """string, number, boolean, array or object; None for null."""
    if v is None:
        return None
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _sketched(v) -> str:
    """A value as a sketch holds it. A long one is summed up over its whole length: its texts' trigrams of least hash, its numbers by rank."""
    text = json.dumps(v)
    if len(text) <= WHOLE:
        return text
    out: list = []
    _leaves(v, out)
    if t := " ".join(x for x in out if isinstance(x, str)):
        grams = sorted(_grams(t).items(), key=lambda g: xxhash.xxh64_intdigest(g[0]))[:GRAMS]
        return json.dumps({LONG: "text", "id": xxhash.xxh64_hexdigest(t), "grams": dict(grams), "raw": isinstance(v, str)})
    if any(isinstance(x, bool) for x in out):
        return json.dumps({LONG: "flags"})
    x = np.sort(np.array(out, float))
    at = np.unique(np.linspace(0, len(x) - 1, QUANTILES).astype(int)) if len(x) else []
    return json.dumps({LONG: "numbers", "n": len(x), "at": [float(y) for y in x[at]] if len(x) else []})


def _profiles(group: list[str], file_no: str, body: str, pool: list[str]):
    names = [*group, file_no, "field", "lines", "width", "types", "sketch"]
    at = [group.index(c) for c in pool]
    unset = [None if c not in pool else c for c in group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files: dict[tuple, list] = {}
        pools: dict[tuple, list] = {}  # (pool, field) -> [values by hash, bound of the hashes that may come in]

        def flush(sketches: bool) -> pd.DataFrame:
            rows = [(*k, *a, None) for k, a in files.items()]
            files.clear()
            if sketches:
                for (p, field), (kept, _) in pools.items():
                    own = dict(zip(pool, p))
                    rows.append((*[own.get(c) for c in unset], None, field, None, None, None, [f"{h:016x}{t}" for h, t in sorted(kept.items())[:SKETCH]]))
                pools.clear()
            return pd.DataFrame(rows, columns=names, dtype=object)

        for b in batches:
            for row in b.itertuples(index=False, name=None):
                text = row[-1]
                try:
                    rec = json.loads(text) if isinstance(text, str) else None
                except (ValueError, RecursionError):
                    rec = None
                if not isinstance(rec, dict):
                    continue
                # a line counts, not a distinct value, so that frequent values are frequent in the sketch; a repeated line has the same hash
                h, p = xxhash.xxh64_intdigest(text), tuple(row[i] for i in at)
                for field, v in rec.items():
                    a = files.setdefault((*row[:-1], field), [0, 0, [0] * len(TYPES)])
                    a[0] += 1
                    a[1] += len(rec)
                    if (t := json_type(v)) is not None:
                        a[2][TYPES.index(t)] += 1
                        s = pools.setdefault((p, field), [{}, 1 << 64])
                        if h < s[1]:
                            s[0][h] = _sketched(v)
                            if len(s[0]) > 4 * SKETCH:
                                s[0] = dict(sorted(s[0].items())[:SKETCH])
                                s[1] = max(s[0])
            if len(files) > 20000 or len(pools) > 20000:
                yield flush(len(pools) > 20000)
        if files or pools:
            yield flush(True)

    return run, names


def file_profiles(lines: DataFrame, group: list[str], file_no: str, body: str, pool: list[str] | None = None) -> DataFrame:
    """One row per field of each file: field, lines (that have it), width (fields on those lines), type (of most values, null if all are null); and, with a null
    file number, one row per field of each pool (some of the group columns, default all) with a sketch of its values.

    Lines that are unreadable or no objects are left out, as are lines without a group or file number. A line that is repeated is once in
    the sketch; lines and width, of which only the ratio is used, count it each time. A file of any size is summarised in the map stage;
    what is shuffled are three numbers for each task and field of a file, and a bounded sketch for each task and field of a pool, which are merged
    in two steps. The profiles are written out, as all that follows reads them more than once.
    """
    pool = pool or group
    src = lines.select(*group, file_no, body).dropna(subset=[*group, file_no, body])
    run, names = _profiles(group, file_no, body, pool)
    types = {f.name: f.dataType for f in src.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*group, file_no]] + T._parse_datatype_string("field string, lines bigint, width bigint, types array<bigint>, sketch array<string>").fields)
    keys = [*group, file_no, "field"]

    def merge(df: DataFrame, *part: str) -> DataFrame:
        sketch = F.slice(F.array_sort(F.flatten(F.collect_list("sketch"))), 1, SKETCH)
        return df.groupBy(*keys, *part).agg(F.sum("lines").alias("lines"), F.sum("width").alias("width"), F.array(*[F.sum(F.col("types")[i]) for i in range(len(TYPES))]).alias("types"), sketch.alias("sketch"))

    parts = src.mapInPandas(run, schema).withColumn("_part", F.when(F.col("lines").isNull(), (F.spark_partition_id() / MERGE).cast("int")))
    one = merge(merge(parts, "_part"))
    # the type that most values have, the first of TYPES if several do
    kind = F.array(*[F.lit(t) for t in TYPES])[F.array_position("types", F.array_max("types")).cast("int") - 1]
    return materialize(one.select(*keys, "lines", "width", F.when(F.array_max("types") > 0, kind).alias("type"), "sketch"), "profiles")


def _leaves(v, out: list) -> None:
    if isinstance(v, dict):
        for k, x in sorted(v.items()):
            if k.lower() not in ("unit", "units"):
                _leaves(x, out)
    elif isinstance(v, list):
        for x in v:
            _leaves(x, out)
    elif isinstance(v, str):
        m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)\s*([A-Za-z%]{0,7})\s*", v)
        if m and (m[2].lower() in UNITS or m[2] in ("", "%")):
            out.append(float(m[1]))
        elif re.fullmatch(r"\s*-?\d+(\.\d+)?(\s*[x,;×*]\s*-?\d+(\.\d+)?)+\s*", v):
            out += [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", v)]
        else:
            out.append(v)
    elif v is not None:
        out.append(v)


def _values(sketch: list[str]) -> tuple[list[tuple[int, tuple[float, ...]]], list[tuple[str, Counter]], bool]:
    """The numbers, texts and whether there are flags of a sketch: numbers as (how many a value has, the numbers), texts as (identity, trigrams)."""
    nums, texts, flags, raw = [], [], False, False
    for s in sketch:
        v = json.loads(s[16:])
        if isinstance(v, dict) and LONG in v:
            if v[LONG] == "text":
                texts.append((v["id"], Counter(v["grams"])))
                raw |= v["raw"]
            elif v[LONG] == "numbers":
                nums.append((v["n"], tuple(v["at"])))
            else:
                flags = True
            continue
        raw |= isinstance(v, str)
        out: list = []
        _leaves(v, out)
        if t := [x for x in out if isinstance(x, str)]:
            texts.append((" ".join(t), _grams(" ".join(t))))
        elif any(isinstance(x, bool) for x in out):
            flags = True
        elif out:
            nums.append((len(out), tuple(float(x) for x in out)))
    if len(texts) > len(nums) and raw:  # texts of which some happen to look like numbers
        nums = []
    return nums, texts, flags


def _numbers(nums: list[tuple[int, tuple[float, ...]]]) -> np.ndarray:
    return np.array([v for _, t in nums for v in t if math.isfinite(v)], float)


def _words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)}


def _grams(s: str) -> Counter:
    s = f" {s.lower()} "
    return Counter(s[i : i + 3] for i in range(len(s) - 2))


def _cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[g] for g, n in a.items())
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def name_likeness(a: str, b: str) -> float:
    """1 for names that differ in case, separators or unit only; else the larger of shared words and shared trigrams."""
    wa, wb = _words(a), _words(b)
    ca, cb = wa - UNITS or wa, wb - UNITS or wb
    if ca == cb:
        return 1.0
    words = len(ca & cb) / min(len(ca), len(cb)) * 0.9 if ca & cb else 0.0
    return max(words, _cosine(_grams("".join(sorted(ca))), _grams("".join(sorted(cb)))) * 0.8)


def _alike(x: np.ndarray, y: np.ndarray, scale: float) -> float:
    """Likeness of two samples of numbers, the second multiplied by scale."""
    whole = lambda v: bool((v == np.round(v)).all())
    z = np.round(y * scale, 9)
    dx, dz = set(np.round(x, 9)), set(z)
    if len(dx) <= 6 and len(dz) <= 6:  # few distinct values: which they are counts
        return len(dx & dz) / min(len(dx), len(dz))
    grid = np.concatenate([x, z])
    ks = np.abs(np.searchsorted(np.sort(x), grid, "right") / len(x) - np.searchsorted(np.sort(z), grid, "right") / len(z)).max()
    spread = 1.36 * math.sqrt(1 / len(x) + 1 / len(z))  # what chance gives
    return max(0.0, 1 - max(0.0, ks - spread / 2)) * (1.0 if whole(x) == whole(z) or scale != 1.0 else 0.5)


def _numeric(a: list[tuple], b: list[tuple]) -> tuple[float, float]:
    """Likeness of two samples of numbers in one unit, and in the unit that suits best."""
    if Counter(n for n, _ in a).most_common(1)[0][0] != Counter(n for n, _ in b).most_common(1)[0][0]:
        return 0.0, 0.0
    x, y = _numbers(a), _numbers(b)
    if not len(x) or not len(y):
        return 0.0, 0.0
    same = _alike(x, y, 1.0)
    return same, max([same, *(_alike(x, y, s) for s in SCALES[1:])])


def value_likeness(a: list[str], b: list[str]) -> tuple[float, bool]:
    """How alike the values of two sketches are, from 0 to 1, in whatever unit and wrapping; whether few values tell it surely."""
    (na, ta, ba), (nb, tb, bb) = _values(a), _values(b)
    if not (na or ta or ba) or not (nb or tb or bb):
        return 0.5, False  # nothing known
    best, sure = 0.0, False
    if ta and tb:
        ia, ib = {i for i, _ in ta}, {i for i, _ in tb}
        best = max(len(ia & ib) / min(len(ia), len(ib)), _cosine(sum((g for _, g in ta), Counter()), sum((g for _, g in tb), Counter())))
    if ba and bb:
        best = max(best, 0.5)
    if na and nb:
        same, scaled = _numeric(na, nb)
        few = [len(set(v)) <= 6 and np.abs(v).max(initial=0) >= 20 for v in (_numbers(na), _numbers(nb))]
        sure = all(few) and scaled >= 0.75
        best = max(best, scaled if sure else same, 0.6 * scaled)
    return best, sure


def likeness(old: dict, new: dict, memo: dict | None = None) -> float:
    """Weight from 0 to 1 that a field that goes and one that comes hold the same quantity.

    Names alike in all but case, separators and unit are enough by themselves. Else the values must be alike and stand on lines
    of the same width; how alike they must be depends on whether the names share something.
    """
    name = name_likeness(old["field"], new["field"])
    context = max(0.0, 1 - 2.5 * abs(math.log(old["width"] / old["lines"] / (new["width"] / new["lines"]))))
    key = (old.get("pool"), old["field"], new["field"])
    if memo is None or key not in memo:
        value, _ = value_likeness(old["sketch"], new["sketch"])
        if memo is not None:
            memo[key] = value
    else:
        value = memo[key]
    if name >= 0.99:
        return 0.75 + 0.25 * max(value, context)
    if context < 0.3:
        return 0.0
    need = 0.45 if name >= 0.3 else 0.7
    return 0.35 * name + 0.4 * value + 0.25 * context + (0.15 if value >= need else -0.4)


def match_fields(gone: list[dict], come: list[dict], memo: dict | None = None) -> list[tuple[int, int]]:
    """Pairs (index gone, index come) of the matching of largest total weight over pairs that are likely enough."""
    if not gone or not come:
        return []
    w = np.array([[likeness(a, b, memo) for b in come] for a in gone])
    return [(i, j) for i, j in max_weight_matching(np.where(w >= ACCEPT, w, 0.0)) if w[i, j] >= ACCEPT]


def pooled_sketches(profiles: DataFrame, pool: list[str], file_no: str) -> DataFrame:
    """One row per pool and field: pooled, the sketch of its values, a sample of all its lines."""
    return profiles.where(F.col(file_no).isNull()).select(*pool, "field", F.col("sketch").alias("pooled"))


def changes(profiles: DataFrame, group: list[str], file_no: str, pool: list[str]) -> DataFrame:
    """Rows (group, file_no, field_name, change_kind, new_name): what each file changed against the one before it.

    The first file of a group has none. added, removed, renamed (new_name is the new name), retyped: a field of both files whose type differs from
    the last known one of its name. new_name is '' unless renamed. An empty table gives an empty one.

    `profiles` comes from `file_profiles` with the same pool. Values are compared by the sketches of the pool, which are joined to the fields of
    those files that both lose and gain some; there is no bound on the number of names. Files and fields are lined up over range blocks, so
    that a group may have any number of files.
    """
    prof = profiles.where(F.col(file_no).isNotNull())
    # one row per file from here on, the fields of a file in one array (as many as a file has fields)
    files = prof.groupBy(*group, file_no).agg(F.collect_list(F.struct("field", "lines", "width")).alias("now"))
    pairs = previous(range_blocks(files, group, [F.col(file_no)]), group, [F.col(file_no)], "now", "before").where("before is not null")
    without = lambda a, b: F.filter(a, lambda x: ~F.array_contains(F.col(f"{b}.field"), x["field"]))
    pairs = materialize(pairs.select(*group, file_no, without("before", "now").alias("gone"), without("now", "before").alias("come")).where("size(gone) > 0 or size(come) > 0"), "changed")
    names = [*group, file_no, "field_name", "change_kind", "new_name"]
    row = lambda kind: [*group, file_no, F.col("x.field").alias("field_name"), F.lit(kind).alias("change_kind"), F.lit("").alias("new_name")]
    removed = pairs.where("size(come) = 0").select(*group, file_no, F.explode("gone").alias("x")).select(*row("removed"))
    added = pairs.where("size(gone) = 0").select(*group, file_no, F.explode("come").alias("x")).select(*row("added"))
    both = pairs.where("size(gone) > 0 and size(come) > 0")
    sides = [both.select(*group, file_no, F.lit(i).alias("side"), F.explode(c).alias("x")) for i, c in enumerate(("gone", "come"))]
    fields = sides[0].unionByName(sides[1]).select(*group, file_no, "side", "x.*").join(pooled_sketches(profiles, pool, file_no), [*pool, "field"], "left")
    fields = fields.groupBy(*group, file_no).agg(F.collect_list(F.struct("side", "field", "lines", "width", "pooled")).alias("x")).select(*group, file_no, "x")
    at = [group.index(c) for c in pool]

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}  # a pair of names is compared once
        for b in batches:
            rows = []
            for r in b.itertuples(index=False, name=None):
                key, every = r[:-1], sorted(({**x, "sketch": [] if x["pooled"] is None else x["pooled"], "pool": tuple(r[i] for i in at)} for x in r[-1]), key=lambda x: x["field"])
                gone, come = ([x for x in every if x["side"] == i] for i in (0, 1))
                if len(memo) > MEMO:
                    memo.clear()
                ren = match_fields(gone, come, memo)
                rows += [(*key, gone[i]["field"], "renamed", come[j]["field"]) for i, j in ren]
                rows += [(*key, x["field"], "removed", "") for i, x in enumerate(gone) if i not in {p[0] for p in ren}]
                rows += [(*key, x["field"], "added", "") for j, x in enumerate(come) if j not in {p[1] for p in ren}]
            yield pd.DataFrame(rows, columns=names)

    types = {f.name: f.dataType for f in profiles.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in [*group, file_no]] + T._parse_datatype_string("field_name string, change_kind string, new_name string").fields)
    matched = fields.mapInPandas(diff, schema)
    typed = range_blocks(prof.where("type is not null").select(*group, "field", file_no, "type"), [*group, "field"], [F.col(file_no)])
    retyped = previous(typed, [*group, "field"], [F.col(file_no)], "type", "_last").where("_last is not null and type <> _last")
    # a name that comes in with this file is no field of the file before: it is added or renamed, whatever it held long ago
    retyped = retyped.join(pairs.select(*group, file_no, F.explode("come.field").alias("field")), [*group, file_no, "field"], "left_anti")
    retyped = retyped.select(*group, file_no, F.col("field").alias("field_name"), F.lit("retyped").alias("change_kind"), F.lit("").alias("new_name"))
    return removed.unionByName(added).unionByName(matched).unionByName(retyped)


MAX_FIELDS = 5000
MAX_RENAMES = 20000
# fixed values: what a unit is of, and how many of the base unit it holds
_UNIT = {
    **{u: ("time", f) for f, us in ((1.0, "s sec secs second seconds"), (1e-3, "ms millis"), (1e-6, "us"), (1e-9, "ns"), (60.0, "min minutes"), (3600.0, "h")) for u in us.split()},
    **{u: ("size", f) for f, us in ((1.0, "b bytes"), (1e3, "kb"), (1e6, "mb"), (1e9, "gb"), (1024.0, "kib"), (1024.0**2, "mib"), (1024.0**3, "gib")) for u in us.split()},
    **{u: ("share", 0.01) for u in ("pct", "percent", "%")},
}


def _unit(words: list[str]) -> tuple[str, float] | None:
    """The last unit among the words, as (what it is of, factor)."""
    return next((_UNIT[w] for w in reversed(words) if w in _UNIT), None)


def _ordered_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def unit_scale(name: str, sketch: list[str], first: str, first_sketch: list[str]) -> float:
    """By what values of `name` are multiplied to stand in the unit of `first`: from the units in both names, else from the values."""
    a, b = _unit(_ordered_words(name)), _unit(_ordered_words(first))
    if name == first or (a and b):
        return a[1] / b[1] if a and b and a[0] == b[0] else 1.0
    x, y = (_numbers(_values(s)[0]) for s in (first_sketch, sketch))
    if not len(x) or not len(y):
        return 1.0
    kind = (a or b or ("", 0))[0]
    units = sorted({f for k, f in _UNIT.values() if k == kind})
    # of one unit that is known, the other is one of the same kind
    scales = [1.0, *([a[1] / f for f in units] if a else [f / b[1] for f in units] if b else SCALES[1:])]
    likes = [_alike(x, y, c) for c in scales]
    return scales[int(np.argmax(likes))] if max(likes) > likes[0] + 0.2 else 1.0


def _chains(pairs: list[tuple], apart: set[tuple], rank) -> dict[tuple, tuple]:
    """(pool, name) -> (pool, first name of its chain); names that are apart are never linked."""
    of = {(p, x): {(p, x)} for p, *names in pairs for x in names}
    for p, x, y in pairs:
        s, t = of[p, x], of[p, y]
        if s is not t and not any((p, *sorted((m[1], n[1]))) in apart for m in s for n in t):
            s |= t
            of.update(dict.fromkeys(t, s))
    return {k: min(s, key=lambda m: rank(m[1])) for k, s in of.items()}


def _placed(v, kind: str, scale: float, unit: tuple[str, float] | None):
    """The value in a column of a kind; None if it does not fit."""
    if kind == "json":
        return json.dumps(v, ensure_ascii=False)
    if kind == "string" and isinstance(v, str):
        return v
    if kind == "double" and isinstance(v, str) and (m := re.fullmatch(r"\s*(\S+?)\s*([A-Za-z%]+)\s*", v)) and (u := _UNIT.get(m[2].lower())) and unit and u[0] == unit[0]:
        scale = u[1] / unit[1]  # the value's own unit
    out: list = []
    _leaves(v, out)
    x = out[0] if len(out) == 1 else None
    if kind == "double":
        if isinstance(x, bool) or not isinstance(x, (int, float)) or (isinstance(x, int) and abs(x) > 2**53):
            return None
        return x * scale if scale >= 1 else x / round(1 / scale, 9)
    if kind == "boolean":
        return x if isinstance(x, bool) else None
    while isinstance(v, (list, dict)) and len(v) == 1:  # a wrapped text
        v = v[0] if isinstance(v, list) else next(iter(v.values()))
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def unify(lines: DataFrame, found: DataFrame, group: list[str], file_no: str, body: str, keep: list[str], fields: list[str] | None = None, pool: list[str] | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """One row per readable line: keep, group, file_no, a typed column for each field, and rest.

    Fields are all that the profiles have, or `fields`. A name belongs to a field if a chain of renames of its pool (some of the group
    columns, else all) links them and no file has both; a field is called by the name that most files have. Numbers are converted to the unit of that
    name and are doubles, arrays and objects are JSON texts. rest holds, as a JSON object or null, what has no place: values that do not fit
    their column and second values of one field on a line; with `fields`, all other fields.

    What reaches the driver is bounded by the vocabulary of field names, and checked against MAX_RENAMES and MAX_FIELDS.
    """
    pool, wanted = pool or group, fields or []
    every = profiles if profiles is not None else file_profiles(lines, group, file_no, body, pool)
    prof = every.where(F.col(file_no).isNotNull())
    ren = found.where("change_kind = 'renamed'").select(F.struct(*pool).alias("p"), "field_name", "new_name").groupBy("p", "field_name", "new_name").count().limit(MAX_RENAMES + 1).collect()
    if len(ren) > MAX_RENAMES:
        raise ValueError(f"more than {MAX_RENAMES} distinct renames: these are no field names")
    pairs = [(tuple(r[0]), r[1], r[2]) for r in sorted(ren, key=lambda r: (-r["count"], tuple(map(str, r[0])), r[1], r[2]))]
    seen = prof.groupBy(F.struct(*pool).alias("p"), "field", "type").count().limit(len(TYPES) * MAX_FIELDS + 1).collect()
    names = {(tuple(r["p"]), r["field"]) for r in seen}
    if len(names) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} field names")
    files, types = Counter(), {}
    for r in seen:
        files[r["field"]] += r["count"]
        if r["type"]:
            types.setdefault(r["field"], Counter())[r["type"]] += r["count"]
    rank = lambda x: (x not in wanted, -files[x], x)
    # names of one chain that some file has both
    first = _chains(pairs, set(), rank)
    apart: set[tuple] = set()
    if first:
        spark = lines.sparkSession
        ids = {m: i for i, m in enumerate(sorted(set(first.values()), key=str))}
        schema = T.StructType([*[T.StructField(f"_p{i}", prof.schema[c].dataType) for i, c in enumerate(pool)], T.StructField("_f", T.StringType()), T.StructField("_c", T.IntegerType())])
        chain = spark.createDataFrame([(*p, x, ids[m]) for (p, x), m in first.items()], schema)
        on = [prof[c] == chain[f"_p{i}"] for i, c in enumerate(pool)] + [prof["field"] == chain["_f"]]
        both = prof.join(F.broadcast(chain), on).groupBy(*group, file_no, "_c").agg(F.sort_array(F.collect_set("field")).alias("b")).where("size(b) > 1").select(F.struct(*pool).alias("p"), "b").distinct()
        for r in both.collect():
            apart |= {(tuple(r["p"]), x, y) for i, x in enumerate(r["b"]) for y in r["b"][i + 1 :]}
        first = _chains(pairs, apart, rank)
    sketches = {(tuple(r[c] for c in pool), r["field"]): r["pooled"] for r in pooled_sketches(every, pool, file_no).collect()}
    place = {}  # (pool, name) -> field, its kind, scale, unit
    for p, x in sorted(names, key=str):
        f = first.get((p, x), (p, x))[1]
        if fields is not None and f not in fields:
            continue
        kind = {"number": "double", "boolean": "boolean", "array": "json", "object": "json"}.get(max(sorted(types[f]), key=lambda t: types[f][t]) if f in types else "", "string")
        scale = unit_scale(x, sketches.get((p, x), []), f, sketches.get((p, f), [])) if kind == "double" else 1.0
        place[p, x] = (f, kind, scale, _unit(_ordered_words(f)))
    kinds = {**dict.fromkeys(wanted, "string"), **{f: kind for f, kind, *_ in place.values()}}
    order = fields if fields is not None else sorted(kinds)
    used, column = {c.lower() for c in (*keep, *group, file_no, "rest")}, {}
    for f in order:  # names that differ in case only are columns of their own
        column[f] = next(c for c in (f, *(f"{f}_{i}" for i in range(2, len(order) + len(used) + 3))) if c.lower() not in used)
        used.add(column[f].lower())
    own = list(dict.fromkeys([*keep, *group, file_no]))
    at = [own.index(c) for c in pool]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False, name=None):
                try:
                    rec = json.loads(row[-1]) if isinstance(row[-1], str) else None
                except (ValueError, RecursionError):
                    rec = None
                if not isinstance(rec, dict):
                    continue
                p, out, rest = tuple(row[i] for i in at), {}, {}
                for x, v in rec.items():
                    if v is None:
                        continue
                    to = place.get((p, x))
                    y = _placed(v, *to[1:]) if to else None
                    if y is None or to[0] in out:
                        rest[x] = v
                    else:
                        out[to[0]] = y
                rows.append((*row[:-1], *[out.get(f) for f in order], json.dumps(rest, ensure_ascii=False) if rest else None))
            yield pd.DataFrame(rows, columns=[*own, *column.values(), "rest"], dtype=object)

    sql = {"double": T.DoubleType(), "boolean": T.BooleanType()}
    schema = T.StructType([*[T.StructField(c, lines.schema[c].dataType) for c in own], *[T.StructField(column[f], sql.get(kinds[f], T.StringType())) for f in order], T.StructField("rest", T.StringType())])
    return lines.select(*own, body).mapInPandas(run, schema)
