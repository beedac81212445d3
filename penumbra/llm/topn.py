"""Top N items within every group, by sorted runs and a loser-tree merge.

Each task turns its batches into runs sorted by group and score, with what can still be among the first N of its group, and the runs
are stored. They are then brought together by bucket (a hash of the group) and merged by a loser tree that, once it has N outputs of a
group, seeks each run that comes up with that group to its next one. There are as many buckets as keep one within BUCKET_ROWS, and what is
shuffled are at most N rows for each run and group, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penumbra.session import materialize

FAN_IN = 1000  # runs that one merge takes; with more there is a merge level between
RUN_ROWS = 500_000  # rows of a run that a task holds
BUCKET_ROWS = 200_000  # rows of a bucket, about: a group of many runs may have N for each of FAN_IN


class LoserTree:
    """Selects the least of k keys again and again; None stands for an exhausted run and is larger than all keys."""

    def __init__(self, keys: list):
        self.keys, self.k = list(keys), len(keys)
        self.losers = [-1] * self.k
        self.winner = -1
        for leaf in range(self.k):
            self._play(leaf, filling=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None and (x is not None or a < b) if x is None or y is None else (x < y or (x == y and a < b))

    def _play(self, leaf: int, filling: bool = False) -> None:
        node, best = (leaf + self.k) >> 1, leaf
        while node:
            other = self.losers[node]
            if other < 0:
                if filling:
                    self.losers[node] = best
                    return
            elif self._less(other, best):
                self.losers[node], best = best, other
            node >>= 1
        self.winner = best

    def update(self, leaf: int, key) -> None:
        """Gives the winner's run its next key."""
        self.keys[leaf] = key
        self._play(leaf)


class Run:
    """A sorted run: keys (group key, item key), and where each group ends."""

    def __init__(self, groups: list, items: list):
        self.groups, self.items, self.at = groups, items, 0
        self.next_group = [len(groups)] * len(groups)
        for i in range(len(groups) - 2, -1, -1):
            self.next_group[i] = self.next_group[i + 1] if groups[i] == groups[i + 1] else i + 1

    def key(self):
        return (self.groups[self.at], self.items[self.at]) if self.at < len(self.groups) else None

    def seek(self) -> None:
        """On to the next group."""
        self.at = self.next_group[self.at]


def merge_runs(runs: list[Run], n: int) -> Iterator[tuple[int, int]]:
    """(number of a run, position in it) of the first n distinct items of each group, in order; equal items of a group count once."""
    if not runs:
        return
    tree, group, out, last = LoserTree([r.key() for r in runs]), None, 0, None
    while (key := tree.keys[tree.winner]) is not None:
        w = tree.winner
        run, (g, item) = runs[w], key
        if g != group:
            group, out, last = g, 0, None
        if out == n:  # the group has all its outputs
            run.seek()
        else:
            if item != last:
                yield w, run.at
                out, last = out + 1, item
            run.at += 1
        tree.update(w, run.key())


def _cut(t: pa.Table, group: list[str], sort: list[tuple[str, str]], n: int) -> pa.Table:
    """`t` sorted, without repeated rows, with the first n rows of each group."""
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in group] + sort, null_placement="at_end"))
    if not len(t):
        return t

    def changed(cols: list[str]) -> np.ndarray:
        out = np.zeros(len(t), bool)
        out[0] = True
        for c in cols:
            a = t[c].combine_chunks()
            x, y = a[1:], a[:-1]
            same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
        return out

    t = t.filter(pa.array(changed(group + [c for c, _ in sort])))
    first = np.flatnonzero(changed(group))
    rank = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
    return t.filter(pa.array(rank < n))


def _key_parts(tables: list[pa.Table], column: str, down: bool) -> list[list]:
    """The column of each table in a form that sorts as SQL does, nulls last."""
    nulls = any(t[column].null_count for t in tables)
    out = []
    for t in tables:
        v = t[column].to_pylist()
        if nulls:
            out.append([(1, 0) if x is None else (0, -x if down else x) for x in v])
        else:
            out.append([-x for x in v] if down else v)
    return out


def merge_tables(tables: list[pa.Table], group: list[str], sort: list[tuple[str, str]], n: int) -> pa.Table:
    """The first n rows of each group of several sorted tables."""
    cols = {c: _key_parts(tables, c, d == "descending") for c, d in [*((g, "ascending") for g in group), *sort]}
    runs = [Run(list(zip(*(cols[c][i] for c in group))), list(zip(*(cols[c][i] for c, _ in sort)))) for i in range(len(tables))]
    start = np.append(0, np.cumsum([len(t) for t in tables]))
    rows = [start[w] + at for w, at in merge_runs(runs, n)]
    return pa.concat_tables(tables).take(pa.array(rows, pa.int64()))


def top_n(df: DataFrame, group: list[str], score: str, ties: list[str], n: int, buckets: int | None = None) -> DataFrame:
    """Rows (group, score, ties) of the first n of each group by score descending, then ties ascending; texts by bytes.

    Rows whose score is null or NaN do not count. Rows equal in group, score and ties count once, so that records delivered twice
    give one row. A null group key is a group of its own; null ties come last. Groups with fewer rows give all;
    an empty table gives an empty one. Other columns of `df`, whatever their names, are dropped.
    """
    spark = df.sparkSession
    cols = [*group, score, *ties]
    src = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(*cols)
    sort = [(score, "descending"), *[(c, "ascending") for c in ties]]
    plain = T.StructType(src.schema.fields)
    tagged = T.StructType([*src.schema.fields, T.StructField("_run", T.LongType())])

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's batches as few sorted runs."""
        task, made, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def run() -> pa.Table:
            return _cut(pa.concat_tables(held), group, sort, n)

        def tag(t: pa.Table) -> list[pa.RecordBatch]:
            return t.append_column("_run", pa.array(np.full(len(t), (task << 20) + made, np.int64))).to_batches()

        for b in batches:
            if b.num_rows:
                held.append(_cut(pa.Table.from_batches([b]), group, sort, n))
                rows += len(held[-1])
            if rows > RUN_ROWS:
                held = [run()]
                rows = len(held[0])
                if rows > RUN_ROWS // 2:  # most rows stay: these are other groups or the first of theirs
                    yield from tag(held[0])
                    made, held, rows = made + 1, [], 0
        if held:
            yield from tag(run())

    def merge(t: pa.Table) -> pa.Table:
        """All runs of a bucket, told apart by `_run`."""
        t = t.sort_by([("_run", "ascending")])
        run = t["_run"].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run))
        rows = t.select(cols)
        # a run may have come in pieces: sorting it again is near linear
        return merge_tables([_cut(rows.slice(a, b - a), group, sort, n) for a, b in zip(cuts[:-1], cuts[1:])], group, sort, n)

    runs = materialize(src.mapInArrow(form, tagged), "runs")
    total, several = runs.agg(F.count(F.lit(1)), F.countDistinct("_run")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(c) for c in group]), F.lit(buckets or max(least, -(-total // BUCKET_ROWS)))))
    if several > FAN_IN:
        parts = -(-several // FAN_IN)
        runs = runs.withColumn("_part", F.pmod(F.xxhash64("_run"), F.lit(parts)))
        level = T.StructType([*tagged.fields, T.StructField("_bucket", T.LongType())])
        runs = runs.groupBy("_bucket", "_part").applyInArrow(lambda key, t: _tag(merge(t), key), level)
    return runs.groupBy("_bucket").applyInArrow(merge, plain)


def _tag(t: pa.Table, key) -> pa.Table:
    """Merged rows as one run of their bucket."""
    bucket, part = (np.full(len(t), k.as_py(), np.int64) for k in key)
    return t.append_column("_run", pa.array(part)).append_column("_bucket", pa.array(bucket))
