"""One ranking out of several scores of different scales: how often walks over ranks are at each item.

From an item the walk picks one of the scores at random and jumps to any of the items that this score ranks higher, all alike, or to any item
at all if there is none. With damping it jumps to any item at times. Only ranks enter, so that no score outweighs another by its range.
One step is a prefix sum over each score's order: an item receives, from all items ranked below it, their share divided by the
number of items above them.

That walk rewards being first far more than it blames being last: an item that is first by two scores and last by two would
win. So a second walk, down to lower-ranked items, is taken along, and items are ordered by the ratio of the two stationary
shares; each score then has an equal say at both ends.

Groups of up to LOCAL items are walked within one task each; larger ones by the same steps over distributed running sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penumbra.plans.ordered import range_blocks, running_sum
from penumbra.session import forget, materialize

LOCAL = 200_000
BATCH = 1_000_000  # numbers of the groups that are walked together
DAMPING = 0.85
TOLERANCE = 1e-11  # a walk has converged when its shares move by less, summed up; in a task and spread alike


def most_steps(damping: float) -> int:
    """Steps after which a walk must have converged: each takes what it moves down to the share `damping`, from 2 at most."""
    return 2 + math.ceil(math.log(TOLERANCE / 2) / math.log(damping)) if damping > 0 else 2


def stationary(worse: np.ndarray, sizes: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """Stationary shares of the items of several groups at once, (groups, items).

    worse is (groups, items, scores), where a larger number is a worse rank and equal numbers are ties; of group g the first sizes[g] items count.
    A group that has converged rests, so that its shares do not depend on what it is walked with.
    """
    groups, n, m = worse.shape
    real = np.arange(n)[None, :] < sizes[:, None]
    worse = np.where(real[:, :, None], worse, np.inf)
    order = np.argsort(worse, axis=1, kind="stable")
    back = np.argsort(order, axis=1, kind="stable")
    v = np.take_along_axis(worse, order, axis=1)
    place = np.arange(n)[None, :, None]
    new_value = np.concatenate([np.ones((groups, 1, m), bool), v[:, 1:] != v[:, :-1]], axis=1)
    above = np.maximum.accumulate(np.where(new_value, place, 0), axis=1)  # items strictly better
    last = np.concatenate([new_value[:, 1:], np.ones((groups, 1, m), bool)], axis=1)
    end = np.minimum.accumulate(np.where(last, place + 1, n)[:, ::-1], axis=1)[:, ::-1]  # where the strictly worse ones begin
    counts = real[:, :, None]  # padding is last in every order
    top = (above == 0) & counts
    weight = np.where(counts & ~top, 1.0 / np.maximum(above, 1), 0.0)
    size = sizes[:, None].astype(float)
    pi = real / size
    below, active = np.zeros((groups, n + 1, m)), np.arange(groups)
    for _ in range(most_steps(damping)):
        p = np.take_along_axis(np.broadcast_to(pi[active][:, :, None], (len(active), n, m)), order[active], axis=1)
        suffix = below[: len(active)]
        suffix[:, :n] = np.cumsum((p * weight[active])[:, ::-1], axis=1)[:, ::-1]
        got = np.take_along_axis(np.take_along_axis(suffix, end[active], axis=1), back[active], axis=1).sum(2)
        new = (1 - damping) / size[active] + damping * (got + (p * top[active]).sum((1, 2))[:, None] / size[active]) / m
        new = np.where(real[active], new, 0.0)
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - pi[active]).sum(1)
        pi[active] = new
        active = active[moved >= TOLERANCE]
        if not len(active):
            return pi
    raise ArithmeticError("the walk did not converge")


def _ranked(pdf: pd.DataFrame, group: str, item: str, m: int, damping: float) -> pd.DataFrame:
    """Shares and positions of whole groups, those of about one size walked together."""
    w = pdf[[f"_w{i}" for i in range(m)]].to_numpy(float)
    # dense ranks; NaN sorts last, after infinity, and is one rank
    ranks = np.column_stack([np.unique(w[:, i], return_inverse=True)[1] for i in range(m)]).astype(float)
    number = pd.factorize(pdf[group])[0]
    rows = np.argsort(number, kind="stable")
    sizes = np.bincount(number)
    starts = np.append(0, np.cumsum(sizes)[:-1])
    share, by_size, at = np.empty(len(pdf)), np.argsort(sizes, kind="stable"), 0
    while at < len(by_size):
        # the largest of a batch comes last: as many groups as keep it within BATCH numbers
        many = np.arange(1, len(by_size) - at + 1) * sizes[by_size[at:]] * m <= BATCH
        some = by_size[at : at + max(1, int(many.argmin()) if not many.all() else len(many))]
        n = sizes[some]
        col = np.arange(n.max())
        real = col[None, :] < n[:, None]
        take = rows[np.where(real, starts[some][:, None] + col, starts[some][:, None])]
        x = ranks[take]
        share[take[real]] = np.round(stationary(x, n, damping)[real] / stationary(-x, n, damping)[real], 9)
        at += len(some)
    out = pd.DataFrame({group: pdf[group].to_numpy(), item: pdf[item].to_numpy(), "share": share, "_g": number}).sort_values(["_g", "share", item], ascending=[True, False, True])
    out["position"] = out.groupby("_g").cumcount() + 1
    return out.drop(columns="_g")


def _worse_number(df: DataFrame, scores: dict[str, int]) -> DataFrame:
    """Columns _w0.. where a larger number is worse; null and NaN are worse than all, and equal."""
    cols = []
    for i, (c, sign) in enumerate(scores.items()):
        v = F.col(c).cast("double")
        cols.append(F.when(v.isNull() | F.isnan(v), F.lit(float("nan"))).otherwise(-sign * v + 0.0).alias(f"_w{i}"))
    return df.select("*", *cols)


def rank_walk(df: DataFrame, group: str, item: str, scores: dict[str, int], damping: float = DAMPING, local: int = LOCAL) -> DataFrame:
    """Rows (group, item, share, position): share is the ratio of up-walk to down-walk; position 1 is the first of its group.

    Equal shares are ordered by item.

    scores maps a column to 1 if more is better, -1 if less is. A null or NaN score is the worst of its group. Rows repeated for one group and item
    count once (of differing copies, the one with the least score values). Rows whose group or item is null are left out; an empty table
    gives an empty one; a group of one item has share 1. Other columns are dropped. damping is from 0 to less than 1. Both ways of walking stop by
    the same rule, so that a group's size does not change its ranking.
    """
    if not 0 <= damping < 1:
        raise ValueError(f"damping must be at least 0 and less than 1: {damping}")
    m = len(scores)
    one = _worse_number(df.where(F.col(group).isNotNull() & F.col(item).isNotNull()), scores).groupBy(group, item).agg(F.min(F.struct(*[f"_w{i}" for i in range(m)])).alias("_w"))
    one = materialize(one.select(group, item, "_w.*"), "walk")
    big = materialize(one.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local).select(group), "big")
    some = not big.isEmpty()
    types = {f.name: f.dataType for f in one.schema.fields}
    schema = T.StructType([T.StructField(group, types[group]), T.StructField(item, types[item]), T.StructField("share", T.DoubleType()), T.StructField("position", T.LongType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # of a group that may go on
        for b in batches:
            if not len(b):
                continue
            go_on = (b[group] == b[group].iloc[-1]).to_numpy()
            if go_on.all() and (not rest or rest[-1][group].iloc[-1] == b[group].iloc[-1]):
                rest.append(b)
                continue
            yield _ranked(pd.concat([*rest, b[~go_on]]), group, item, m, damping)
            rest = [b[go_on]]
        if rest:
            yield _ranked(pd.concat(rest), group, item, m, damping)

    small = one.join(big, group, "left_anti") if some else one
    # few bytes but much work: as many tasks as the session has partitions, which adaptive execution must not merge
    small = small.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), group).sortWithinPartitions(group)
    res = small.mapInPandas(walk, schema)
    if some:
        res = res.unionByName(_distributed(materialize(one.join(big, group, "left_semi"), "walk"), group, item, m, damping))
    return res


def _distributed(one: DataFrame, group: str, item: str, m: int, damping: float) -> DataFrame:
    """The same walk for groups too large for one task; each step is one running sum over the tie groups of all scores."""
    w = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.isnan(f"_w{i}").alias("bad"), F.when(F.isnan(f"_w{i}"), 0.0).otherwise(F.col(f"_w{i}")).alias("w")) for i in range(m)]))
    long = one.select(group, item, w.alias("_x")).select(group, item, "_x.*")
    keys, order = [group, "s"], [F.col("bad"), F.col("w")]
    ties = range_blocks(long.groupBy(*keys, "bad", "w").agg(F.count(F.lit(1)).alias("size")), keys, order)
    ran = running_sum(ties, keys, order, "size", "upto", "all")
    up = ran.select(*keys, "bad", "w", (F.col("upto") - F.col("size")).alias("up"), (F.col("all") - F.col("upto")).alias("down"))
    ties = ties.drop("size")
    long = materialize(long.join(up, [*keys, "bad", "w"]), "long")
    n = one.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))  # one row per group that is too large for a task
    start = one.select(group, item).join(n, group)
    shares = []
    for way in ("up", "down"):
        pi = materialize(start.withColumn("share", 1 / F.col("_n")), "pi")
        for _ in range(most_steps(damping)):
            at = long.join(pi, [group, item])
            gives = at.groupBy(*keys, "bad", "w").agg(F.sum(F.when(F.col(way) > 0, F.col("share") / F.col(way)).otherwise(0.0)).alias("gives"))
            run = running_sum(gives.join(ties, [*keys, "bad", "w"]), keys, order, "gives", "_cum", "_all")
            far = F.col("_all") - F.col("_cum") if way == "up" else F.col("_cum") - F.col("gives")
            lost = at.where(F.col(way) == 0).groupBy(group).agg(F.sum("share").alias("_lost"))
            got = at.join(run.select(*keys, "bad", "w", far.alias("far")), [*keys, "bad", "w"]).groupBy(group, item).agg(F.sum("far").alias("_got"), F.first("_n").alias("_n")).join(lost, group)
            new = (1 - damping) / F.col("_n") + damping * (F.col("_got") + F.col("_lost") / F.col("_n")) / m
            new = materialize(got.select(group, item, "_n", new.alias("share")), "pi")
            # the rule of one task, for the group that moves most
            moved = new.alias("a").join(pi.alias("b"), [group, item]).groupBy(group).agg(F.sum(F.abs(F.col("a.share") - F.col("b.share"))).alias("_m")).agg(F.max("_m")).first()[0]
            forget(pi)
            pi = new
            if moved is None or moved < TOLERANCE:
                break
        else:
            raise ArithmeticError("the walk did not converge")
        shares.append(pi.select(group, item, F.col("share").alias(way)))
    pi = shares[0].join(shares[1], [group, item]).select(group, item, (F.col("up") / F.col("down")).alias("share"))
    done = range_blocks(pi.select(group, item, F.round("share", 9).alias("share"), F.lit(1).alias("_one")), [group], [F.desc("share"), F.col(item)])
    return running_sum(done, [group], [F.desc("share"), F.col(item)], "_one", "position").select(group, item, "share", F.col("position").cast("long"))


def best(ranked: DataFrame) -> DataFrame:
    """The first of each group."""
    return ranked.where("position = 1")
