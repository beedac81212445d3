"""Queries of the membership operators over the test tables, with the SQL of every step that SQL can express.

Each runs the operator itself with a fixed start and few steps, so that the same numbers come out of plain SQL. The inputs are the first
dimensions of the embeddings (E2, E4), rescaled line items, a graph of suppliers and parts, and the documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions import metrics
from penumbra.functions.membership import ratio, sqdist, uniform
from penumbra.operators import autoencoder, consensus, documents, federated, graphs, images, mixtures, pairwise, prototypes
from penumbra.operators.base import REGISTRY, Points, kmeanspp, spread
from penumbra.queries import ORACLES, QUERIES, query, table

__all__ = ["autoencoder", "REGISTRY"]


# inputs -------------------------------------------------------------------------------------------------------------


def embedded(spark, sf, d: int) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, d), lambda v: v.cast("double")).alias("features"))


def first_rows(p: Points, k: int) -> np.ndarray:
    """The features of the k rows of least id."""
    return p.first(lambda ids, x: ids.astype(float), k)[1]


def points(spark, sf, d: int = 4, k: int = 3) -> tuple[Points, np.ndarray]:
    p = Points(embedded(spark, sf, d))
    return p, first_rows(p, k)


def items(spark, sf, a: str, b: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(F.xxhash64(*t.columns).alias("id"), F.array(F.expr(a), F.expr(b)).alias("features"))


def memberships(m, name: str = "u") -> DataFrame:
    return m.memberships.select(F.col("id").alias("vec_id"), "k", F.round("u", 6).alias(name))


def rows(spark, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame(data, columns=[c.split()[0] for c in schema.split(", ")]), schema)


def centre_rows(spark, c: np.ndarray) -> DataFrame:
    d = c.shape[1]
    return rows(spark, [(i, *[round(float(v), 6) + 0.0 for v in r]) for i, r in enumerate(c)], "k int, " + ", ".join(f"c{j + 1} double" for j in range(d)))


# SQL pieces ---------------------------------------------------------------------------------------------------------


def cols(d: int, form: str, sep: str = ", ") -> str:
    return sep.join(form.replace("#", str(j + 1)) for j in range(d))


def base(d: int = 4, k: int = 3) -> str:
    """CTEs p (points), c0 (first rows as centres) and d0 (squared distances)."""
    return f"""with p as (select vec_id as id, {cols(d, "embedding[#]::double as x#")} from embeddings),
c0 as (select row_number() over (order by id) - 1 as k, {cols(d, "x# as c#")} from (select * from p order by id limit {k})), {dist(d, 0)}"""


def dist(d: int, i: int | str) -> str:
    return f"d{i} as (select p.*, k, {cols(d, 'c#')}, {cols(d, '(x# - c#) * (x# - c#)', ' + ')} as d2 from p, c{i})"


def share(i: int | str, weight: str, of: str | None = None) -> str:
    """u{i}: shares in proportion to a weight of each row of d{i}."""
    return f"u{i} as (select *, w / sum(w) over (partition by id) as u from (select *, {weight} as w from {of or f'd{i}'}))"


def centre(d: int, i: int | str, weight: str, of: str) -> str:
    return f"c{i} as (select k, {cols(d, f'sum(({weight}) * x#) / sum({weight}) as c#')} from {of} group by k)"


OUT_U = "select id as vec_id, cast(k as integer) as k, round(u, 6) as u from "
INV = "1 / greatest(d2 + 1e-12, 1e-300)"
INV2 = "1 / pow(sqrt(d2) + 1e-8, 2)"


def out_c(d: int, of: str) -> str:
    return f"select cast(k as integer) as k, {cols(d, 'round(c#, 6) + 0.0 as c#')} from {of}"


# centre-based operators ---------------------------------------------------------------------------------------------


@query(sql=f"{base()}, {share(0, INV)} {OUT_U} u0")
def fcm_memberships(spark, sf):
    p, c = points(spark, sf)
    return memberships(prototypes.FCM(k=3, init=c, max_iter=1).fit(p))


ITEM_CENTRES = ((0.1, 0.1), (0.5, 0.5), (0.9, 0.9))
_ITEMS = """with p as (select row_number() over () as id, l_quantity / 50 as x1, l_extendedprice / 105000 as x2 from lineitem),
c0 as (select * from (values (0, 0.1::double, 0.1::double), (1, 0.5, 0.5), (2, 0.9, 0.9)) t(k, c1, c2)), """


@query(sql=_ITEMS + ", ".join(f"{dist(2, i)}, {share(i, INV)}, {centre(2, i + 1, 'u * u', f'u{i}')}" for i in range(3)) + " " + out_c(2, "c3"))
def fcm_centers_3it(spark, sf):
    p = Points(items(spark, sf, "l_quantity / 50", "l_extendedprice / 105000"))
    return centre_rows(spark, prototypes.FCM(k=3, init=np.array(ITEM_CENTRES), max_iter=3, tol=-1.0).fit(p).centers)


@query(
    sql=f"{base()}, "
    + ", ".join(f"{share(i, INV)}, {centre(4, i + 1, 'u * u', f'u{i}')}, {dist(4, i + 1)}" for i in range(3))
    + ", "
    + ", ".join(f"o{i} as (select {i + 1} as iter, sum(u{i}.u * u{i}.u * d{i + 1}.d2) as objective from u{i} join d{i + 1} using (id, k))" for i in range(3))
    + " select cast(iter as integer) as iter, round(objective, 6) as objective from (select * from o0 union all select * from o1 union all select * from o2)"
)
def fcm_objective(spark, sf):
    p, c = points(spark, sf)
    m = prototypes.FCM(k=3, init=c, max_iter=3, tol=-1.0).fit(p)
    return rows(spark, [(i + 1, round(v, 6)) for i, v in enumerate(m.history)], "iter int, objective double")


_AFTER = f"{base()}, {share(0, INV2)}, {centre(4, 1, 'u * u', 'u0')}, {dist(4, 1)}, {share(1, INV2)}"


@query(sql=f"{_AFTER} {OUT_U} u1")
def afcmsimple_step(spark, sf):
    p, c = points(spark, sf)
    return memberships(prototypes.AFCMSimple(k=3, init=c, max_iter=1, tol=-1.0).fit(p))


@query(sql=f"{base()}, " + ", ".join(f"{share(i, INV2)}, {centre(4, i + 1, 'u * u', f'u{i}')}" + (f", {dist(4, i + 1)}" if i < 2 else "") for i in range(3)) + " " + out_c(4, "c3"))
def cafcm_level(spark, sf):
    p, c = points(spark, sf)
    return centre_rows(spark, prototypes.CAFCM(k=3, init=c, m_end=1.95, max_iter=3, tol=-1.0).fit(p).centers)


@query(sql=f"{base()}, {share(0, INV2)}, {centre(4, 1, 'u * u', 'u0')}, f as (select k, {cols(4, 'c# - 0.1 * (3 * c# - sum(c#) over ()) as c#')} from c1) {out_c(4, 'f')}")
def cafhfcm_step(spark, sf):
    p, c = points(spark, sf)
    return centre_rows(spark, prototypes.CAFHFCM(k=3, init=c, max_iter=1, tol=-1.0).fit(p).centers)


@query(sql=f"{_AFTER} select round(sum(u * u * d2), 6) as compactness, round(-sum(u * ln(u + 1e-8)), 6) as entropy from u1")
def entropyfcm_objective(spark, sf):
    p, c = points(spark, sf)
    e = prototypes.ENTROPYFCM(k=3, init=c, max_iter=1, tol=-1.0).fit(p).extras
    return rows(spark, [(round(e["compactness"], 6), round(e["entropy"], 6))], "compactness double, entropy double")


_PCM = f"""{base()}, own as (select *, row_number() over (partition by id order by d2, k) as r from d0),
e0 as (select k, avg(d2) filter (r = 1) + 1e-12 as eta from own group by k),
t0 as (select d0.*, 1 / (1 + (d2 + 1e-12) / (eta + 1e-12)) as t from d0 join e0 using (k)), {centre(4, 1, "t * t", "t0")}, {dist(4, 1)},
e1 as (select t0.k, sum(t * t * d1.d2) / (sum(t * t) + 1e-12) + 1e-12 as eta from t0 join d1 on t0.id = d1.id and t0.k = d1.k group by t0.k)"""


@query(sql=f"{_PCM} select cast(k as integer) as k, round(eta, 6) as eta from e1")
def pcm_eta(spark, sf):
    p, c = points(spark, sf)
    eta = prototypes.PCM(k=3, init=c, max_iter=1).fit(p).extras["etas"]
    return rows(spark, [(i, round(float(v), 6)) for i, v in enumerate(eta)], "k int, eta double")


@query(sql=f"{_PCM} select id as vec_id, cast(d1.k as integer) as k, round(1 / (1 + (d2 + 1e-12) / (eta + 1e-12)), 6) as t from d1 join e1 using (k)")
def pcm_typicality(spark, sf):
    p, c = points(spark, sf)
    return memberships(prototypes.PCM(k=3, init=c, max_iter=1).fit(p), "t")


_PFCM = f"""{base()}, {share(0, "1 / (d2 + 1e-10)")}, g as (select k, sum(u * u * (d2 + 1e-10)) / sum(u * u) as gamma from u0 group by k),
ut as (select u0.*, 1 / (1 + (d2 + 1e-10) / gamma) as t from u0 join g using (k))"""


@query(sql=f"{_PFCM} select id as vec_id, cast(k as integer) as k, round(u, 6) as u, round(t, 6) as t from ut")
def pfcm_step(spark, sf):
    p, c = points(spark, sf)
    m = prototypes.PFCM(k=3, init=c, max_iter=1).fit(p)
    return m.memberships.join(m.extras["typicalities"].withColumnRenamed("u", "t"), ["id", "k"]).select(F.col("id").alias("vec_id"), "k", F.round("u", 6).alias("u"), F.round("t", 6).alias("t"))


@query(sql=f"{_PFCM}, {centre(4, 1, 'u * u + t * t', 'ut')}, {dist(4, 1)}, {share(1, '1 / (d2 + 1e-10)')} {OUT_U} u1")
def pfcm_predict(spark, sf):
    p, c = points(spark, sf)
    m = prototypes.PFCM(k=3, init=c, max_iter=1).fit(p)
    return m.transform(embedded(spark, sf, 4)).select(F.col("id").alias("vec_id"), "k", F.round("u", 6).alias("u"))


_ECM = f"{base()}, f as (select id, k, 1 / greatest(d2, 1e-10) as w from d0 union all select id, 3, 1 / 100.0 from p), m as (select *, w / sum(w) over (partition by id) as m from f)"


@query(sql=f"{_ECM} select id as vec_id, cast(k as integer) as k, round(m, 6) as m from m")
def ecm_mass(spark, sf):
    p, c = points(spark, sf)
    return prototypes.ECM(k=3, init=c, max_iter=1).fit(p).extras["mass"].select(F.col("id").alias("vec_id"), "k", F.round("u", 6).alias("m"))


@query(sql=f"{_ECM}, u as (select id, k, m / sum(m) over (partition by id) as u from m where k < 3) {OUT_U} u")
def ecm_pignistic(spark, sf):
    p, c = points(spark, sf)
    return memberships(prototypes.ECM(k=3, init=c, max_iter=1).fit(p))


_KGAP = "1 / (case when exp(-d2) = 1 then 2.220446049250313e-16 else 1 - exp(-d2) end)"


@query(sql=f"{base()}, {share(0, _KGAP)}, {centre(4, 1, 'u * u * exp(-d2)', 'u0')}, {dist(4, 1)}, {share(1, _KGAP)} {OUT_U} u1")
def kfcm_step(spark, sf):
    p, c = points(spark, sf)
    return memberships(prototypes.KFCM(k=3, init=c, max_iter=1).fit(p))


@query(
    sql=_ITEMS.replace("l_quantity / 50", "l_quantity * 2").replace("l_extendedprice / 105000", "l_extendedprice / 1050").replace("0.1::double, 0.1::double", "10::double, 10::double").replace("0.5, 0.5", "50, 50").replace("0.9, 0.9", "90, 90")
    + f"{dist(2, 0)}, {share(0, 'case when sqrt(d2) <= 20 then 1.0 else 1 / (1 + sqrt(d2) - 20) end')}, {centre(2, 1, 'u * u', 'u0')} {out_c(2, 'c1')}"
)
def fcc_step(spark, sf):
    p = Points(items(spark, sf, "l_quantity * 2", "l_extendedprice / 1050"))
    return centre_rows(spark, prototypes.FCC(k=3, init=100 * np.array(ITEM_CENTRES), max_iter=1, tol=-1.0).fit(p).centers)


@query(
    sql=f"""{base()}, n as (select *, sqrt(d2) as d, min(sqrt(d2)) over (partition by id) as least from d0),
s as (select id, k, case when d <= 1.2 * greatest(least, 2.2250738585072014e-308) or d = least then 1.0::double else 0.0::double end as upper from n),
t as (select *, sum(upper) over (partition by id) as c from s)
select id as vec_id, cast(k as integer) as k, case when c = 1 then upper else 0.0::double end as lower, upper, round(upper / c, 6) as u from t"""
)
def rough_kmeans_approx(spark, sf):
    p, c = points(spark, sf)
    m = prototypes.RoughKMeans(k=3, init=c, max_iter=1).fit(p)
    low, up = (m.extras[n].withColumnRenamed("u", n) for n in ("lower", "upper"))
    return m.memberships.join(low, ["id", "k"]).join(up, ["id", "k"]).select(F.col("id").alias("vec_id"), "k", "lower", "upper", F.round("u", 6).alias("u"))


@query(sql=f"with p as (select label, {cols(4, 'embedding[#]::double as x#')} from embeddings where vec_id % 5 = 0) select cast(label as integer) as k, {cols(4, 'round(avg(x#), 6) + 0.0 as c#')} from p group by label")
def sfcmep_class_centers(spark, sf):
    d, k = _fifth_labelled(spark, sf)
    return centre_rows(spark, prototypes.SFCMEP(k=k, max_iter=0).fit(d).centers)


def _fifth_labelled(spark, sf) -> tuple[DataFrame, int]:
    t = table(spark, sf, "embeddings")
    d = embedded(spark, sf, 4).join(t.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, F.col("label")).alias("label")), "id")
    return d, int(t.agg(F.max("label")).first()[0]) + 1


def _sfcmep_step(i: int) -> str:
    """c{i} and u{i}: the centres from u{i - 1} and the memberships after a step to them."""
    return f"""c{i} as (select k, {cols(4, 'sum(u * x#) / (sum(u) + 1e-8) as c#')} from u{i - 1} group by k), {_sfcmep_move(i, f'u{i - 1}')}"""


def _sfcmep_move(i: int, of: str) -> str:
    return f"""e{i} as (select t.id, t.k, {cols(4, 't.x#')}, t.u, {cols(4, '(t.x# - c.c#) * (t.x# - c.c#)', ' + ')} as d2 from {of} t join c{i} c on c.k = t.k),
w{i} as (select *, exp(min(d2) over (partition by id) - d2) * case when u <= 1e-8 then 1 else u end as w from e{i}),
u{i} as (select id, k, {cols(4, 'x#')}, w / (sum(w) over (partition by id) + 1e-12) as u from w{i})"""


@query(
    sql=f"""with p as (select vec_id as id, case when vec_id % 5 = 0 then label end as label, {cols(4, 'embedding[#]::double as x#')} from embeddings),
c0 as materialized (select label as k, {cols(4, 'avg(x#) as c#')} from p where label is not null group by label),
d as (select p.*, k, sqrt({cols(4, '(x# - c#) * (x# - c#)', ' + ')}) as d from p, c0), v as (select *, min(d) over (partition by id) / d as v from d),
r as (select *, least(case when label = k then 1e-6 + 0.5 * v else 0.5 * v end, 1.0) as r from v),
l as (select id, max(r) as hi, min(r) as lo from r where label is not null group by id), h as (select 0.5 * (avg(hi) + 1 - ((select count(*) from c0) - 1) * avg(lo)) as hat from l),
s as (select id, k, {cols(4, 'x#')}, case when label is null then hat else r end as u from r, h),
{_sfcmep_move(0, 's')}, {_sfcmep_step(1)}, {_sfcmep_step(2)}, {_sfcmep_step(3)} {OUT_U} u3"""
)
def sfcmep_update(spark, sf):
    d, k = _fifth_labelled(spark, sf)
    return memberships(prototypes.SFCMEP(k=k, max_iter=3, tol=-1.0, reset_share=0.0).fit(d))


_AXES = np.eye(4)[:, :2]
_RPFKM = f"""{base()}, f0 as (select d0.*, sqrt((x1 - c1) * (x1 - c1) + (x2 - c2) * (x2 - c2)) as l from d0), {share(0, 'exp(-l / 0.2)', 'f0')},
m as (select k, sum(u * x1) / (sum(u) + 1e-10) as m1, sum(u * x2) / (sum(u) + 1e-10) as m2 from u0 group by k),
f1 as (select id, m.k, sqrt((x1 - m1) * (x1 - m1) + (x2 - m2) * (x2 - m2)) as l from p, m), {share(1, 'exp(-l / 0.2)', 'f1')}"""


def _rpfkm(spark, sf):
    p, c = points(spark, sf)
    return prototypes.RPFKM(k=3, max_iter=1, init=(_AXES, c)).fit(p)


@query(sql=f"{_RPFKM} select cast(k as integer) as k, round(m1, 6) + 0.0 as c1, round(m2, 6) + 0.0 as c2 from m")
def rpfkm_means(spark, sf):
    return centre_rows(spark, _rpfkm(spark, sf).extras["means"])


@query(sql=f"{_RPFKM} {OUT_U} u1")
def rpfkm_memberships(spark, sf):
    return memberships(_rpfkm(spark, sf))


@query(sql=f"{base()}, {share(0, '1 / greatest(d2, 1e-300)')} {OUT_U} u0")
def ratio_rule(spark, sf):
    """Shares in proportion to a power of distances, of all points."""
    p, c = points(spark, sf)
    return p.assign(lambda ids, x: ratio(sqdist(x, c), 1.0)).select(F.col("id").alias("vec_id"), "k", F.round("u", 6).alias("u"))


def _uniform(seed: int, of: str) -> str:
    """CTEs that end in h{seed} (id, h): a uniform in (0, 1) for each id of a table."""
    add = lambda a, b: f"((({a})::uhugeint + {b}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"
    start = (seed * 0x9E3779B97F4A7C15 + 1) % 2**64
    out, last = [], of
    todo = [f"select id, {add('id', start)} as z from @"]
    for turn in range(2):
        for shift, factor in ((30, 13787848793156543929), (27, 10723151780598845931), (31, 1)):
            todo.append(f"select id, ((xor(z, z >> {shift})::uhugeint * {factor}::uhugeint) % 18446744073709551616::uhugeint)::ubigint as z from @")
        if not turn:
            todo.append(f"select id, {add('z', 0x9E3779B97F4A7C15)} as z from @")
    for i, q in enumerate(todo):
        out.append(f"g{seed}_{i} as ({q.replace('@', last)})")
        last = f"g{seed}_{i}"
    return ", ".join(out) + f", h{seed} as (select id, ((z >> 11)::double + 0.5) / 9007199254740992.0 as h from {last})"


@query(
    sql=f"""with p as (select vec_id as id, {cols(4, 'embedding[#]::double as x#')} from embeddings), {_uniform(0, 'p')}, {_uniform(1, 'p')},
a as (select p.* from p join h0 using (id) order by h, id limit 1),
r as (select p.id, -ln(h) / greatest({cols(4, '(p.x# - a.x#) * (p.x# - a.x#)', ' + ')}, 1e-300) as r from p join h1 using (id), a),
b as (select p.* from p join r using (id) order by r, id limit 1)
select 0 as k, {cols(4, 'round(x#, 6) + 0.0 as c#')} from a union all select 1, {cols(4, 'round(x#, 6) + 0.0')} from b"""
)
def kmeanspp_first2(spark, sf):
    """The first two centres that are drawn by distance."""
    return centre_rows(spark, kmeanspp(points(spark, sf)[0], 2, 0))


# shapes and mixtures ------------------------------------------------------------------------------------------------

_COV2 = "sum(w * (x1 - c1) * (x1 - c1)) / sum(w) + 1e-6 as a, sum(w * (x1 - c1) * (x2 - c2)) / sum(w) as b, sum(w * (x2 - c2) * (x2 - c2)) / sum(w) + 1e-6 as e"
_MAHA = "(e * (x1 - c1) * (x1 - c1) - 2 * b * (x1 - c1) * (x2 - c2) + a * (x2 - c2) * (x2 - c2)) / (a * e - b * b)"


@query(sql=f"{base(2)}, s as (select k, {_COV2} from (select *, 1 / 9.0 as w from d0) group by k), {share(1, f'1 / greatest(sqrt(a * e - b * b) * {_MAHA}, 1e-18)', '(select d0.*, a, b, e from d0 join s using (k))')} {OUT_U} u1")
def gk_step(spark, sf):
    p, c = points(spark, sf, 2)
    return memberships(mixtures.GK(k=3, init=c, max_iter=1).fit(p))


@query(
    sql=f"""{base(2)}, {share(0, "1 / greatest(d2, 1e-300)")}, {centre(2, 1, "u * u", "u0")},
q as (select id, u0.k, x1, x2, c1.c1 as c1, c1.c2 as c2, u * u as w from u0 join c1 using (k)),
s as (select k, {_COV2}, sum(w) / count(*) as prior from q group by k),
l as (select q.*, -(0.5 * ln(a * e - b * b) - ln(prior) + 0.5 * {_MAHA}) as l from q join s using (k)),
m as (select *, max(l) over (partition by id) as top from l), {share(1, "exp(l - top)", "(select id, k, l, top from m)")} {OUT_U} u1"""
)
def gathgeva_step(spark, sf):
    p, c = points(spark, sf, 2)
    return memberships(mixtures.GathGeva(k=3, init=c, init_iter=1, max_iter=1).fit(p))


def _mixture_rows(spark, m, d: int) -> DataFrame:
    cov = np.asarray(m.extras["covariances"]).reshape(m.n_clusters, -1)
    data = [(k, *[round(float(v), 6) + 0.0 for v in (m.extras["weights"][k], *m.centers[k], *cov[k])]) for k in range(m.n_clusters)]
    return rows(spark, data, "k int, w double, " + ", ".join([f"c{j + 1} double" for j in range(d)] + [f"v{j + 1} double" for j in range(cov.shape[1])]))


def _em(d: int, log: str, var: str) -> str:
    return f"""l as (select *, {log} + ln(1 / 3.0 + 1e-32) as l from d0), t as (select *, max(l) over (partition by id) as top from l),
{share(0, "exp(l - top)", "t")}, n as (select k, sum(u) + 1e-12 as n, sum(u) / count(*) as w, {cols(d, "sum(u * x#) / (sum(u) + 1e-12) as m#")} from u0 group by k)
select cast(n.k as integer) as k, round(any_value(n.w), 6) as w, {cols(d, "round(any_value(m#), 6) + 0.0 as c#")}, {var} from u0 join n on u0.k = n.k group by n.k"""


@query(
    sql=f"{base()}, g as (select {cols(4, 'var_samp(x#) + 2e-6 as g#')} from p), "
    + _em(4, "-0.5 * (" + cols(4, "ln(2 * pi() * (select g# from g)) + (x# - c#) * (x# - c#) / (select g# from g)", " + ") + ")", cols(4, "round(sum(u * (x# - m#) * (x# - m#)) / any_value(n) + 1e-6, 6) as v#"))
)
def gmm_diag_em(spark, sf):
    p, c = points(spark, sf)
    return _mixture_rows(spark, mixtures.GMM(k=3, init=c, covariance_type="diag", max_iter=1).fit(p), 4)


@query(
    sql=f"{base()}, g as (select ({cols(4, 'var_samp(x#)', ' + ')}) / 4 + 2e-6 as g from p), "
    + _em(4, "-0.5 * (4 * ln(2 * pi() * (select g from g)) + d2 / (select g from g))", "round(sum(u * (" + cols(4, "(x# - m#) * (x# - m#)", " + ") + ")) / (any_value(n) * 4) + 1e-6, 6) as v1")
)
def gmm_spherical_em(spark, sf):
    p, c = points(spark, sf)
    return _mixture_rows(spark, mixtures.GMM(k=3, init=c, covariance_type="spherical", max_iter=1).fit(p), 4)


@query(
    sql=f"{base(2)}, g as (select var_samp(x1) + 2e-6 as a, covar_samp(x1, x2) as b, var_samp(x2) + 2e-6 as e from p), "
    + _em(2, "(select -0.5 * (2 * ln(2 * pi()) + ln(a * e - b * b) + (e * (x1 - c1) * (x1 - c1) - 2 * b * (x1 - c1) * (x2 - c2) + a * (x2 - c2) * (x2 - c2)) / (a * e - b * b)) from g)",
          "round(sum(u * (x1 - m1) * (x1 - m1)) / any_value(n) + 1e-6, 6) + 0.0 as v1, round(sum(u * (x1 - m1) * (x2 - m2)) / any_value(n), 6) + 0.0 as v2, round(sum(u * (x1 - m1) * (x2 - m2)) / any_value(n), 6) + 0.0 as v3, round(sum(u * (x2 - m2) * (x2 - m2)) / any_value(n) + 1e-6, 6) + 0.0 as v4")
)
def gmm_full_2d(spark, sf):
    p, c = points(spark, sf, 2)
    return _mixture_rows(spark, mixtures.GMM(k=3, init=c, max_iter=1).fit(p), 2)


@query(
    sql=f"{base()}, "
    + ", ".join(f"a{i} as (select *, row_number() over (partition by id order by d2, k) as r from d{i}), c{i + 1} as (select k, {cols(4, 'avg(x#) as c#')} from a{i} where r = 1 group by k)" + (f", {dist(4, i + 1)}" if i < 2 else "") for i in range(3))
    + " " + out_c(4, "c3")
)
def lloyd_3it(spark, sf):
    p, c = points(spark, sf)
    return centre_rows(spark, mixtures.lloyd(p, c, 3, -1.0))


@query(sql=f"{base()}, " + ", ".join(f"{share(i, INV)}, {centre(4, i + 1, 'u * u', f'u{i}')}" + (f", {dist(4, i + 1)}" if i < 24 else "") for i in range(25)) + " " + out_c(4, "c25"))
def fcm_centers_25it(spark, sf):
    p, c = points(spark, sf)
    return centre_rows(spark, prototypes.FCM(k=3, init=c, max_iter=25, tol=-1.0).fit(p).centers)


def _ecm_step(i: int) -> str:
    return f"""f{i} as (select id, k, {cols(4, 'x#')}, 1 / greatest(d2, 1e-10) as w from d{i} union all select id, 3, {cols(4, 'x#')}, 1 / 100.0 from p),
u{i} as (select *, w / sum(w) over (partition by id) as u from f{i}), c{i + 1} as (select k, {cols(4, 'sum(u * u * x#) / (sum(u * u) + 1e-10) as c#')} from u{i} where k < 3 group by k)"""


@query(sql=f"{base()}, " + ", ".join(_ecm_step(i) + (f", {dist(4, i + 1)}" if i < 9 else "") for i in range(10)) + " " + out_c(4, "c10"))
def ecm_centers_10it(spark, sf):
    p, c = points(spark, sf)
    return centre_rows(spark, prototypes.ECM(k=3, init=c, max_iter=10, tol=-1.0).fit(p).centers)


def _gmm_step(i: int) -> str:
    """One step of the diagonal mixture, from n{i} (k, w, m#, v#)."""
    return f"""l{i} as (select p.*, k, -0.5 * ({cols(4, "ln(2 * pi() * (v# + 1e-6)) + (x# - m#) * (x# - m#) / (v# + 1e-6)", " + ")}) + ln(w + 1e-32) as l from p, n{i}),
t{i} as (select *, exp(l - max(l) over (partition by id)) as e from l{i}), r{i} as materialized (select *, e / sum(e) over (partition by id) as r from t{i}),
m{i} as materialized (select k, sum(r) + 1e-12 as n, sum(r) / count(*) as w, {cols(4, "sum(r * x#) / (sum(r) + 1e-12) as m#")} from r{i} group by k),
n{i + 1} as materialized (select q.k, any_value(q.w) as w, {cols(4, "any_value(q.m#) as m#")}, {cols(4, "sum(r * (x# - q.m#) * (x# - q.m#)) / any_value(q.n) + 1e-6 as v#")} from r{i} join m{i} q on q.k = r{i}.k group by q.k)"""


@query(
    sql=f"""{base()}, n0 as materialized (select k, 1 / 3.0 as w, {cols(4, "c# as m#")}, {cols(4, "v#")} from c0, (select {cols(4, "var_samp(x#) + 1e-6 as v#")} from p)), """
    + ", ".join(_gmm_step(i) for i in range(8))
    + f""" select cast(k as integer) as k, round(round(w, 6), 5) as w, {cols(4, "round(round(m#, 6), 5) + 0.0 as c#")}, {cols(4, "round(round(v#, 6), 5) as v#")} from n8"""
)
def gmm_diag_8it(spark, sf):
    p, c = points(spark, sf)
    m = mixtures.GMM(k=3, init=c, covariance_type="diag", max_iter=8, tol=-1.0).fit(p)
    d = _mixture_rows(spark, m, 4)
    return d.select("k", *[F.round(c, 5).alias(c) for c in d.columns if c != "k"])


@query(
    sql="""with p as (select l_extendedprice / 105000 as x, 0.05 + l_discount * 9 as y from lineitem),
s as (select avg(x) as mu, stddev_pop(x) + 0.001 as sigma, avg(y) as m, greatest(var_pop(y), 1e-5) as v from p)
select cast(k as integer) as k, round(0.5, 6)::double as w, round(mu, 6) as mu, round(sigma, 6) as sigma, round(m * (m * (1 - m) / v - 1), 6) as alpha, round((1 - m) * (m * (1 - m) / v - 1), 6) as beta
from s, (values (0), (1)) t(k)"""
)
def bgmm_moments(spark, sf):
    e = mixtures.BGMM(k=2, init="uniform", max_iter=1).fit(items(spark, sf, "l_extendedprice / 105000", "0.05 + l_discount * 9")).extras
    return rows(spark, [(k, *[round(float(e[n][k]), 6) for n in ("weights", "mu", "sigma", "alpha", "beta")]) for k in range(2)], "k int, w double, mu double, sigma double, alpha double, beta double")


_BETA = ((2.0, 3.0), (3.0, 2.0)), ((3.0, 2.0), (2.0, 4.0))


@query(
    sql="""with p as (select row_number() over () as id, 0.05 + l_discount * 9 as x1, 0.1 + l_tax * 10 as x2 from lineitem),
c as (select * from (values (0, 2.0, 3.0, 3.0, 2.0), (1, 3.0, 2.0, 2.0, 4.0)) t(k, a1, a2, b1, b2)),
l as (select id, k, x1, x2, ln(0.5 + 1e-10) + (a1 - 1) * ln(x1) + (b1 - 1) * ln(1 - x1) - (lgamma(a1) + lgamma(b1) - lgamma(a1 + b1))
 + (a2 - 1) * ln(x2) + (b2 - 1) * ln(1 - x2) - (lgamma(a2) + lgamma(b2) - lgamma(a2 + b2)) as l from p, c),
r as (select *, exp(l) / sum(exp(l)) over (partition by id) as r from l),
m as (select k, sum(r) as n, count(*) as t, sum(r * x1) / sum(r) as m1, sum(r * x2) / sum(r) as m2, sum(r * x1 * x1) / sum(r) as q1, sum(r * x2 * x2) / sum(r) as q2 from r group by k),
v as (select *, m1 * (1 - m1) / (q1 - m1 * m1) - 1 as f1, m2 * (1 - m2) / (q2 - m2 * m2) - 1 as f2 from m)
select cast(k as integer) as k, round(n / t, 5) as w, round(m1 * f1, 4) as alpha1, round(m2 * f2, 4) as alpha2, round((1 - m1) * f1, 4) as beta1, round((1 - m2) * f2, 4) as beta2 from v"""
)
def mbmm_moments(spark, sf):
    e = mixtures.MBMM(k=2, alpha=_BETA[0], beta=_BETA[1], max_iter=1).fit(items(spark, sf, "0.05 + l_discount * 9", "0.1 + l_tax * 10")).extras
    return rows(spark, [(k, round(float(e["weights"][k]), 5), *[round(float(v), 4) for n in ("alpha", "beta") for v in e[n][k]]) for k in range(2)], "k int, w double, alpha1 double, alpha2 double, beta1 double, beta2 double")


@query(
    sql="""with p as (select row_number() over () as id, 0.05 + l_discount * 9 as x1, 0.1 + l_tax * 10 as x2 from lineitem),
c as (select * from (values (0, 2.0, 3.0, 3.0, 2.0), (1, 3.0, 2.0, 2.0, 4.0)) t(k, a1, a2, b1, b2)),
l as (select id, k, ln(0.5 + 1e-10) + (a1 - 1) * ln(x1) + (b1 - 1) * ln(1 - x1) - (lgamma(a1) + lgamma(b1) - lgamma(a1 + b1))
 + (a2 - 1) * ln(x2) + (b2 - 1) * ln(1 - x2) - (lgamma(a2) + lgamma(b2) - lgamma(a2 + b2)) as l from p, c),
r as (select *, exp(l) / sum(exp(l)) over (partition by id) as r from l) select cast(k as integer) as k, round(sum(r), 4) as n, round(sum(r * r), 4) as n2, round(max(r), 6) as top from r group by k"""
)
def mbmm_estep(spark, sf):
    m = mixtures.MBMM(k=2, alpha=_BETA[0], beta=_BETA[1], max_iter=1).fit(items(spark, sf, "0.05 + l_discount * 9", "0.1 + l_tax * 10"))
    u = F.col("u")
    return m.memberships.groupBy("k").agg(F.round(F.sum(u), 4).alias("n"), F.round(F.sum(u * u), 4).alias("n2"), F.round(F.max(u), 6).alias("top"))


# points against points ----------------------------------------------------------------------------------------------

_PAIRS = f"with p as (select vec_id as id, {cols(4, 'embedding[#]::double as x#')} from embeddings), q as (select a.id, b.id as other, {cols(4, '(a.x# - b.x#) * (a.x# - b.x#)', ' + ')} as d2 from p a, p b)"


def _all(spark, sf, d: int = 4):
    p = Points(embedded(spark, sf, d))
    ids, x, _ = p.all(pairwise.QUADRATIC, "this query")
    return spark, ids, x


def _numbered(spark, ids, values, name: str, kind: str = "double") -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, name: values}), f"vec_id bigint, {name} {kind}")


@query(
    sql=_PAIRS + """, k as (select * from (values (0), (1)) t(k)), b as (select id, k, ((id * (k + 3)) % 97 + 1) / 9700.0 as b from p, k),
u0 as (select *, exp(10 * b) / sum(exp(10 * b)) over (partition by id) as u from b), g as (select q.id, k, sum(exp(-d2) * u) as g from q join u0 on u0.id = q.other group by 1, 2),
v as (select u0.k, sqrt(1 + 2 * 0.05 * sum(u * b) + 0.05 * 0.05 * sum(g * u)) as v from u0 join g using (id, k) group by u0.k),
n as (select u0.id, u0.k, (b + 0.05 * g) / v as b from u0 join g using (id, k) join v on v.k = u0.k),
r as (select *, exp(10 * (b - max(b) over (partition by id))) as w from n) select id as vec_id, cast(k as integer) as k, round(w / sum(w) over (partition by id), 6) as u from r"""
)
def kfccl_step(spark, sf):
    """Memberships in the second step from fixed products with the prototypes."""
    p = Points(embedded(spark, sf, 4))
    ids = p.all(pairwise.QUADRATIC, "KFCCL")[0][:, None]
    start = ((ids * (np.arange(2)[None, :] + 3)) % 97 + 1) / 9700
    return memberships(pairwise.KFCCL(k=2, init=start, max_iter=2, epsilon=-1.0).fit(p))


@query(sql=_PAIRS + ", n as (select id, row_number() over (partition by id order by d2, other) as r, other from q) select id as vec_id, count(distinct other)::double as degree from (select id, other from n where r <= 5 union all select id, id from n) group by id")
def afcm_knn_degree(spark, sf):
    p = Points(embedded(spark, sf, 4))
    m = pairwise.AFCM(k=3, max_iter=1).fit(p)
    return _numbered(spark, p.all(pairwise.DENSE, "AFCM")[0], m.extras["degree"], "degree")


@query(sql=_PAIRS + ", s as (select vec_id as id, case when vec_id % 5 = 0 then if(label % 2 = 0, 1, -1) end as y from embeddings) select id as vec_id, coalesce(y = 1, false)::double as f1, coalesce(y = -1, false)::double as f2 from s")
def softksc_system(spark, sf):
    """What the fitted coefficients give back through the kernel matrix and its ridge: the labels."""
    p = Points(half_labelled(spark, sf, "case when vec_id % 5 = 0 then if(label % 2 = 0, 1, -1) end", 4), ("label",))
    ids, x, _ = p.all(pairwise.DENSE, "SoftKSC")
    coef = pairwise.SoftKSC().fit(p).extras["coefficients"]
    back = np.round(pairwise.pair_map(spark, x, lambda a, b, _: np.exp(-sqdist(a, b)) @ coef) + coef, 6) + 0.0
    return spark.createDataFrame(pd.DataFrame({"vec_id": ids, "f1": back[:, 0], "f2": back[:, 1]}), "vec_id bigint, f1 double, f2 double")


_SCALED = f"""with p as (select vec_id as id, {cols(4, 'embedding[#]::double as x#')} from embeddings),
z as (select id, {cols(4, '(x# - min(x#) over ()) / (max(x#) over () - min(x#) over ()) as x#')} from p),
t as (select a.id, sum(exp(-16 * ({cols(4, '(a.x# - b.x#) * (a.x# - b.x#)', ' + ')}))) as pot from z a, z b group by a.id)"""


@query(sql=_SCALED + " select id as vec_id, round(pot, 6) as pot from t")
def scm_potential(spark, sf):
    p = Points(embedded(spark, sf, 4))
    m = pairwise.SCM().fit(p)
    return _numbered(spark, p.all(pairwise.QUADRATIC, "SCM")[0], np.round(m.extras["potentials"], 6), "pot")


@query(sql=_SCALED + f" select {cols(4, 'round(x#, 6) + 0.0 as c#')} from t join p using (id) order by pot desc, id limit 1")
def scm_first_center(spark, sf):
    return centre_rows(spark, pairwise.SCM().fit(embedded(spark, sf, 4)).centers[:1]).drop("k")


@query(sql=_PAIRS + ", r as (select *, row_number() over (partition by id order by d2, other) as r from q where id <> other) select id as vec_id, other, cast(r as integer) as rank from r where r <= 5")
def knn_graph(spark, sf):
    _, ids, x = _all(spark, sf)
    nn = pairwise.nearest(spark, x, 5)
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.repeat(ids, 5), "other": ids[nn.ravel()], "rank": np.tile(np.arange(1, 6), len(ids))}), "vec_id bigint, other bigint, rank int")


@query(sql=_PAIRS + ", c as (select id, count(*) as n from q where d2 <= 0.01 group by id) select p.id as vec_id, coalesce(n, 0) >= 5 as is_core from p left join c using (id)")
def dbscan_core(spark, sf):
    _, ids, x = _all(spark, sf)
    return _numbered(spark, ids, pairwise.core_points(spark, x, 0.1, 5), "is_core", "boolean")


@query(
    sql=_PAIRS.replace("with p as", "with recursive p as") + """, e as materialized (select id, other from q where d2 <= 0.01), core as materialized (select id from e group by id having count(*) >= 5),
l as materialized (select e.id, e.other from e join core a on a.id = e.id join core b on b.id = e.other),
r as (select id, id as root from core union select l.other, r.root from r join l on l.id = r.id), c as (select id, min(root) as root from r group by id),
n as (select root, row_number() over (order by root) - 1 as k from (select distinct root from c)),
b as (select e.id, min(n.k) as k from e join c on c.id = e.other join n using (root) group by e.id)
select p.id as vec_id, cast(coalesce(k, -1) as integer) as label from p left join b using (id)"""
)
def softdbscan_labels(spark, sf):
    """The clusters of DBSCAN that the operator starts from, with the clusters numbered by their first core point."""
    p = Points(embedded(spark, sf, 4))
    m = pairwise.SoftDBSCANGM(eps=0.1, max_iter=1).fit(p)
    return _numbered(spark, p.all(pairwise.QUADRATIC, "SoftDBSCANGM")[0], m.extras["dbscan"].astype(int), "label", "int")


@query(
    sql=_PAIRS + """, g as (select max(sqrt(d2)) as top from q), m as (select id, j, exp(case when id % 4 = j then 1.0 else 0.0 end) as e from p, (values (0), (1), (2), (3)) t(j)),
s as (select id, j, e / sum(e) over (partition by id) as s from m), w as (select id, sum(s) filter (j < 3) as t, list(s order by j) as l from s group by id),
k as (select sqrt(d2) / top as delta, a.t * b.t - (a.l[1] * b.l[1] + a.l[2] * b.l[2] + a.l[3] * b.l[3]) as kappa from q, g, w a, w b where q.id = a.id and q.other = b.id and q.id <> q.other)
select round(sum((kappa - delta) * (kappa - delta)) / sum(delta * delta), 6) as stress from k"""
)
def evclus_stress(spark, sf):
    p = Points(embedded(spark, sf, 4))
    ids = p.all(pairwise.DENSE, "EVCLUS")[0]
    m = pairwise.EVCLUS(k=3, max_iter=0, init=(ids[:, None] % 4 == np.arange(4)[None, :]).astype(float)).fit(p)
    return rows(spark, [(round(m.extras["stress"], 6),)], "stress double")


# images and clients -------------------------------------------------------------------------------------------------

_PIXELS = """with g as (select r, c from generate_series(0, 6) a(r), generate_series(0, 23) b(c)),
e as (select dayofweek(ts) as r, hour(ts) as c, count(*) as n from events group by 1, 2),
x as (select g.r, g.c, coalesce(n, 0)::double as v from g left join e on g.r = e.r and g.c = e.c)"""


def pixels(spark, sf) -> DataFrame:
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("col"))
    n = table(spark, sf, "events").groupBy((F.dayofweek("ts") - 1).alias("row"), F.hour("ts").alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


@query(
    sql=_PIXELS + """, s as (select x.r, x.c, dr, dc from x, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc)),
m as (select s.r, s.c, x.v from s join x on x.r = least(greatest(s.r + dr, 0), 6) and x.c = least(greatest(s.c + dc, 0), 23))
select cast(r as integer) as "row", cast(c as integer) as col, round(sum(v) / 9, 6) as value from m group by r, c"""
)
def box_filter(spark, sf):
    v, h, w = images.read_pixels(pixels(spark, sf))
    out = images.box3(v[:, 0].reshape(h, w)).ravel()
    return rows(spark, [(i // w, i % w, round(float(x), 6)) for i, x in enumerate(out)], "row int, col int, value double")


@query(sql="with f as (select distinct event_type as client, 'day' || dayofweek(ts) as feature from events) select feature from f group by feature having count(*) = (select count(distinct event_type) from events)")
def femi_common_features(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("client"), F.concat(F.lit("day"), F.dayofweek("ts") - 1).alias("feature"))
    return federated.common_features(e)


@query(sql="select event_type as client, count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high, round(stddev_pop(value), 6) as std, round(median(value), 6) as median from events group by event_type")
def femi_client_stats(spark, sf):
    """What a client tells of one of its clusters, for a cluster of all its values."""

    def told(b: pd.DataFrame) -> pd.DataFrame:
        s = federated.signature(b[["value"]].to_numpy(float), np.ones((len(b), 1)), 0)
        return pd.DataFrame([(b["client"].iloc[0], int(s[0]), *(float(v) for v in s[1:]))], columns=["client", "n", "mean", "low", "high", "std", "median"])

    e = table(spark, sf, "events").select(F.col("event_type").alias("client"), F.col("value").cast("double").alias("value")).where("value is not null")
    t = e.groupBy("client").applyInPandas(told, "client string, n bigint, mean double, low double, high double, std double, median double")
    return t.select("client", "n", F.round("mean", 6).alias("mean"), "low", "high", F.round("std", 6).alias("std"), F.round("median", 6).alias("median"))


_FIRST = """, y as (select r, c, k, ((r * 24 + c) * (k + 3)) % 7 + 1 as y from x, (values (0), (1)) t(k)), u as (select r, c, k, y::double / sum(y) over (partition by r, c) as u from y)"""


def _first_memberships() -> np.ndarray:
    i = np.arange(168)[:, None]
    y = (i * (np.arange(2)[None, :] + 3)) % 7 + 1.0
    return y / y.sum(1, keepdims=True)


def _pixel_rows(m) -> DataFrame:
    return m.memberships.select((F.col("id") / 24).cast("int").alias("row"), (F.col("id") % 24).cast("int").alias("col"), "k", F.round("u", 6).alias("u"))


@query(
    sql=_PIXELS + _FIRST + """, q as (select u.*, v, u * u as q from u join x using (r, c)), s as (select k, sum(q) as s from q group by k),
kq as (select a.r, a.c, b.k, sum(exp(-0.0001 * (a.v - b.v) * (a.v - b.v)) * b.q) as kq from x a, q b group by 1, 2, 3), z as (select kq.k, sum(q * kq) as z from kq join q using (r, c, k) group by kq.k),
o as (select u.r, u.c, dr, dc, k from u, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc)),
n as (select o.r, o.c, o.k, sum(u.u) / 9 as n from o join u on u.r = least(greatest(o.r + dr, 0), 6) and u.c = least(greatest(o.c + dc, 0), 23) and u.k = o.k group by 1, 2, 3),
w as (select kq.r, kq.c, kq.k, 1 / greatest(1 - 2 / s * kq + z / (s * s) + 0.5 * (1 - n), 1e-10) as w from kq join n using (r, c, k) join s on s.k = kq.k join z on z.k = kq.k)
select cast(r as integer) as "row", cast(c as integer) as col, cast(k as integer) as k, round(w / sum(w) over (partition by r, c), 6) as u from w"""
)
def skfcm_step(spark, sf):
    return _pixel_rows(images.SKFCM(k=2, gamma=1e-4, max_iter=1, init=_first_memberships()).fit(pixels(spark, sf)))


@query(
    sql=_PIXELS + _FIRST + """, q as (select u.*, v, u * u as q from u join x using (r, c)),
n as (select k, sum(q) + 1e-8 as n, sum(q * v * v / (1 + 1e-8)) as sq, sum(q * v / (1 + 1e-8)) as pl from q group by k), m as (select k, pl / n / (sq / n + 1e-8) as m from n),
b as (select r, c, any_value(v) as v, sum(q * (v - m) * -m) / (sum(q * m * m) + 1e-8) - 0.1 as b from q join m using (k) group by r, c),
w as (select r, c, k, 1 / greatest((v - b * m) * (v - b * m), 1e-8) as w from b, m)
select cast(r as integer) as "row", cast(c as integer) as col, cast(k as integer) as k, round(w / sum(w) over (partition by r, c), 6) as u from w"""
)
def afcmadaptive_step(spark, sf):
    return _pixel_rows(images.AFCMAdaptive(k=2, max_iter=1, init=_first_memberships()).fit(pixels(spark, sf)))


# graphs -------------------------------------------------------------------------------------------------------------

_GRAPH = """with e0 as (select l_suppkey as s, l_partkey + 10000000 as d, 1.0::double as w from lineitem),
e as (select s as src, d as dst, max(w) as w from (select s, d, w from e0 union all select d, s, w from e0) group by 1, 2),
v as (select distinct src as node from e), f as (select node, k, ((node * (k + 3)) % 97 + 1) / 200.0 as v from v, (values (0), (1)) t(k))"""


def graph(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 10_000_000).alias("dst"), F.lit(1.0).alias("w"))


def state(e: DataFrame, k: int, value: str) -> DataFrame:
    ks = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k")
    return e.select(F.col("src").alias("node")).distinct().select("node", ks).withColumn("v", F.expr(value))


FIXED = "((node * (k + 3)) % 97 + 1) / 200D"


@query(
    sql=_GRAPH + """, x as (select src, dst, sum(a.v * b.v) as x from e join f a on a.node = src join f b on b.node = dst and a.k = b.k group by 1, 2),
g as (select src as node, f.k, sum(f.v * exp(-x) / (1 - exp(-x) + 1e-10)) as g from x join f on f.node = dst group by 1, 2), t as (select k, sum(v) as t from f group by k)
select f.node, cast(f.k as integer) as k, round(greatest(f.v + 0.001 * (g - (t - f.v)), 1e-10), 6) as f from f join g using (node, k) join t using (k)"""
)
def bigclam_step(spark, sf):
    g = graphs.Graph(graph(spark, sf))
    start = ((g.ids[:, None] * (np.arange(2)[None, :] + 3)) % 97 + 1) / 200
    return graphs.BIGCLAM(k=2, max_iter=1, lr=0.001, init=start).fit(g).memberships.select(F.col("id").alias("node"), "k", F.round("u", 6).alias("f"))


@query(sql=ORACLES["bigclam_step"])
def bigclam_step_spread(spark, sf):
    """The same step as joins."""
    e = graphs.symmetric(graph(spark, sf))
    return graphs.affiliation_step(e, state(e, 2, FIXED), 0.001).select("node", "k", F.round("v", 6).alias("f"))


@query(
    sql=_GRAPH + """, h0 as (select node, k, ((node * (k + 5)) % 89 + 1) / 150.0 as v from v, (values (0), (1)) t(k)),
r0 as (select src, dst, e.w / (sum(a.v * b.v) + 1e-10) as r from e join f a on a.node = src join h0 b on b.node = dst and a.k = b.k group by src, dst, e.w),
nh as (select dst as node, f.k, sum(r * f.v) as n from r0 join f on f.node = src group by 1, 2), sw as (select k, sum(v) as s from f group by k),
h1 as (select h0.node, h0.k, h0.v * n / (s + h0.v + 1e-10) as v from h0 join nh using (node, k) join sw using (k)),
r1 as (select src, dst, e.w / (sum(a.v * b.v) + 1e-10) as r from e join f a on a.node = src join h1 b on b.node = dst and a.k = b.k group by src, dst, e.w),
nw as (select src as node, h1.k, sum(r * h1.v) as n from r1 join h1 on h1.node = dst group by 1, 2), sh as (select k, sum(v) as s from h1 group by k)
select f.node, cast(f.k as integer) as k, round(f.v * n / (s + f.v + 1e-10), 6) as w from f join nw using (node, k) join sh using (k)"""
)
def bnmf_step(spark, sf):
    g = graphs.Graph(graph(spark, sf))
    ids = g.ids[:, None]
    ks = np.arange(2)[None, :]
    m = graphs.BayesianNMF(k=2, max_iter=1, init_w=((ids * (ks + 3)) % 97 + 1) / 200, init_h=((ids * (ks + 5)) % 89 + 1) / 150).fit(g)
    return m.memberships.select(F.col("id").alias("node"), "k", F.round("u", 6).alias("w"))


_CRISP = _GRAPH + """, c as (select node, node % 3 as k from v), m as (select sum(w) as m from e), deg as (select src as node, sum(w) as deg from e group by 1),
a as (select coalesce(sum(w), 0) as a from e join c x on x.node = src join c y on y.node = dst where x.k = y.k), b as (select sum(p * p) as b from (select k, sum(deg) as p from c join deg using (node) group by k)),
q as (select (a - b / m) / m as q from a, b, m)"""


@query(sql=_CRISP + " select round(q, 6) as q from q")
def graph_modularity(spark, sf):
    e = graphs.symmetric(graph(spark, sf))
    crisp = e.select(F.col("src").alias("node")).distinct().select("node", (F.col("node") % 3).cast("int").alias("k"), F.lit(1.0).alias("v"))
    return graphs.modularity(e, crisp).select(F.round("q", 6).alias("q"))


@query(sql=_CRISP + ", n as (select count(*) as n from c), z as (select sqrt(sum(s * s)) as z from (select k, count(*)::double as s from c group by k)) select round(-q + sqrt(3) / n * z - 1, 6) as loss from q, n, z")
def dmon_loss(spark, sf):
    g = graphs.Graph(graph(spark, sf))
    return rows(spark, [(round(graphs.DMoN(k=3).loss(g, np.eye(3)[g.ids % 3])[0], 6),)], "loss double")


@query(sql=_GRAPH + ", d as (select src as node, count(*) + 1.0 as d from e group by 1) select src, dst, round(1 / sqrt(a.d * b.d) + 1e-9, 6) as w from e join d a on a.node = src join d b on b.node = dst")
def nocd_adj_norm(spark, sf):
    return graphs.normalised_edges(graphs.Graph(graph(spark, sf))).select("src", "dst", F.round(F.col("w") + 1e-9, 6).alias("w"))


@query(sql=_CRISP + " select round(-q, 6) as loss from q")
def cdcgs_value(spark, sf):
    """What the operator makes least, for crisp memberships."""
    g = graphs.Graph(graph(spark, sf))
    return rows(spark, [(round(graphs.CDCGS(k=3).value(g, np.eye(3)[g.ids % 3])[0], 6),)], "loss double")


_BLOCKS = """with e0 as (select distinct l_suppkey as s, 10000000 + cast(substr(p_brand, 7) as bigint) as d from lineitem join part on l_partkey = p_partkey),
e as materialized (select s as src, d as dst from e0 union select d, s from e0), v as materialized (select distinct src as node from e), b as (select range as b from range(3)),
f as materialized (select node, b, 0.1 / 3 + case when node % 3 = b then 0.9 else 0.0 end as f from v, b),
t as (select b, sum(f) as t from f group by b), same as (select x.b as g, y.b as h, sum(x.f * y.f) as s from f x join f y using (node) group by 1, 2),
m as (select x.b as g, y.b as h, sum(x.f * y.f) as m from e join f x on x.node = src join f y on y.node = dst group by 1, 2),
bm as materialized (select g, h, least(greatest(m / (x.t * y.t - s + 1e-10), 1e-10), 1 - 1e-10) as p from m join same using (g, h) join t x on x.b = g join t y on y.b = h)"""


def block_graph(spark, sf) -> DataFrame:
    """Suppliers and the brands of the parts they ship, as numbers."""
    li, part = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("src"), (F.lit(10_000_000) + F.expr("cast(substr(p_brand, 7) as bigint)")).alias("dst")).distinct()


@query(sql=_BLOCKS + " select cast(g as integer) as g, cast(h as integer) as h, round(p, 6) as p from bm")
def mmsb_block_matrix(spark, sf):
    e = graphs.Graph(block_graph(spark, sf))
    b = graphs.MMSB(k=3, init=e.ids % 3, max_iter=0).fit(e).extras["block_matrix"]
    return rows(spark, [(g, h, round(float(b[g, h]), 6)) for g in range(3) for h in range(3)], "g int, h int, p double")


def _psi(x: str) -> str:
    """SQL of the digamma function for arguments of at least 0.5, from its asymptotic series at six more."""
    y, down = f"({x} + 6)", " + ".join(f"1 / ({x} + {i})" for i in range(6))
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * {y} ^ 2) + 1 / (120 * {y} ^ 4) - 1 / (252 * {y} ^ 6) - ({down}))"


@query(
    sql=_BLOCKS + f""", c as (select count(*) as n from v), a as (select node, b, 0.5 + 2 * (n - 1) * f as a from f, c), el as materialized (select node, b, {_psi("a")} - {_psi("s")} as el from (select *, sum(a) over (partition by node) as s from a)),
q as materialized (select x.node as src, y.node as dst, e.src is not null as y from v x join v y on x.node <> y.node left join e on e.src = x.node and e.dst = y.node),
o1 as (select q.src, q.dst, y, g, any_value(el.el) + sum(f.f * case when y then ln(p) else ln(1 - p) end) as l from q join f on f.node = q.dst join bm on bm.h = f.b join el on el.node = q.src and el.b = bm.g group by q.src, q.dst, y, g),
o2 as (select *, exp(l - max(l) over (partition by src, dst)) as w from o1), o as materialized (select src, dst, y, g, w / sum(w) over (partition by src, dst) as o from o2),
i1 as (select o.src, o.dst, h, any_value(el.el) + sum(o * case when y then ln(p) else ln(1 - p) end) as l from o join bm on bm.g = o.g join el on el.node = o.dst and el.b = bm.h group by o.src, o.dst, h),
i2 as (select *, exp(l - max(l) over (partition by src, dst)) as w from i1), i as (select src, dst, h, w / sum(w) over (partition by src, dst) as i from i2),
g as (select node, b, 0.5 + sum(x) as g from (select src as node, g as b, o as x from o union all select dst, h, i from i) group by 1, 2)
select node, cast(b as integer) as k, round(g / sum(g) over (partition by node), 6) as u from g"""
)
def mmsb_sweep(spark, sf):
    """Memberships after one sweep over all pairs."""
    e = graphs.Graph(block_graph(spark, sf))
    m = graphs.MMSB(k=3, init=e.ids % 3, max_iter=1, n_inner=1).fit(e)
    return m.memberships.select(F.col("id").alias("node"), "k", F.round("u", 6).alias("u"))


@query(
    sql=_GRAPH + """, n as (select count(*)::double as n from v), x as (select src, dst, sum(a.v * b.v) as x from e join f a on a.node = src join f b on b.node = dst and a.k = b.k group by 1, 2),
p as (select sum(-ln(1 - exp(-(-ln(1 - 1 / n)) - x))) as edge, count(*) as m, sum(x) as sx from x, n), t as (select sum(s * s) as s2 from (select sum(v) as s from f group by k)), q as (select sum(v * v) as q from f)
select round((edge / m + (s2 - q - sx) / (n * n - n - m)) / 2, 6) as loss from p, t, q, n"""
)
def nocd_berpo_full(spark, sf):
    g = graphs.Graph(graph(spark, sf))
    z = ((g.ids[:, None] * (np.arange(2)[None, :] + 3)) % 97 + 1) / 200
    return rows(spark, [(round(graphs.berpo(g, z), 6),)], "loss double")


# documents ----------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in documents.STOP_WORDS)


def tf_sql(stop: bool, of: str = "documents", key: str = "doc_id") -> str:
    return f"""with w as (select {key} as doc_id, unnest(string_split_regex(lower(text), '\\s+')) as term from {of}),
tf as (select doc_id, term, count(*) as cnt from w where term <> ''{f" and term not in ({_STOP})" if stop else ""} group by 1, 2)"""


def eval_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "eval_items").select(F.col("item_id").alias("doc_id"), "text")


@query(sql=tf_sql(True) + " select doc_id, term, cnt from tf")
def doc_term_counts(spark, sf):
    return documents.term_counts(table(spark, sf, "documents"), "space", documents.STOP_WORDS)


@query(sql=tf_sql(True) + " select term, count(*) as df, cast(sum(cnt) as bigint) as cnt from tf group by term")
def doc_vocab(spark, sf):
    return documents.vocabulary(documents.term_counts(table(spark, sf, "documents"), "space", documents.STOP_WORDS))


@query(
    sql=tf_sql(True) + """, p as (select row_number() over (order by doc_id) - 1 as proto, doc_id as pd from (select distinct doc_id from tf order by 1 limit 3)), n as (select doc_id, sum(cnt)::double as n from tf group by 1),
m as (select tf.doc_id, proto, sum(least(tf.cnt, q.cnt))::double as s from p join tf q on q.doc_id = pd join tf on tf.term = q.term group by 1, 2)
select n.doc_id, cast(p.proto as integer) as proto, round(coalesce(s, 0) / (n + 1e-9), 6) as score, coalesce(s, 0) / (n + 1e-9) >= 0.5 as passed from n cross join p left join m on m.doc_id = n.doc_id and m.proto = p.proto"""
)
def kmart_scores(spark, sf):
    tf = documents.term_counts(table(spark, sf, "documents"), "space", documents.STOP_WORDS)
    first = [r[0] for r in tf.select("doc_id").distinct().orderBy("doc_id").limit(3).collect()]
    number = F.expr("case " + " ".join(f"when doc_id = {d} then {i}" for i, d in enumerate(first)) + " end").cast("int")
    protos = tf.where(F.col("doc_id").isin(first)).select(number.alias("proto"), "term", F.col("cnt").alias("w"))
    score = F.col("score")
    return documents.overlap_scores(tf, protos).select("doc_id", "proto", F.round(score, 6).alias("score"), (score >= 0.5).alias("passed"))


@query(sql=tf_sql(True) + ", a as (select term, cast(sum(cnt) as bigint) as n from tf group by term), r as (select *, row_number() over (order by n desc, encode(term)) as r from a) select cast(r as integer) as rank, term from r where r <= 10")
def kmart_keywords(spark, sf):
    """Keywords of the one cluster there is without vigilance: all documents."""
    m = documents.KMART(vigilance=0.0).fit(table(spark, sf, "documents").select("doc_id", "text"))
    assert m.n_clusters == 1
    return rows(spark, [(i + 1, w) for i, w in enumerate(m.extras["keywords"][0])], "rank int, term string")


@query(sql="select doc_id, cast(row_number() over (order by doc_id) - 1 as integer) as k, 1.0::double as u from (select distinct doc_id from documents)")
def kmart_alone(spark, sf):
    """With a vigilance that nothing meets each document is a cluster of its own."""
    m = documents.KMART(vigilance=1.5).fit(table(spark, sf, "documents").select("doc_id", "text"))
    return m.memberships.select(F.col("id").alias("doc_id"), "k", "u")


@query(
    sql=tf_sql(True, "eval_items", "item_id") + """, n as (select doc_id, count(*) as n from tf group by 1), s as (select doc_id as seed, n as sn from n order by 1 limit 3),
b as (select tf.doc_id, seed, count(*) as b from s join tf q on q.doc_id = seed join tf on tf.term = q.term group by 1, 2)
select n.doc_id, seed, round(coalesce(b, 0) / (n + sn - coalesce(b, 0)), 6) as sim from n cross join s left join b using (doc_id, seed)"""
)
def sisc_tanimoto(spark, sf):
    """Every item against the seeds."""
    tf = documents.term_counts(eval_docs(spark, sf), "space", documents.STOP_WORDS)
    seeds = tf.select(F.col("doc_id").alias("seed")).distinct().orderBy("seed").limit(3)
    return documents.tanimoto_to(tf, seeds).withColumn("sim", F.round("sim", 6))


_SISC_FIRST = float(uniform(np.array([0]), 1, 0)[0, 0])


@query(
    sql=tf_sql(True, "eval_items", "item_id") + f""", d as (select doc_id, row_number() over (order by doc_id) - 1 as r from (select distinct item_id as doc_id from eval_items)), c as (select count(*) as c from d),
n as (select doc_id, count(*) as n from tf group by 1), s1 as (select doc_id from d, c where r = cast(floor({_SISC_FIRST!r} * c) as bigint)),
a1 as (select d.doc_id, d.r, coalesce(b / (n.n + m.n - b), 0)::double as sim from d left join (select tf.doc_id, count(*) as b from tf join tf q on q.term = tf.term and q.doc_id = (select doc_id from s1) group by 1) t using (doc_id) left join n using (doc_id) left join n m on m.doc_id = (select doc_id from s1)),
s2 as (select doc_id from a1 where doc_id <> (select doc_id from s1) order by sim desc, r limit 1),
a2 as (select d.doc_id, coalesce(b / (n.n + m.n - b), 0)::double as sim from d left join (select tf.doc_id, count(*) as b from tf join tf q on q.term = tf.term and q.doc_id = (select doc_id from s2) group by 1) t using (doc_id) left join n using (doc_id) left join n m on m.doc_id = (select doc_id from s2)),
a as (select sim, row_number() over (order by sim desc) - 1 as r from (select sim from a1 union all select sim from a2)) select round(sim, 6) as lambda from a, c where r = c // 2"""
)
def sisc_lambda(spark, sf):
    """The threshold that the operator takes from the similarities to its seeds."""
    m = documents.SISC(k=1, max_iter=1).fit(eval_docs(spark, sf))
    return rows(spark, [(round(m.extras["threshold"], 6),)], "lambda double")


@query(sql=tf_sql(False) + ", n as (select count(distinct doc_id) as n from documents) select term, count(*) as df from tf group by term having count(*) >= 2 and count(*) <= (select cast(floor(n * 0.5) as bigint) from n)")
def wbsc_index(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.select("doc_id").distinct().count()
    return documents.word_index(documents.term_counts(docs, "space"), n, 2, 0.5).select("term", "df")


@query(
    sql=tf_sql(False) + """, z as (select * from (values (0), (1)) t(z)), pd as (select doc_id, z, (1 + (doc_id * (z + 1)) % 7) / 7.0 as p from (select distinct doc_id from tf), z),
pw as (select term, z, (1 + (length(term) * (z + 2)) % 5) / 5.0 as p from (select distinct term from tf), z),
y as (select tf.doc_id, tf.term, cnt, pd.z, 0.5 * pd.p * pw.p as w from tf join pd using (doc_id) join pw on pw.term = tf.term and pw.z = pd.z), r as (select *, w / sum(w) over (partition by doc_id, term) as r from y),
s as (select z, sum(cnt * r) as s from r group by z) select cast(r.z as integer) as z, term, round(sum(cnt * r) / any_value(s) * 1000, 6) as p from r join s using (z) group by r.z, term"""
)
def plsi_em_step(spark, sf):
    """P(word | topic) in thousandths after one step from fixed probabilities."""
    tf = documents.term_counts(table(spark, sf, "documents"), "space")
    z = F.explode(F.array(F.lit(0), F.lit(1))).alias("z")
    pz = spark.createDataFrame([(0, 0.5), (1, 0.5)], "z int, p double")
    pd_ = tf.select("doc_id").distinct().select("doc_id", z).withColumn("p", F.expr("(1 + (doc_id * (z + 1)) % 7) / 7D"))
    pw = tf.select("term").distinct().select("term", z).withColumn("p", F.expr("(1 + (length(term) * (z + 2)) % 5) / 5D"))
    post = documents.plsi_step(tf, pz, pd_, pw)
    s = F.broadcast(post.groupBy("z").agg(F.sum(F.col("cnt") * F.col("p")).alias("s")))
    return post.groupBy("z", "term").agg(F.sum(F.col("cnt") * F.col("p")).alias("n")).join(s, "z").select("z", "term", F.round(F.col("n") / F.col("s") * 1000, 6).alias("p"))


def _plsi_start(terms, ids):
    w = np.array([[(1 + (len(t) * (z + 2)) % 5) / 5 for t in terms] for z in (0, 1)])
    d = (1 + (ids[None, :] * np.array([[1], [2]])) % 7) / 7.0
    return w, d


@query(
    sql=tf_sql(False).replace("string_split_regex(lower(text), '\\s+')", "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')") + """, z as (select * from (values (0), (1)) t(z)), pd as (select doc_id, z, (1 + (doc_id * (z + 1)) % 7) / 7.0 as p from (select distinct doc_id from tf), z),
pw as (select term, z, (1 + (length(term) * (z + 2)) % 5) / 5.0 as p from (select distinct term from tf), z),
y as (select tf.doc_id, tf.term, cnt, pd.z, 0.5 * pd.p * pw.p as w from tf join pd using (doc_id) join pw on pw.term = tf.term and pw.z = pd.z), r as materialized (select *, cnt * w / sum(w) over (partition by doc_id, term) as r from y),
d as (select doc_id, z, sum(r) as n from r group by 1, 2) select doc_id, cast(z as integer) as k, round(n / sum(n) over (partition by doc_id) + 1e-9, 6) as u from d"""
)
def plsi_memberships(spark, sf):
    """Shares of topics after one step of the operator from fixed probabilities."""
    m = documents.PLSI(k=2, max_iter=1, tempered=False, init=_plsi_start).fit(term_table(spark, sf))
    return m.memberships.select(F.col("id").alias("doc_id"), "k", F.round(F.col("u") + 1e-9, 6).alias("u"))


def term_table(spark, sf) -> DataFrame:
    """Counts of runs of two and more letters and digits."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}\\p{N}_]{2,}"), 0)).alias("term")
    return table(spark, sf, "documents").select("doc_id", words).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    sql=tf_sql(False).replace("string_split_regex(lower(text), '\\s+')", "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')") + f""", z as (select * from (values (0), (1)) t(z)), v as (select distinct term from tf),
lam as materialized (select term, z, (1 + (length(term) * (z + 2)) % 5) / 2.0 as l from v, z), tot as (select z, sum(l) as s from lam group by z), n as (select doc_id, sum(cnt) as n from tf group by 1),
g0 as (select doc_id, z, 25 + n / 2.0 as g from n, z), lw as (select term, lam.z, exp({_psi("l")} - {_psi("s")}) as w from lam join tot using (z)), e as (select doc_id, z, exp({_psi("g")}) as e from g0),
y as (select tf.doc_id, term, cnt, lw.z, e * lw.w as y from tf join lw using (term) join e on e.doc_id = tf.doc_id and e.z = lw.z), phi as (select *, y / sum(y) over (partition by doc_id, term) as phi from y),
g as (select doc_id, z, 25 + sum(cnt * phi) as g from phi group by 1, 2) select doc_id, cast(z as integer) as k, round(g / sum(g) over (partition by doc_id), 6) as u from g"""
)
def lda_memberships(spark, sf):
    """Shares of topics after one inner step of the operator from fixed topics."""
    m = documents.LDA(k=2, max_iter=1, var_max_iter=1, init=lambda terms: [[(1 + (len(t) * (z + 2)) % 5) / 2 for t in terms] for z in (0, 1)]).fit(term_table(spark, sf))
    return m.memberships.select(F.col("id").alias("doc_id"), "k", F.round("u", 6).alias("u"))


# ensembles ----------------------------------------------------------------------------------------------------------

_ENSEMBLE = f"""with p as (select vec_id as id, {cols(4, "embedding[#]::double as x#")} from embeddings), r as (select *, row_number() over (order by id) - 1 as r from p),
c0 as (select r as k, {cols(4, "x# as c#")} from r where r < 3), c1 as (select r - 3 as k, {cols(4, "x# as c#")} from r where r >= 3 and r < 6),
{dist(4, 0)}, {share(0, INV)}, {dist(4, 1)}, {share(1, INV)}, m as (select id, k as col, u from u0 union all select id, k + 3, u from u1)"""


def ensemble(spark, sf) -> DataFrame:
    p, c = points(spark, sf, 4, 6)
    runs = [prototypes.FCM(k=3, init=x, max_iter=1).fit(p).memberships.select(F.lit(i).alias("run"), "id", "k", "u") for i, x in enumerate((c[:3], c[3:]))]
    return runs[0].unionByName(runs[1])


def _stack(spark, sf, norm):
    return consensus.stacked(ensemble(spark, sf), norm).select(F.col("id").alias("vec_id"), F.posexplode("features").alias("col", "v")).withColumn("v", F.round("v", 6))


@query(sql=_ENSEMBLE + " select id as vec_id, cast(col as integer) as col, round(u / (sqrt(sum(u * u) over (partition by id)) + 1e-8), 6) as v from m")
def scspa_rows(spark, sf):
    return _stack(spark, sf, "l2")


@query(sql=_ENSEMBLE + " select id as vec_id, cast(col as integer) as col, round(u / (sum(u) over (partition by id) + 1e-8), 6) as v from m")
def shbgf_rows(spark, sf):
    return _stack(spark, sf, "l1")


@query(sql=_ENSEMBLE + " select cast(x.col as integer) as a, cast(y.col as integer) as b, round(sum(x.u * y.u), 6) as dot from m x join m y using (id) group by 1, 2")
def smcla_gram(spark, sf):
    return consensus.gram(ensemble(spark, sf)).withColumn("dot", F.round("dot", 6))


# indices ------------------------------------------------------------------------------------------------------------


def _fitted(spark, sf, d: int = 4):
    p, c = points(spark, sf, d)
    return embedded(spark, sf, d), prototypes.FCM(k=3, init=c, max_iter=1).fit(p), c


def _centres(spark, c):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "k int, c array<double>")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) for c in df.columns])


@query(
    sql=f"{base()}, {share(0, INV)}, r as (select id, sum(u * u) as q, sum(-u * ln(u + 1e-12)) as e from u0 group by id), a as (select avg(q) as pc, avg(e) as pe from r) "
    "select round(pc, 6) as partition_coefficient, round(pe, 6) as partition_entropy, round((pc - 1 / 3.0) / (1 - 1 / 3.0), 6) as modified_partition_coefficient from a"
)
def metric_pc_mpc_pe(spark, sf):
    return rounded(metrics.partition_indices(_fitted(spark, sf)[1].memberships))


@query(
    sql=f"{base()}, {share(0, INV)}, s as (select {cols(4, '(a.c# - b.c#) * (a.c# - b.c#)', ' + ')} as d2 from c0 a join c0 b on a.k < b.k), t as (select sum(u * u * d2) as comp, count(distinct id) as n from u0) "
    "select round(comp / (n * (select min(d2) from s where d2 > 0)), 6) as xie_beni_index, round((select avg(sqrt(d2)) from s), 6) as fuzzy_separation_index, round(comp, 6) as fuzzy_compactness from t"
)
def metric_xb_sep_comp(spark, sf):
    df, m, c = _fitted(spark, sf)
    return rounded(metrics.prototype_indices(df, m.memberships, _centres(spark, c)))


@query(sql=f"{base(2)}, {share(0, INV)}, s as (select k, {_COV2.replace(' + 1e-6', '')} from (select * exclude (w), u * u as w from u0) group by k) select round(sum(sqrt(greatest(a * e - b * b, 0))), 6) as fuzzy_hypervolume from s")
def metric_fhv_2d(spark, sf):
    df, m, c = _fitted(spark, sf, 2)
    return rows(spark, [(round(metrics.fuzzy_hypervolume(df, m.memberships, _centres(spark, c)), 6),)], "fuzzy_hypervolume double")


_LABELS = f"{base()}, o as (select *, row_number() over (partition by id order by d2, k) as r from d0), l as (select id, k as label, {cols(4, 'x#')} from o where r = 1)"


def _labels(spark, sf) -> DataFrame:
    return _fitted(spark, sf)[1].labels()


@query(
    sql=_LABELS + """, t as (select l.label as x, e.label as y, count(*)::double as n from l join embeddings e on e.vec_id = l.id group by 1, 2), n as (select sum(n) as nn from t),
a as (select x, sum(n) as nx from t group by x), b as (select y, sum(n) as ny from t group by y), s as (select (select sum(n * (n - 1) / 2) from t) as sxy, (select sum(nx * (nx - 1) / 2) from a) as sx, (select sum(ny * (ny - 1) / 2) from b) as sy, nn from n),
h as (select -(select sum(nx / nn * ln(nx / nn)) from a, n) as hx, -(select sum(ny / nn * ln(ny / nn)) from b, n) as hy, (select sum(t.n / nn * ln(t.n * nn / (nx * ny))) from t join a using (x) join b using (y), n) as mi)
select round((sxy - sx * sy / (nn * (nn - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (nn * (nn - 1) / 2)), 6) as ari, round(mi / ((hx + hy) / 2), 6) as nmi from s, h"""
)
def metric_ari_nmi(spark, sf):
    truth = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rounded(metrics.agreement(_labels(spark, sf), truth))


@query(
    sql=_LABELS + f""", m as (select label, {cols(4, "avg(x#) as m#")}, count(*) as n from l group by label), g as (select {cols(4, "avg(x#) as g#")} from l),
w as (select label, sum({cols(4, "(x# - m#) * (x# - m#)", " + ")}) as w, avg(sqrt({cols(4, "(x# - m#) * (x# - m#)", " + ")})) as s from l join m using (label) group by label),
b as (select sum(n * ({cols(4, "(m# - g#) * (m# - g#)", " + ")})) as b, count(*) as k, sum(n) as n from m, g),
r as (select a.label, max((wa.s + wb.s) / sqrt({cols(4, "(a.m# - c.m#) * (a.m# - c.m#)", " + ")})) as r from m a join m c on a.label <> c.label join w wa on wa.label = a.label join w wb on wb.label = c.label group by 1)
select round(b / (k - 1) / ((select sum(w) from w) / (n - k)), 6) as calinski_harabasz, round((select avg(r) from r), 6) as davies_bouldin from b"""
)
def metric_ch_db(spark, sf):
    return rounded(metrics.calinski_davies(embedded(spark, sf, 4), _labels(spark, sf)))


@query(
    sql=_LABELS + f""", q as (select a.id, a.label as la, b.label as lb, sqrt({cols(4, "(a.x# - b.x#) * (a.x# - b.x#)", " + ")}) as d from l a, l b where a.id <> b.id), m as (select id, la, lb, avg(d) as d from q group by 1, 2, 3),
s as (select id, min(d) filter (la = lb) as own, min(d) filter (la <> lb) as other from m group by id) select round(avg(coalesce((other - own) / greatest(own, other), 0)), 6) as silhouette from s"""
)
def metric_silhouette(spark, sf):
    return rows(spark, [(round(metrics.silhouette(embedded(spark, sf, 4), _labels(spark, sf)), 6),)], "silhouette double")


# the same over partitions -------------------------------------------------------------------------------------------

SPREAD = (
    "fcm_memberships", "fcm_centers_3it", "fcm_centers_25it", "fcm_objective", "afcmsimple_step", "cafcm_level", "cafhfcm_step", "entropyfcm_objective", "pcm_typicality", "pfcm_step", "ecm_pignistic",
    "ecm_centers_10it", "kfcm_step", "fcc_step", "rough_kmeans_approx", "rpfkm_memberships", "sfcmep_update", "gk_step", "gathgeva_step", "gmm_diag_em", "gmm_spherical_em", "gmm_full_2d", "gmm_diag_8it",
    "lloyd_3it", "bgmm_moments", "mbmm_moments", "mbmm_estep", "kmeanspp_first2", "scm_potential", "kfccl_step", "knn_graph", "softdbscan_labels", "mmsb_sweep", "lda_memberships", "scspa_rows", "smcla_gram", "metric_silhouette",
)


def _spread(name: str):
    def run(spark, sf):
        with spread():
            return QUERIES[name](spark, sf)

    run.__name__ = f"{name}_spread"
    run.__doc__ = f"{name} with points, pairs and documents in partitions, as tables are that are too large for the driver."
    return run


for _name in SPREAD:
    query(_spread(_name), ORACLES[_name])


# whole fits, one for each operator ----------------------------------------------------------------------------------


def brands(spark, sf) -> DataFrame:
    """Suppliers and the brands of the parts they ship."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.xxhash64("p_brand").alias("dst"))
    return li.join(part, "l_partkey").groupBy(F.col("l_suppkey").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def brand_nodes(spark, sf) -> DataFrame:
    e = graphs.symmetric(brands(spark, sf))
    deg = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d"), F.avg("w").alias("w"))
    return deg.select("id", F.array(F.log1p("d"), F.col("w"), F.lit(1.0)).alias("features"))


def half_labelled(spark, sf, expr: str, d: int = 8) -> DataFrame:
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.expr(expr).cast("int").alias("label"))
    return embedded(spark, sf, d).join(t, "id")


def clients(spark, sf) -> DataFrame:
    """Users' means per kind of event as features; a client holds the users of one region, in parts of equal share if they are more than a client may have."""
    region = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("region"))
    e = table(spark, sf, "events").where("user_id is not null").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("feature")).agg(F.avg("value").alias("value"))
    e = e.join(region, "id", "left").withColumn("region", F.coalesce("region", F.lit(-1)))  # -1: no customers
    # shares come from a hash, so a part is planned a fifth below the bound
    parts = e.groupBy("region").agg(F.ceil(F.countDistinct("id") / (0.8 * federated.CLIENT_ROWS)).alias("parts"))
    return e.join(F.broadcast(parts), "region").select(F.format_string("%d.%d", "region", F.pmod(F.xxhash64("id"), "parts")).alias("client"), "id", "feature", "value")


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


FITS = {
    **{n: (lambda s, f: embedded(s, f, 64), {}) for n in ("FCM", "PCM", "PFCM", "CAFCM", "CAFHFCM", "AFCMSimple", "ENTROPYFCM", "ECM", "KFCM", "RoughKMeans", "RPFKM", "SCM", "KFCCL", "AFCM", "EVCLUS", "RDFKC")},
    **{n: (lambda s, f: embedded(s, f, 8), {}) for n in ("GK", "GathGeva", "GMM")},
    "FCC": (lambda s, f: embedded(s, f, 3).withColumn("features", F.transform("features", lambda v: v * 100)), {}),
    "MBMM": (lambda s, f: embedded(s, f, 64).withColumn("features", F.transform("features", lambda v: (v + 1) / 2 * 0.998 + 0.001)), {}),
    "BGMM": (lambda s, f: embedded(s, f, 2).withColumn("features", F.array(F.col("features")[0], (F.col("features")[1] + 1) / 2 * 0.998 + 0.001)), {}),
    "SFCMEP": (lambda s, f: half_labelled(s, f, "case when vec_id % 5 = 0 then label % 3 end", 64), {}),
    "SoftKSC": (lambda s, f: half_labelled(s, f, "case when vec_id % 5 = 0 then if(label % 2 = 0, 1, -1) end", 64), {}),
    "SoftDBSCANGM": (lambda s, f: embedded(s, f, 2), {"eps": 0.05}),
    "AFCMAdaptive": (pixels, {}),
    "SKFCM": (pixels, {"gamma": 1e-4}),
    "FeMIFuzzy": (clients, {}),
    "BIGCLAM": (brands, {"lr": 1e-4}),
    "BayesianNMF": (brands, {}),
    "MMSB": (brands, {}),
    "CDCGS": (brands, {}),
    "DMoN": (brands, {}),
    "NOCD": (brands, {}),
    "LDA": (docs, {"k": 5, "n_init": 1, "max_iter": 5, "var_max_iter": 5}),
    "PLSI": (docs, {"k": 5}),
    "KMART": (docs, {}),
    "SISC": (docs, {"k": 3}),
    "WBSC": (docs, {}),
    "SCSPA": (ensemble, {}),
    "SHBGF": (ensemble, {}),
    "SMCLA": (ensemble, {}),
}


def _fit(name: str, source, params: dict):
    def run(spark, sf):
        args = (brand_nodes(spark, sf),) if name in ("DMoN", "NOCD") else ()
        return REGISTRY[name](**params).fit(source(spark, sf), *args).memberships

    run.__name__ = f"fit_{name.lower()}"
    run.__doc__ = f"Memberships of a whole fit of {name}."
    return run


for _name, (_source, _params) in FITS.items():
    query(_fit(_name, _source, _params))
