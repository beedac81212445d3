from collections import Counter

import numpy as np
import pytest

from penumbra import soft_queries  # noqa: F401
from penumbra.operators import base, consensus, documents, federated, graphs, images, mixtures, pairwise, prototypes
from penumbra.operators.base import REGISTRY, Points

R = np.random.default_rng(0)
X = np.vstack([R.normal(c, 0.4, (20, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0))])
TRUE = np.repeat([0, 1, 2], 20)
POINTWISE = [n for n in REGISTRY if REGISTRY[n].__module__.endswith(("prototypes", "mixtures"))]


def frame(spark, x=X, label=None):
    if label is None:
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")
    return spark.createDataFrame([(i, [float(v) for v in r], None if y is None else int(y)) for i, (r, y) in enumerate(zip(x, label))], "id bigint, features array<double>, label int")


def source(spark, name):
    if name == "SFCMEP":
        return frame(spark, X, [t if i % 4 == 0 else None for i, t in enumerate(TRUE)])
    if name == "MBMM":
        return frame(spark, np.clip((X + 2) / 9, 0.01, 0.99))
    if name == "BGMM":
        return frame(spark, np.column_stack([X[:, 0], np.clip((X[:, 1] + 2) / 9, 0.01, 0.99)]))
    return frame(spark)


def u_of(m):
    t = m.memberships.orderBy("id", "k").toPandas()
    return t.u.to_numpy().reshape(-1, m.n_clusters)


def purity(labels, true=TRUE):
    return sum(np.bincount(labels[true == t].astype(int)).max() for t in np.unique(true)) / len(true)


def test_all_operators_are_there():
    assert len(REGISTRY) == 42


@pytest.mark.parametrize("name", POINTWISE)
def test_contract(spark, name):
    cls = REGISTRY[name]
    m = cls(k=3).fit(source(spark, name))
    u = u_of(m)
    assert u.shape == (60, 3) and np.isfinite(u).all() and (u >= 0).all()
    assert not cls.CONSTRAINED or np.allclose(u.sum(1), 1, atol=1e-6)
    lab = m.labels().orderBy("id").toPandas().label.to_numpy()
    assert (lab == u.argmax(1)).all()
    assert purity(lab) >= (0.8 if name == "MBMM" else 0.95)
    assert (u_of(cls(k=3).fit(source(spark, name))) == u).all()  # the same again


@pytest.mark.parametrize("name", ["FCM", "PCM", "GK", "GMM", "SFCMEP", "KFCM", "RPFKM"])
def test_sweeps_over_partitions_give_what_one_block_gives(spark, name):
    few = {"max_iter": 4}
    src = source(spark, name).repartition(3)
    a = u_of(REGISTRY[name](k=3, **few).fit(src))
    b = u_of(REGISTRY[name](k=3, **few).fit(Points(src, ("label",) if name == "SFCMEP" else (), local_values=0)))
    assert np.allclose(a, b, atol=1e-9)


def test_parameters():
    e = prototypes.FCM(n_clusters=4, random_state=7)
    assert e.k == 4 and e.seed == 7 and "k=4" in repr(e) and e.set_params(m=3.0).get_params()["m"] == 3.0
    for bad in ({"nope": 1}, {"m": 1.0}, {"k": 0}):
        with pytest.raises(ValueError):
            prototypes.FCM(**bad)


def test_dirty_points(spark):
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(X)] + [(0, [0.0, 0.0, 0.0], "x")] + [(100, None, "x"), (101, [float("nan"), 0.0, 0.0], "x"), (102, [float("inf"), 0.0, 0.0], None), (None, [1.0, 1.0, 1.0], None), (103, [None, 1.0, 1.0], "")]
    m = prototypes.FCM(k=3).fit(spark.createDataFrame(rows, "id bigint, features array<double>, u string"))
    assert m.memberships.select("id").distinct().count() == 60
    with pytest.raises(ValueError):
        prototypes.FCM(k=61).fit(frame(spark))
    with pytest.raises(ValueError):
        prototypes.FCM(k=1).fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id bigint, features array<double>"))


def test_coincident_points_and_one_cluster(spark):
    same = frame(spark, np.ones((20, 3)))
    for name in ("FCM", "PCM", "AFCMSimple", "ECM", "KFCM", "GMM", "GathGeva", "GK"):
        assert np.isfinite(u_of(REGISTRY[name](k=2).fit(same))).all(), name
    assert np.allclose(u_of(prototypes.FCM(k=1).fit(frame(spark))), 1)


def test_reductions(spark):
    """FCM with m near 1 is k-means; PFCM without typicality is FCM; rough sets hold their lower ones."""
    c = X[[0, 20, 40]]
    hard = mixtures.lloyd(Points(frame(spark)), c)
    soft = prototypes.FCM(k=3, m=1.02, init=c).fit(frame(spark)).centers
    assert np.allclose(hard, soft, atol=1e-6)
    p = prototypes.PFCM(k=3, typicality_weight=0.0, init=c, max_iter=80).fit(frame(spark))
    assert np.allclose(p.centers, prototypes.FCM(k=3, init=c).fit(frame(spark)).centers, atol=1e-3)
    m = prototypes.RoughKMeans(k=3, init=c).fit(frame(spark))
    low, up = (m.extras[n].orderBy("id", "k").toPandas().u.to_numpy().reshape(-1, 3) for n in ("lower", "upper"))
    assert (low <= up).all() and (low.sum(1) <= 1).all() and (up.sum(1) >= 1).all()


def test_out_of_sample(spark):
    m = prototypes.FCM(k=3).fit(frame(spark))
    t = m.transform(frame(spark, X[:5])).toPandas()
    assert len(t) == 15
    with pytest.raises(NotImplementedError):
        pairwise.SCM().fit(frame(spark)).transform(frame(spark))


@pytest.mark.parametrize("op", [pairwise.SCM(), pairwise.SoftDBSCANGM(eps=1.5), pairwise.KFCCL(k=3), pairwise.AFCM(k=3), pairwise.EVCLUS(k=3)], ids=lambda o: type(o).__name__)
def test_pairwise(spark, op):
    m = op.fit(frame(spark))
    u = u_of(m)
    assert np.isfinite(u).all() and np.allclose(u.sum(1), 1, atol=1e-6) and purity(u.argmax(1)) >= 0.9


def test_pair_map_in_tasks(spark):
    x = R.normal(size=(5000, 2))
    got = pairwise.pair_map(spark, x, lambda q, a, i: (q[:, None, 0] > a[None, :, 0]).sum(1).astype(float))
    assert (got == np.argsort(np.argsort(x[:, 0]))).all()


def test_dbscan_against_brute_force(spark):
    x = R.uniform(0, 4, (150, 2))
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3
    core, want, k = near.sum(1) >= 4, np.full(150, -1), 0
    for i in range(150):
        if core[i] and want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = k
                    if core[j]:
                        todo += list(np.flatnonzero(near[j] & (want < 0)))
            k += 1
    assert (pairwise.dbscan(spark, x, 0.3, 4) == want).all()


def test_kernel_semi_supervised(spark):
    y = [(1 if t == 0 else -1) if i % 3 == 0 and t < 2 else None for i, t in enumerate(TRUE)]
    m = pairwise.SoftKSC().fit(frame(spark, X, y))
    assert np.allclose(u_of(m).sum(1), 1) and purity(u_of(m)[:40].argmax(1), TRUE[:40]) >= 0.9
    assert m.transform(frame(spark, X[:4])).count() == 8


def planted(spark, n=60):
    z = np.repeat([0, 1, 2], n // 3)
    a = np.triu(R.random((n, n)) < np.where(z[:, None] == z[None], 0.7, 0.04), 1)
    e = [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))]
    edges = spark.createDataFrame([*e, e[0], (1, 1, 5.0), (None, 2, 1.0), (3, 4, None)], "src bigint, dst bigint, w double")
    return edges, spark.createDataFrame([(i, [float(v) for v in np.eye(3)[z[i]] + R.normal(0, 0.1, 3)]) for i in range(n)], "id bigint, features array<double>"), z


def test_graphs(spark):
    edges, nodes, z = planted(spark)
    for op, least in ((graphs.BIGCLAM(k=3), 0.6), (graphs.BayesianNMF(k=3), 0.9), (graphs.MMSB(k=3), 0.9), (graphs.CDCGS(k=3, n_init=2), 0.9), (graphs.DMoN(k=3), 0.6), (graphs.NOCD(k=3, max_epochs=200), 0.8)):
        u = u_of(op.fit(edges, nodes))
        assert np.isfinite(u).all() and purity(u.argmax(1), z) >= least, type(op).__name__
        assert not op.CONSTRAINED or np.allclose(u.sum(1), 1)
    a, b = (u_of(graphs.BIGCLAM(k=2, max_iter=4, in_memory=m).fit(edges, nodes)) for m in (True, False))
    assert np.allclose(a, b)
    g = graphs.Graph(edges)
    for fn in (graphs.CDCGS(k=3).value, graphs.CDCGS(k=3, objective="block_diagonal").value, graphs.DMoN(k=3).loss):
        c, d = graphs.softmax(R.normal(size=(60, 3))), R.normal(size=(60, 3))
        assert abs((fn(g, c + 1e-6 * d)[0] - fn(g, c - 1e-6 * d)[0]) / 2e-6 - (fn(g, c)[1] * d).sum()) < 1e-6


def test_documents(spark):
    themes = ["cat dog pet animal fur", "stock market trade price bank", "star galaxy planet orbit space"]
    rows = [(i * 6 + j, themes[i] + " " + themes[i].split()[j % 5] + " the") for i in range(3) for j in range(6)] + [(98, None), (99, "")]
    docs, z = spark.createDataFrame(rows, "doc_id bigint, text string"), np.repeat([0, 1, 2], 6)
    for op in (documents.LDA(k=3, n_init=3, max_iter=20), documents.PLSI(k=3, tempered=False)):
        u = u_of(op.fit(docs))
        assert u.shape == (18, 3) and np.allclose(u.sum(1), 1) and purity(u.argmax(1), z) >= 0.9
    for op in (documents.KMART(), documents.WBSC(), documents.SISC(k=3)):
        m = op.fit(docs)
        rows_ = {(r["id"], r["k"]) for r in m.memberships.collect()}
        assert rows_ == {(i, k) for k, c in enumerate(m.extras["clusters"]) for i in c} and len(m.extras["clusters"]) == m.n_clusters
    assert documents.KMART().fit(docs).n_clusters >= 3
    local = documents.Corpus(documents.term_counts(docs), 3)
    spread = documents.Corpus(documents.term_counts(docs), 3, local_terms=0)
    total = lambda ids, d, t, c: (c.sum(), np.bincount(t, c, 16))
    assert all(np.allclose(a, b) for a, b in zip(local.reduce(total), spread.reduce(total)))


def test_images(spark):
    img = (np.arange(16) >= 8)[None, :] * 1.0 + R.normal(0, 0.05, (10, 16))
    px = spark.createDataFrame([(i, j, float(img[i, j])) for i in range(10) for j in range(16)], "row int, col int, value double")
    assert purity(u_of(images.SKFCM(k=2).fit(px)).argmax(1), np.tile(np.arange(16) >= 8, 10).astype(int)) > 0.95
    assert np.allclose(u_of(images.AFCMAdaptive(k=2).fit(px)).sum(1), 1)
    assert np.allclose(images.gauss(np.ones((5, 6))), 1) and np.allclose(images.laplace(np.ones((5, 6))), 0)
    with pytest.raises(ValueError):
        images.SKFCM(k=2).fit(px.where("col <> 3"))


def test_consensus_and_clients(spark):
    ens = None
    for run in range(3):
        m = prototypes.FCM(k=3, seed=run).fit(frame(spark)).memberships.selectExpr(f"{run} as run", "id", "k", "u")
        ens = m if ens is None else ens.unionByName(m)
    for op in (consensus.SCSPA(k=3, n_init=3), consensus.SHBGF(k=3, n_init=3), consensus.SMCLA(k=3)):
        assert purity(u_of(op.fit(ens)).argmax(1)) == 1.0
    rows = [(c, c * 100 + i, f"f{j}", None if R.random() < 0.05 else float(v)) for c in range(2) for i, x in enumerate(np.vstack([R.normal(0, 0.3, (9, 3)), R.normal(4, 0.3, (9, 3))])) for j, v in enumerate(x)]
    m = federated.FeMIFuzzy(max_clusters=3, n_imputations=2).fit(spark.createDataFrame([*rows, (0, 0, "only_here", 1.0)], "client int, id bigint, feature string, value double"))
    assert m.extras["client_sizes"] == {0: 18, 1: 18} and np.allclose(u_of(m).sum(1), 1)


def test_points_first_is_the_same_in_tasks(spark):
    key = lambda ids, x: np.round(x[:, 0])
    a, b = (Points(frame(spark), local_values=n).first(key, 7) for n in (base.LOCAL_VALUES, 0))
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])


def test_names_of_the_package():
    import penumbra

    assert set(penumbra.__all__) == set(REGISTRY) and all(getattr(penumbra, n) is REGISTRY[n] for n in penumbra.__all__)
    with pytest.raises(AttributeError):
        penumbra.NOTHING


def test_clients_keep_every_user(spark, tmp_path, monkeypatch):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    put("events", [(u, kind, float(u)) for u in range(700) for kind in ("view", "click")], "user_id bigint, event_type string, value double")
    put("customer", [(u, u % 4) for u in range(690)], "c_custkey bigint, c_nationkey int")
    put("nation", [(n, n % 2) for n in range(4)], "n_nationkey int, n_regionkey int")
    values = lambda: {(r["client"], r["id"], r["value"]) for r in soft_queries.clients(spark, str(tmp_path)).where("feature = 'view'").collect()}
    assert values() == {(f"{u % 2 if u < 690 else -1}.0", u, float(u)) for u in range(700)}
    monkeypatch.setattr(federated, "CLIENT_ROWS", 100)
    got = values()
    sizes = Counter(c for c, *_ in got)
    assert {u for _, u, _ in got} == set(range(700)) and len(got) == 700 and 2 <= min(sizes.values()) and max(sizes.values()) <= 100


def blocks_by_pairs(y, soft, alpha, sweeps, inner):
    """(block matrix, gamma) of the blockmodel, one pair of nodes after the other."""
    n, k = soft.shape
    pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
    out, into = {q: soft[q[0]] for q in pairs}, {q: soft[q[1]] for q in pairs}

    def sums():
        g = np.full((n, k), alpha)
        for i, j in pairs:
            g[i] += out[i, j]
            g[j] += into[i, j]
        both, linked = (sum(w[q] * np.outer(out[q], into[q]) for q in pairs) for w in (np.ones((n, n)), y))
        return np.clip(linked / (both + 1e-10), 1e-10, 1 - 1e-10), g

    b, g = sums()
    one = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    for _ in range(sweeps):
        el = graphs.digamma(g) - graphs.digamma(g.sum(1, keepdims=True))
        for i, j in pairs:
            like = y[i, j] * np.log(b) + (1 - y[i, j]) * np.log1p(-b)
            for _ in range(inner):
                out[i, j] = one(el[i] + like @ into[i, j])
                into[i, j] = one(el[j] + out[i, j] @ like)
        b, g = sums()
    return b, g


def test_blockmodel_against_single_pairs_on_the_driver_and_spread(spark, monkeypatch):
    r, n = np.random.default_rng(8), 18
    z = np.repeat([0, 1, 2], 6)
    a = np.triu(r.random((n, n)) < np.where(z[:, None] == z[None], 0.7, 0.15), 1)
    y = np.where(a | a.T, 1.0, 0.0)
    y[0, 1] = y[1, 0] = 0.4
    edges = spark.createDataFrame([(int(i), int(j), float(y[i, j])) for i, j in zip(*np.nonzero(np.triu(y)))], "src bigint, dst bigint, w double")
    soft = np.full((n, 3), 0.1 / 3) + 0.9 * np.eye(3)[z]
    want = blocks_by_pairs(y, soft, 0.5, 2, 2)
    monkeypatch.setattr(graphs.MMSB, "TILE", 200)
    for local in (graphs.MMSB.LOCAL, 0):
        monkeypatch.setattr(graphs.MMSB, "LOCAL", local)
        m = graphs.MMSB(k=3, init=z, max_iter=2, n_inner=2, tol=0.0).fit(edges)
        assert np.allclose(m.extras["block_matrix"], want[0]) and np.allclose(m.extras["gamma"], want[1])
    start = graphs.MMSB(k=3, init=z, max_iter=0).fit(edges)
    assert np.allclose(start.extras["block_matrix"], blocks_by_pairs(y, soft, 0.5, 0, 1)[0])


def test_semi_supervised_steps_one_by_one(spark):
    """Memberships near 0 count as 1 at every step; an eighth of the labelled points is reset."""
    r = np.random.default_rng(9)
    x, k = np.vstack([r.normal(c, 0.9, (40, 2)) for c in ((0, 0), (3, 0), (0, 3))]), 3
    label = np.array([t if i % 4 == 0 else -1 for i, t in enumerate(np.repeat([0, 1, 2], 40))])
    df = frame(spark, x, [None if t < 0 else int(t) for t in label])
    c = np.array([x[label == i].mean(0) for i in range(k)])
    d = np.linalg.norm(x[:, None] - c[None], axis=2)
    v, on = d.min(1, keepdims=True) / d, label >= 0
    u = np.minimum(np.where(np.eye(k + 1)[label][:, :k] > 0, 1e-6 + 0.5 * v, 0.5 * v), 1)
    hat = 0.5 * (u[on].max(1).mean() + 1 - (k - 1) * u[on].min(1).mean())
    u = np.where(on[:, None], u, hat)
    h = prototypes.uniform(np.arange(len(x)), 1, 17)[:, 0]
    for j in sorted(np.flatnonzero(on), key=lambda i: h[i])[: on.sum() // 8]:
        u[j, np.arange(k) != u[j].argmax()] = hat

    def step(u, c):
        w = -np.linalg.norm(x[:, None] - c[None], axis=2) ** 2
        w = np.exp(w - w.max(1, keepdims=True))
        w = np.where(np.isclose(u, 0), w, u * w)
        return w / (w.sum(1, keepdims=True) + 1e-12)

    u = step(u, c)
    for _ in range(20):
        c = u.T @ x / (u.sum(0)[:, None] + 1e-8)
        u = step(u, c)
    for local in (base.LOCAL_VALUES, 0):
        m = prototypes.SFCMEP(k=3, max_iter=20, tol=-1.0).fit(Points(df.repartition(3), ("label",), local_values=local))
        assert np.allclose(u_of(m), u, atol=1e-9) and np.allclose(m.centers, c)


def test_least_of(spark):
    p = Points(frame(spark))
    fn = lambda ids, x: prototypes.uniform(ids, 1, 3)[:, 0]
    h = np.sort(fn(np.arange(60), None))
    for m in (1, 7, 59, 60):
        assert (h <= prototypes.least_of(p, fn, m)).sum() == m
    assert prototypes.least_of(p, fn, 0) == 0.0


def dense_resonance(counts, rho, rate):
    """Clusters of documents in order, with whole count vectors as prototypes."""
    words = sorted({w for c in counts for w in c})
    x = np.array([[c.get(w, 0) for w in words] for c in counts], float)
    protos, clusters = [], []
    for i, v in enumerate(x):
        hit = [k for k, p in enumerate(protos) if np.minimum(v, p).sum() / (v.sum() + 1e-9) >= rho]
        for k in hit:
            protos[k] = rate * np.minimum(v, protos[k]) + (1 - rate) * protos[k]
            clusters[k].add(i)
        if not hit:
            protos.append(v)
            clusters.append({i})
    return clusters


@pytest.mark.parametrize("rho, rate", [(0.5, 1.0), (0.3, 0.6), (0.8, 0.5)])
def test_resonance_and_merging_against_whole_vectors(spark, rho, rate):
    r = np.random.default_rng(3)
    docs = [" ".join(f"w{int(v)}" for v in r.zipf(1.5, 12) if v < 40) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    assert documents.KMART(vigilance=rho, learning_rate=rate).fit(df).extras["clusters"] == dense_resonance([Counter(d.split()) for d in docs], rho, rate)


def test_merging_of_alike_clusters_one_by_one():
    r = np.random.default_rng(4)
    bits = r.random((40, 128)) < r.random((40, 1)) * 0.4
    bits[:, 0] = True
    todo = [(frozenset(np.flatnonzero(b)), {str(i)}) for i, b in enumerate(bits)]
    got = documents.merge_alike(np.packbits(bits, axis=1).view(np.uint64), [{str(i)} for i in range(40)], 0.33)
    changed = True
    while changed:
        changed, i = False, 0
        while i < len(todo):
            d, w = todo[i]
            rest = []
            for e, v in todo[i + 1 :]:
                if d <= e or e <= d or len(d & e) / len(d | e) > 0.33:
                    d, w, changed = d | e, w | v, True
                else:
                    rest.append((e, v))
            todo[i:] = [(d, w), *rest]
            i += 1
    assert [(frozenset(np.flatnonzero(np.unpackbits(b.view(np.uint8)))), w) for b, w in got] == todo


@pytest.mark.parametrize("sizes, norm", [([8], True), ([8, 5], True), ([8, 5], False)])
def test_layers_of_the_graph_network_by_finite_differences(spark, sizes, norm):
    edges, nodes, z = planted(spark, 30)
    g, r = graphs.Graph(edges), np.random.default_rng(2)
    op = graphs.NOCD(k=3, hidden_sizes=sizes, batch_norm=norm)
    x = graphs.features_of(nodes, g)
    par, forward, backward, _ = op.network(g, x, r)
    keep = [(r.random((g.n, n)) > 0.3) * 1.4 for n in sizes]
    out, seen = forward(keep)
    to = r.normal(size=out.shape)
    grads = backward(to, seen, keep)
    assert set(grads) == set(par)
    for name, value in par.items():
        step = r.normal(size=value.shape)
        with_step = lambda h: (par.__setitem__(name, value + h * step), (forward(keep)[0] * to).sum(), par.__setitem__(name, value))[1]  # noqa: E731, B023
        slope = (with_step(1e-6) - with_step(-1e-6)) / 2e-6
        assert abs(slope - (grads[name] * step).sum()) < 1e-3 * max(1, abs(slope)), name
    assert np.isfinite(u_of(graphs.NOCD(k=3, hidden_sizes=sizes, batch_norm=norm, max_epochs=60).fit(edges, nodes))).all()


def test_convolutions_by_finite_differences_and_pictures(spark):
    from penumbra.operators import autoencoder

    r = np.random.default_rng(5)
    for back in (False, True):
        net = autoencoder.ImageNet((6, 5), [2, 3], [3, 5], 4, r, "n", back)
        x = r.normal(size=(7, 4 if back else 30))
        acts = net.forward(x)
        assert acts[-1].shape == (7, 30 if back else 4)
        to = r.normal(size=acts[-1].shape)
        grads, gx = net.backward(acts, to)
        assert set(grads) == set(net.par)

        def slope(set_to, value, step):
            at = []
            for h in (1e-6, -1e-6):
                set_to(value + h * step)
                at.append((net.forward(x)[-1] * to).sum())
            set_to(value)
            return (at[0] - at[1]) / 2e-6

        for name, value in list(net.par.items()):
            step = r.normal(size=value.shape)
            assert abs(slope(lambda v, n=name: net.par.__setitem__(n, v), value, step) - (grads[name] * step).sum()) < 1e-5, name
        step = r.normal(size=x.shape)
        plus, minus = ((net.forward(x + h * step)[-1] * to).sum() for h in (1e-6, -1e-6))
        assert abs((plus - minus) / 2e-6 - (gx * step).sum()) < 1e-5
    w = r.normal(size=(1, 1, 3, 3))
    img = r.normal(size=(1, 1, 4, 4))
    pad = np.pad(img[0, 0], 1)
    assert np.allclose(autoencoder.convolve(img, w)[0, 0], [[(pad[i : i + 3, j : j + 3] * w[0, 0]).sum() for j in range(4)] for i in range(4)])
    pictures = np.zeros((30, 8, 8))
    pictures[:15, 1:4, 1:4] = pictures[15:, 4:7, 3:7] = 1
    m = autoencoder.RDFKC(k=2, image=(8, 8), lr=1e-3, max_iter=15).fit(frame(spark, pictures.reshape(30, 64) + r.normal(0, 0.05, (30, 64))))
    assert np.allclose(u_of(m).sum(1), 1) and m.history[-1] < m.history[0] and m.extras["code"].shape == (30, 8)
    with pytest.raises(ValueError):
        autoencoder.RDFKC(k=2, image=(3, 3)).fit(frame(spark))
