"""Quality model, pair vectors, autoencoder, lift and clustering against plain numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postgrain.operators import cluster as cl
from postgrain.operators import lift as lf
from postgrain.operators import pairs as pr
from postgrain.operators import quality as ql
from postgrain.operators import sae as ae
from postgrain.operators import terms as tm
from postgrain.plans import features as plan


def vectors_frame(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in x[i]], *(columns[n][i] for n in names)) for i in range(len(x))]
    types = "".join(f", {n} {'int' if isinstance(columns[n][0], int) else 'string'}" for n in names)
    return spark.createDataFrame(rows, "pair_id bigint, vec array<float>" + types)


# -- quality -------------------------------------------------------------------------------------------------------


def newton_reference(x, y, C=1.0):
    """Balanced, L2-penalised logistic regression on population-standardised columns by Newton's method."""
    std = x.std(0)
    z = (x - x.mean(0)) / np.where(std > 0, std, 1)
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    a = np.c_[z, np.ones(len(z))]
    penalty = np.diag([1.0 / C] * z.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ b))
        grad = a.T @ (w * (p - y)) + penalty @ b
        b -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + penalty, grad)
    return 1 / (1 + np.exp(-a @ b))


def test_quality_model_matches_newton(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)).astype(np.float32) * [1, 5, 0.1, 1, 2, 1] + 3
    x[:, 5] = 2.5  # a constant column
    y = (x[:, 0] - x[:, 1] / 5 + rng.normal(size=150) > 2.4).astype(int)
    df = vectors_frame(spark, x, label=[int(v) for v in y])
    df = df.select(F.col("pair_id").cast("string").alias("post_id"), F.col("vec").alias("embedding"), "label")
    for parts in (1, 5):
        model = ql.fit_quality(df.repartition(parts), tol=1e-10)
        got = {int(r.post_id): r.score for r in ql.score_quality(model, df).collect()}
        want = newton_reference(x.astype(np.float32).astype(float), y)
        assert max(abs(got[i] - want[i]) for i in range(150)) < 1e-5
    again = ql.LinearModel.from_frame(model.to_frame(spark))
    assert np.allclose(again.weights, model.weights) and again.bias == model.bias


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [2.0, 1.0])], "label int, embedding array<float>")
    with pytest.raises(ValueError, match="both classes"):
        ql.fit_quality(df)


def test_class_report_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "label int, pred int")
    rows = {r.row: r for r in ql.class_report(df).collect()}
    assert rows["low quality"].precision == 0 and rows["high quality"].f1 == 0 and rows["accuracy"].support == 2


def test_missing_vectors_give_missing_scores(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "post_id string, embedding array<float>")
    got = {r.post_id: r.score for r in ql.score_quality(ql.LinearModel(np.array([0.0, 1.0]), 0.0), df).collect()}
    assert got == {"a": 0.5, "b": None}


# -- pairs and autoencoder -----------------------------------------------------------------------------------------


def test_normal_diffs(spark):
    pairs = spark.createDataFrame(
        [(0, "a", "tone", "up"), (1, "b", "tone", "down"), (2, "c", "tone", "down")],
        "pair_id bigint, post_id string, axis string, direction string",
    )
    orig = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "pair_id bigint, embedding array<float>")
    rew = spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, 3.0]), (2, [1.0, 1.0])], "pair_id bigint, embedding array<float>")
    diffs = plan.pair_diffs(pairs, orig, rew)
    got = {r.pair_id: ([round(v, 6) for v in r["diff"]], r.norm) for r in diffs.collect()}
    assert got[0] == ([0.6, 0.8], 5.0) and got[1][0] == [0.0, -1.0] and got[2] == ([0.0, 0.0], 0.0)
    assert pr.pair_stats(diffs).first().flipped == 2


def test_mean_pool_without_tokens_is_zero(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 0, [9.0, 9.0]), ("b", 0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "text_id string, mask int, vec array<float>")
    assert {r.text_id: r.embedding for r in pr.mean_pool(df).collect()} == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


@pytest.fixture(scope="module")
def directions(spark):
    """Unit vectors around a few directions, one axis each."""
    rng = np.random.default_rng(0)
    centres = np.linalg.qr(rng.normal(size=(16, 16)))[0][:4]
    which = rng.integers(0, 4, 600)
    x = centres[which] + 0.1 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = ["tone", "humor", "background", "grounding"]
    df = vectors_frame(spark, x, axis=[axes[i] for i in which]).withColumnRenamed("vec", "diff")
    return x.astype(np.float32).astype(float), df.cache(), axes


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 5))
    params = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in ae.Sae.initial(5, 3).params.items()}

    def loss(p):
        f = np.maximum(x @ p["W_enc"].T + p["b_enc"], 0)
        return ((f @ p["W_dec"] + p["b_dec"] - x) ** 2).sum(1).mean() + 0.05 * f.sum(1).mean()

    grads, _ = ae._gradients(params, x, 0.05)
    for name in ae.NAMES:
        for index in np.ndindex(params[name].shape):
            up = {k: v.copy() for k, v in params.items()}
            down = {k: v.copy() for k, v in params.items()}
            up[name][index] += 1e-6
            down[name][index] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - grads[name][index]) < 1e-5


@pytest.mark.parametrize("workers", [1, 8])
def test_sae_training(spark, directions, workers):
    x, df, axes = directions
    sae, history = ae.sae_fit(df, features=8, epochs=60, batch=16, local_epochs=20, workers=workers)
    assert np.allclose(np.linalg.norm(sae.params["W_dec"], axis=1), 1.0)
    rows = history.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == list(range(60)) and all(0 <= r.density <= 1 for r in rows)
    recon = np.array([r.recon for r in rows])
    assert recon[-10:].mean() < 0.7 * recon[:5].mean()
    encoded = ae.sae_encode(df, sae)
    acts = np.array([r.activations for r in encoded.orderBy("pair_id").collect()])
    p = sae.params
    want = np.maximum(x @ p["W_enc"].T + p["b_enc"], 0)
    assert np.allclose(acts, want, atol=1e-5)
    losses = ae.sae_losses(encoded, sae).first()
    error = ((want @ p["W_dec"] + p["b_dec"] - x) ** 2).sum(1).mean()
    assert abs(losses.recon - error) < 1e-4 and abs(losses.sparsity - want.sum(1).mean()) < 1e-4
    again = ae.Sae.from_frame(sae.to_frame(spark))
    assert all(np.allclose(again.params[k], p[k]) for k in ae.NAMES)


def averaged_training(df, workers, chunk, epochs, local_epochs, features, batch):
    """The whole training in numpy: workers by the hash of the key, chunks in turn, averages after each round."""
    rows = df.select(
        F.pmod(F.xxhash64("pair_id"), F.lit(workers)).alias("w"), F.xxhash64("pair_id", F.lit(1)).alias("place"), F.col("diff").cast("array<float>").alias("x")
    ).collect()
    parts = {}
    for r in sorted(rows, key=lambda r: (r.w, r.place)):
        parts.setdefault(r.w, []).append(r.x)
    parts = {w: np.array(p, dtype=np.float64) for w, p in parts.items()}
    n, dim = len(rows), len(rows[0].x)
    steps = -(-(-(-n // len(parts))) // batch)
    state = {"w": ae.Sae.initial(dim, features).params}
    state["m"] = state["s"] = {k: np.zeros_like(v) for k, v in state["w"].items()}
    cfg, density = {"l1": ae.L1, "lr": ae.LEARNING_RATE, "batch": batch}, {}
    for first in range(0, epochs, local_epochs):
        span, total = range(first, min(first + local_epochs, epochs)), None
        for w, x in parts.items():
            own = {kind: {k: v.copy() for k, v in params.items()} for kind, params in state.items()}
            taken = first * steps
            for k, at in enumerate(range(0, len(x), chunk)):
                piece = x[at : at + chunk]
                ae._train_chunk(piece, own, taken, span, cfg, np.random.default_rng([ae.SEED, first, w, k]))
                taken += len(span) * -(-len(piece) // batch)
            part = {kind: {k: v * len(x) / n for k, v in params.items()} for kind, params in own.items()}
            total = part if total is None else {kind: {k: total[kind][k] + v for k, v in params.items()} for kind, params in part.items()}
        state = total
        state["w"]["W_dec"] = ae.unit_rows(state["w"]["W_dec"])
        density[span[-1]] = sum(ae._active(x, state["w"]) for x in parts.values()) / (n * features)
    return state["w"], density


@pytest.mark.parametrize("workers, chunk", [(1, 1000), (8, 1000), (3, 70)])
def test_sae_training_by_numpy(spark, directions, workers, chunk):
    _, df, _ = directions
    fit = dict(features=4, epochs=7, batch=16, local_epochs=3)
    want, density = averaged_training(df, workers, chunk, **fit)
    for given in (df, df.repartition(13, "axis")):
        model, history = ae.sae_fit(given, workers=workers, chunk=chunk, **fit)
        assert all(np.allclose(model.params[k], want[k], atol=1e-9) for k in ae.NAMES)
        got = {r.epoch: r.density for r in history.collect()}
        assert sorted(got) == list(range(7)) and all(abs(got[e] - d) < 1e-12 for e, d in density.items())


def test_sae_workers_do_not_follow_the_rows(spark, monkeypatch):
    """The same number of models is averaged at 1,000 and at 30,000 vectors, each in chunks of bounded size."""
    seen = []
    stack = ae._round
    monkeypatch.setattr(ae, "_round", lambda data, *a: seen.append(data.select("worker").distinct().count()) or stack(data, *a))
    for n in (1_000, 30_000):
        unit = [(F.rand(k) - 0.5).cast("float") for k in range(4)]
        df = spark.range(n).select(F.col("id").alias("pair_id"), F.array(*unit).alias("diff"))
        assert ae.sae_fit(df, features=3, epochs=1, local_epochs=1)[1].count() == 1
    assert set(seen) == {ae.WORKERS}


def test_weights_without_densities(spark, directions, monkeypatch):
    """The same weights to the last bit when the history leaves out its densities, as a sweep does."""
    _, df, _ = directions
    passes, active = [], ae._active
    monkeypatch.setattr(ae, "_active", lambda *a: passes.append(1) or active(*a))
    fits = [ae.sae_fit(df, features=4, epochs=4, local_epochs=2, workers=2, densities=d) for d in (True, False)]
    (one, full), (two, bare) = fits
    assert all((one.params[k] == two.params[k]).all() for k in ae.NAMES)
    assert full.select("recon").collect() == bare.select("recon").collect()
    assert full.filter("density is null").isEmpty() and bare.filter("density is not null").isEmpty()
    rng = np.random.default_rng(0)
    state = {kind: {k: rng.random((1 if k[0] == "b" else 3, 3)) for k in ae.NAMES} for kind in "wms"}
    ae._train_chunk(rng.random((20, 3)), state, 0, range(2), {"batch": 8, "l1": 0.1, "lr": 0.01, "densities": False}, rng)
    assert not passes


def test_probe_and_sweep(spark, directions):
    _, df, axes = directions
    probe = ae.axis_probe(df, axes).first()
    assert probe.pairs == 600 and probe.accuracy > 0.95
    sweep = ae.l1_sweep(df, [0.0, 1.0], features=8, epochs=30, local_epochs=30).orderBy("l1").collect()
    assert sweep[0].dead <= sweep[1].dead and sweep[0].features == 8


# -- lift ----------------------------------------------------------------------------------------------------------


def numpy_lift(acts, axis, axes):
    out = {}
    for f in range(acts.shape[1]):
        on = acts[:, f] > 0
        for i, a in enumerate(axes):
            inside = axis == a
            p = on[inside].mean() if inside.any() else 0.0
            q = on[~inside].mean() if (~inside).any() else 0.0
            out[f, i] = p - q if on.mean() >= 0.01 else 0.0
    return out


@pytest.fixture(scope="module")
def activity(spark):
    rng = np.random.default_rng(5)
    axes = ["a", "b", "c", "unused"]
    axis = np.array([axes[i] for i in rng.integers(0, 3, 300)])
    acts = np.maximum(rng.normal(size=(300, 6)), 0)
    acts[:, 0] = 0  # dead
    acts[:, 1] = (axis == "b") * 1.0  # follows one axis
    acts[:, 2] = 0
    acts[:3, 2] = 1.0  # density exactly 0.01
    rows = [(i, str(i), str(axis[i]), "up", acts[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "pair_id bigint, post_id string, axis string, direction string, activations array<double>")
    return df.cache(), acts, axis, axes


def test_lift_matches_numpy(spark, activity):
    df, acts, axis, axes = activity
    lift = lf.lift_matrix(lf.axis_activity(df), axes)
    got = {(r.feature, r.ord): r.lift for r in lift.collect()}
    want = numpy_lift(acts, axis, axes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    cats = {r.feature: r for r in lf.feature_categories(lift).collect()}
    assert cats[0].category == "dead" and cats[0].best_axis is None and cats[0].best_lift == 0
    assert cats[1].category == "confirms_axis" and cats[1].best_axis == "b" and cats[1].best_lift == 1.0
    assert cats[2].category != "dead" and cats[2].density == 0.01


def test_threshold_edges_and_ties(spark):
    rows = [(0, "x", 0, 0.5, 0.30), (0, "y", 1, 0.5, -0.30), (1, "x", 0, 0.5, -0.15), (1, "y", 1, 0.5, 0.1),
            (2, "x", 0, 0.5, 0.14994), (2, "y", 1, 0.5, 0.0)]
    lift = spark.createDataFrame(rows, "feature int, axis string, ord int, density double, lift double")
    cats = {r.feature: (r.category, r.best_axis) for r in lf.feature_categories(lift).collect()}
    assert cats == {0: ("confirms_axis", "x"), 1: ("partial_overlap", "x"), 2: ("novel_candidate", "x")}


def test_axis_best_feature_without_lift(spark):
    rows = [(0, "x", 0, 0.5, 0.0), (1, "x", 0, 0.001, 0.0), (0, "y", 1, 0.5, -0.2), (1, "y", 1, 0.5, 0.2)]
    lift = spark.createDataFrame(rows, "feature int, axis string, ord int, density double, lift double")
    best = {r.axis: (r.feature, r.lift, r.category) for r in lf.axis_best_feature(lift).collect()}
    assert best == {"x": (-1, 0.0, "novel_candidate"), "y": (0, -0.2, "partial_overlap")}


def test_histogram_counts_the_maximum_and_equal_values(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate([0.0, 0.1, 0.5, 1.0])], "feature int, density double")
    bins = {r.bin: r.n for r in lf.density_hist(df).collect()}
    want, _ = np.histogram([0.0, 0.1, 0.5, 1.0], bins=15)
    assert [bins[i + 1] for i in range(15)] == want.tolist()
    same = spark.createDataFrame([(0, 0.25), (1, 0.25)], "feature int, density double")
    want, edges = np.histogram([0.25, 0.25], bins=15)
    rows = lf.density_hist(same).orderBy("bin").collect()
    assert [r.n for r in rows] == want.tolist() and np.allclose([r.low for r in rows], edges[:-1])


def test_report_order_and_examples(spark, activity):
    df, acts, _, axes = activity
    texts = df.select("post_id", "axis", F.lit("o").alias("original"), F.lit("r").alias("rewrite")).filter("pair_id < 150")
    report = plan.report(df, texts, axes).collect()
    order = ["confirms_axis", "partial_overlap", "novel_candidate", "dead"]
    keys = [(order.index(r.category), -abs(r.best_lift), r.f) for r in report]
    assert keys == sorted(keys) and len(report) == 6
    by = {r.f: r for r in report}
    assert by[0].examples == [] and len(by[2].examples) == 3 and len(by[3].examples) == 10
    best = np.lexsort((np.arange(300), -acts[:, 3]))[:10]
    assert [e.pid for e in by[3].examples] == [str(i) for i in best]
    assert {e.original for e in by[3].examples} <= {"o", ""} and set(by[1].lifts) == set(axes)


# -- clustering ----------------------------------------------------------------------------------------------------


def brute_force(x, eps, min_samples, min_size):
    """Flat cut by all pairs: label per row, by size and then smallest index."""
    near = np.zeros((len(x), len(x)))
    for d in range(x.shape[1]):
        near += (x[:, None, d] - x[None, :, d]) ** 2
    near = near <= eps * eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    groups = []
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        label[start], todo, members = len(groups), [start], []
        while todo:
            a = todo.pop()
            members.append(a)
            for b in np.flatnonzero(near[a] & core & (label < 0)):
                label[b] = len(groups)
                todo.append(b)
        groups.append(members)
    out = np.full(len(x), -1)
    kept = sorted((g for g in groups if len(g) >= min_size), key=lambda g: (-len(g), min(g)))
    for i, g in enumerate(kept):
        out[g] = i
    return out


def shapes(kind, rng):
    if kind == "blobs":
        return np.concatenate([rng.normal(c, 0.05, (60, 2)) for c in (0, 1, 1.3)] + [rng.uniform(-1, 3, (60, 2))])
    if kind == "copies":  # a third of all rows is one position, and many more share a few
        return np.concatenate([np.zeros((90, 2)), rng.integers(0, 4, (120, 2)) / 10.0, rng.uniform(-1, 1, (60, 2))])
    if kind == "dense":  # far more points per cell than are compared directly
        return np.concatenate([rng.normal(0, 0.02, (250, 2)), rng.normal([0.16, 0], 0.02, (250, 2))])
    if kind == "grid":  # distances of exactly eps
        g = np.stack(np.meshgrid(np.arange(12), np.arange(12)), -1).reshape(-1, 2) * 0.125
        return np.concatenate([g, g + 4.0])
    return rng.normal(0, 0.3, (200, 3))


@pytest.mark.parametrize("kind", ["blobs", "copies", "dense", "grid", "three"])
def test_clusters_match_brute_force(spark, kind):
    rng = np.random.default_rng(11)
    x = shapes(kind, rng)
    eps = {"blobs": 0.08, "copies": 0.1, "dense": 0.05, "grid": 0.125, "three": 0.15}[kind]
    k = x.shape[1]
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "post_id bigint, point array<double>").repartition(4)
    got = {r.post_id: r.topic for r in cl.density_cluster(df, eps, 5, 6, k).collect()}
    want = brute_force(x, eps, 5, 6)
    assert [got[i] for i in range(len(x))] == want.tolist()
    assert (want >= 0).any()


def test_assignment_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([shapes("blobs", rng), shapes("dense", rng) + [2.0, 0.0]])
    new = np.concatenate([rng.uniform(-1, 3, (150, 2)), x[:40] + rng.normal(0, 0.03, (40, 2))])
    eps = 0.07
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "post_id bigint, point array<double>")
    more = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(new)], "post_id bigint, point array<double>")
    core = cl.cluster_core(df, eps, 5, 6, 2)
    label = brute_force(x, eps, 5, 6)
    near = ((new[:, None, :] - x[None]) ** 2).sum(-1)
    near[:, label < 0] = np.inf
    want = [int(label[i]) if d <= eps * eps else -1 for i, d in zip(near.argmin(1), near.min(1))]
    got = {r.post_id: r.topic for r in cl.assign_topics(more, core, eps, 2).collect()}
    assert [got[i] for i in range(len(new))] == want and len(set(want)) > 2


def test_dense_region_opens_no_pairs_of_cells(spark):
    """In a filled square some 70 small cells lie within reach of each; their links stay about one a cell."""
    x = np.random.default_rng(3).uniform(0, 1, (2000, 2))
    rows = [(i, p.tolist()) for i, p in enumerate(x)] + [(2000 + i, [5.0, float(i) / 100]) for i in range(30)]
    df = spark.createDataFrame(rows, "sid bigint, point array<double>")
    core = cl.stage(cl.core_sites(cl._sites(df, "sid", "point"), 0.25, 5, 2))
    cells = core.select(cl._cell(F.col("x"), 0.25, cl._clique_level(2))).distinct().count()
    links = cl.linked_cells(core, 0.25, 2)
    assert links.count() <= 2 * cells and cells > 250
    roots = {r.root for r in cl.components(links).collect()}
    assert roots == {0, 2000}


def test_even_density_compares_few_points_with_boxes(spark, monkeypatch):
    """Two points a small cell: hardly one has enough by itself, nearly all have with the cells around."""
    x = np.random.default_rng(31).uniform(size=(2000, 2)) * 2
    df = cl.stage(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "sid long, point array<double>"))
    compared, real = [], cl.stage

    def counting(rows):
        out = real(rows)
        compared.append(out.count() if "inside" in rows.columns else 0)
        return out

    monkeypatch.setattr(cl, "stage", counting)
    core = {r.sid for r in cl.core_sites(cl._sites(df, "sid", "point"), 0.25, 5, 2).collect()}
    near = (((x[:, None] - x[None]) ** 2).sum(-1) <= 0.25 * 0.25).sum(1)
    assert core == set(np.flatnonzero(near >= 5).tolist())
    assert sum(compared) < len(x)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame(path + hub, "a bigint, b bigint").repartition(3)
    roots = {r.v: r.root for r in cl.components(edges).collect()}
    assert all(roots[i] == 100 for i in range(100, 161)) and all(roots[i] == 5 for i in range(200, 260))


def test_reduction_keeps_the_dominant_plane(spark):
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=(200, 2)) * 5, rng.normal(size=(200, 4)) * 0.01]
    df = vectors_frame(spark, x).withColumnRenamed("vec", "embedding")
    axes = cl.fit_reduction(df, 2)
    points = np.array([r.point for r in cl.reduce_dim(df, axes).orderBy("pair_id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert axes.shape == (2, 6) and np.allclose(points, unit.astype(np.float32) @ axes.T, atol=1e-5)
    assert np.median((points**2).sum(1)) > 0.999


# -- terms ---------------------------------------------------------------------------------------------------------


def test_terms_small(spark):
    docs = spark.createDataFrame(
        [(0, "The cat sat"), (0, "cat cat"), (1, "The dog sat"), (1, "Ünï_1 x")], "topic int, text string"
    )
    counts = tm.ngram_counts(docs, min_df=1, max_df=1.0, stop_words=["the"])
    got = {(r.topic, r.term): r.tf for r in counts.collect()}
    assert got[0, "cat"] == 3 and got[0, "cat sat"] == 1 and got[0, "cat cat"] == 1 and got[1, "ünï_1"] == 1
    assert not any("the" in t.split() or " x" in t for _, t in got)
    common = tm.ngram_counts(docs, min_df=2, max_df=1.0, stop_words=["the"])
    assert {r.term for r in common.collect()} == {"sat"}
    rare = tm.ngram_counts(docs, n=(1, 1), min_df=1, max_df=0.9, stop_words=["the"], max_features=2)
    assert {r.term for r in rare.collect()} == {"cat", "dog"}
    info = tm.topic_info(docs.select("topic"), tm.class_tfidf(counts)).collect()
    assert {r.topic: r.name for r in info}[0].startswith("0_cat")


@pytest.mark.parametrize("buckets, wide", [(64, 1), (1 << 12, 1), (1 << 12, 2)])
def test_terms_by_loaded_buckets(spark, monkeypatch, buckets, wide):
    """The same vocabulary whether few buckets, more of them in a later round, or all terms are counted."""
    rng = np.random.default_rng(3)
    rows = [(None if k % 50 == 7 else k % 5, " ".join(f"w{int(v)}" for v in rng.zipf(1.4, 40) % 3000)) for k in range(300)]
    docs = spark.createDataFrame(rows, "topic int, text string")
    fit = {"min_df": 2, "max_df": 0.8, "stop_words": []}
    every = tm.ngram_counts(docs, max_features=None, **fit).toPandas()
    order = every.groupby("term").tf.sum().reset_index().sort_values(["tf", "term"], ascending=[False, True])
    counted = []
    real = tm.stage
    monkeypatch.setattr(tm, "BUCKETS", buckets)
    monkeypatch.setattr(tm, "WIDE", wide)
    monkeypatch.setattr(tm, "stage", lambda df: counted.append((tuple(df.columns), staged := real(df))) or staged)
    got = {(r.topic, r.term): r.tf for r in tm.ngram_counts(docs, max_features=20, **fit).collect()}
    best = set(order.term[:20])
    assert got == {(None if np.isnan(t) else int(t), w): n for t, w, n in every.itertuples(index=False) if w in best}
    terms = [c.select("term").distinct().count() for names, c in counted if names == ("topic", "term", "tf")]
    assert terms[0] < terms[1] if buckets == 64 else terms[0] < len(order)


def test_stop_words_default(spark):
    docs = spark.createDataFrame([(0, "this is about pets")], "topic int, text string")
    terms = {r.term for r in tm.ngram_counts(docs, min_df=1, max_df=1.0).collect()}
    assert terms == {"pets"}


def test_hash_embed(spark):
    docs = spark.createDataFrame([("a", "red cat"), ("b", "red cat"), ("c", "blue dog runs"), ("d", "")], "post_id string, text string")
    got = {r.post_id: np.array(r.embedding) for r in tm.hash_embed(docs).collect()}
    assert np.allclose(got["a"], got["b"]) and abs(np.linalg.norm(got["c"]) - 1) < 1e-9
    assert got["a"] @ got["c"] < 0.9 and np.allclose(got["d"], 0)


def test_hash_embed_by_hand(spark):
    texts = {"a": "red cat red", "b": "Blue dog", "c": None, "d": "cat"}
    docs = spark.createDataFrame(list(texts.items()), "post_id string, text string")
    got = {r.post_id: r.embedding for r in tm.hash_embed(docs, dim=16, seed=3, buckets=1 << 10, fan=3).collect()}
    bucket = {w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (1 << 10) for w in ("red", "cat", "blue", "dog")}
    df = {"red": 1, "cat": 2, "blue": 1, "dog": 1}
    for key, words in {"a": ["red", "cat", "red"], "b": ["blue", "dog"], "d": ["cat"]}.items():
        want = np.zeros(16)
        for w in words:
            digits = hashlib.md5(f"3:{bucket[w]}".encode()).hexdigest()
            for f in range(3):
                sign = -1 if int(digits[4 * f + 3], 16) % 2 else 1
                want[int(digits[4 * f : 4 * f + 3], 16) % 16] += sign * np.log(4 / (df[w] + 1))
        assert np.allclose(got[key], want / max(np.linalg.norm(want), 1e-12))
    assert got["c"] is None


def test_examples_read_rewrites_where_they_lie(spark):
    acts = spark.createDataFrame(
        [(i, str(i % 7), "x", "up", [float(i), float(-i)]) for i in range(40)],
        "pair_id bigint, post_id string, axis string, direction string, activations array<double>",
    )
    texts = [(str(p), "x", f"o{p}", f"r{c}") for p in range(5) for c in (2, 1)]
    rewrites = spark.createDataFrame(texts, "post_id string, axis string, original string, rewrite string")
    top = lf.feature_examples(acts, rewrites, 10)
    rows = sorted((r.feature, r.rn, r.pair_id, r.original, r.rewrite) for r in top.collect())
    want = [(0, n + 1, 39 - n, f"o{(39 - n) % 7}", "r2") for n in range(10)]
    assert rows == [(*w[:3], "", "") if int(w[3][1:]) > 4 else w for w in want]
    plan = top._jdf.queryExecution().toString()
    scan = plan[plan.index("== Physical Plan ==") :]
    assert "BroadcastHashJoin" in scan and "LeftSemi" in scan


def test_examples_without_active_vectors(spark):
    schema = "pair_id bigint, post_id string, axis string, direction string, activations array<double>"
    acts = spark.createDataFrame([(1, "a", "x", "up", [0.0])], schema)
    rewrites = spark.createDataFrame([("a", "x", "o", "r")], "post_id string, axis string, original string, rewrite string")
    assert lf.feature_examples(acts, rewrites).count() == 0
