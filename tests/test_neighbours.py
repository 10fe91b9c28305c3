"""Neighbours in blocks, and what is computed from them."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.operators import cloud, mesh, neighbours

POINT = "id long, e double, n double, u double"


def rows_of(x):
    return [(i, *map(float, p)) for i, p in enumerate(x)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ties_are_those_of_the_distance(spark):
    """Sums of squares that differ in their last bit can have one root: then the smaller id is first."""
    root = lambda p: (p[0] * p[0] + p[1] * p[1]) + p[2] * p[2]
    rng = np.random.default_rng(0)
    while True:
        a, b = sorted(itertools.permutations(rng.normal(size=3).tolist(), 3), key=root)[::5]
        if root(a) < root(b) and np.sqrt(root(a)) == np.sqrt(root(b)):
            break
    left, right = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], POINT), spark.createDataFrame([(1, *b), (2, *a)], POINT)
    assert [r.other for r in cloud.nearest(left, right, 2).orderBy("rank").collect()] == [1, 2]
    assert [r.other for r in cloud.nearest(left, right, 2, squares=True).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("leaf", [4, 64])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, leaf):
    """Clumps, copies, a grid with many ties and queries far away, in small blocks."""
    monkeypatch.setattr(neighbours, "LEAF", leaf)
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.integers(0, 6, (250, 3)) / 4, rng.normal(size=(80, 3)) * 1e-3 + 9, rng.normal(size=(40, 3)) * 50, np.zeros((30, 3))])
    x = np.concatenate([y[::5], rng.normal(size=(20, 3)) * 1e4])
    got = {}
    for r in cloud.nearest(spark.createDataFrame(rows_of(x), POINT), spark.createDataFrame(rows_of(y), POINT), 7).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, r.d))
    for i, p in enumerate(x):
        d = np.sqrt((p[0] - y[:, 0]) ** 2 + (p[1] - y[:, 1]) ** 2 + (p[2] - y[:, 2]) ** 2)
        assert got[i] == [(j, d[j]) for j in np.argsort(d, kind="stable")[:7]]


def test_outliers_take_neighbours_as_lists(spark):
    """One row a point: no neighbour is ranked, shuffled or joined as a row of its own."""
    df = spark.createDataFrame(rows_of(np.random.default_rng(1).normal(size=(300, 3))), POINT)
    near = neighbours.neighbour_lists(df, df, 12, cloud.AXES, same=True)
    assert near.count() == 300
    got = {r.id: r.mean_m for r in cloud.sigma_outliers(df, near=near).collect()}
    x = np.array([r[1:] for r in df.collect()])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 1:13].mean(1)
    assert got == pytest.approx(dict(enumerate(d.tolist())))
    assert "Window" not in plan(cloud.nearest(df, df, 12, same=True))


def test_cleaning_writes_a_row_a_point(spark, monkeypatch):
    """The neighbours of a cloud are never written as a table of pairs."""
    df = spark.createDataFrame(rows_of(np.random.default_rng(2).normal(size=(260, 3))), POINT)
    most, write = [], cloud.written
    monkeypatch.setattr(cloud, "written", lambda t, label: most.append((out := write(t, label)).count()) or out)
    assert 200 < cloud.clean_cloud(df).count() < 260 and max(most) <= 260


@pytest.mark.parametrize("cameras", [3, 70])
def test_cleaning_sends_no_points_to_all_tasks(spark, monkeypatch, cameras):
    """Joins on ids are merge joins, though tables as small as these would be broadcast."""
    x = np.random.default_rng(8).normal(size=(260, 3))
    df, eyes = spark.createDataFrame(rows_of(x), POINT), spark.createDataFrame(rows_of(x[:cameras]), POINT)
    plans, write = [], cloud.written
    monkeypatch.setattr(cloud, "written", lambda t, label: plans.append(plan(t)) or write(t, label))
    out = cloud.clean_cloud(df, eyes)
    assert 130 <= out.count() < 260
    told = "".join([*plans, plan(out)])
    assert "BroadcastHashJoin" not in told and told.count("SortMergeJoin") == (4 if cameras == 3 else 5)


def test_heights_meet_no_other_table(spark):
    """The neighbours bring their heights along: one join, of a point with its own median."""
    x = np.random.default_rng(3).normal(size=(120, 3))
    df = spark.createDataFrame(rows_of(x), POINT)
    joins, write = [], cloud.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cloud, "written", lambda t, label: joins.append(t._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or write(t, label))
        got = {r.id: r.residual_m for r in cloud.height_residual(df, 10).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = [abs(x[i, 2] - np.median(x[np.argsort(d[i])[1:11], 2])) for i in range(len(x))]
    assert got == pytest.approx(dict(enumerate(want))) and joins == [1]


def test_heights_are_not_sent_to_all_tasks(spark, monkeypatch, tmp_path):
    """Points meet their medians in a merge join, though both tables are small by their files."""
    spark.createDataFrame(rows_of(np.random.default_rng(9).normal(size=(120, 3))), POINT).write.parquet(f"{tmp_path}/points")
    plans, write = [], cloud.written
    monkeypatch.setattr(cloud, "written", lambda t, label: plans.append(plan(t)) or write(t, label))
    assert cloud.height_residual(spark.read.parquet(f"{tmp_path}/points"), 10).count() == 120
    assert "Broadcast" not in plans[0] and plans[0].count("SortMergeJoin") == 1


def test_only_counts_of_blocks_are_sent_to_all_tasks(spark, monkeypatch, tmp_path):
    """Of all that the height test runs, as it ran in the end: no table of points goes through the driver, whatever the limit."""
    monkeypatch.setattr(neighbours, "LEAF", 64)
    spark.createDataFrame(rows_of(np.random.default_rng(10).normal(size=(1_200, 3))), POINT).write.parquet(f"{tmp_path}/points")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    every = lambda seq: (seq.apply(i) for i in range(seq.size()))
    ids = lambda: {run.executionId() for run in every(store.executionsList())}
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), ids()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert cloud.height_residual(spark.read.parquet(f"{tmp_path}/points"), 10).count() == 1_200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    bus.waitUntilEmpty(30_000)
    sent = []
    for run in ids() - before:
        values = store.executionMetrics(run)
        for node in every(store.planGraph(run).allNodes()):
            if node.name() == "BroadcastExchange":
                rows = {m.name(): values.get(m.accumulatorId()) for m in every(node.metrics())}["number of output rows"]
                sent.append(int(rows.get().replace(",", "")) if rows.isDefined() else 0)
    assert sent and max(sent) < 60


def test_far_vertices_meet_few_blocks():
    """Vertices far from the whole cloud do not meet all of it."""
    rng = np.random.default_rng(5)
    y = np.stack([rng.uniform(-10, 100, 20_000), rng.integers(0, 25, 20_000), rng.integers(0, 19, 20_000)], 1)
    tree = neighbours.Tree(y, 40, 0.0)
    leaf = tree.place(y)
    own = np.unique(leaf)
    tree.fill(own, np.bincount(leaf)[own], *[np.stack([f(y[leaf == i], axis=0) for i in own]) for f in (np.min, np.max)])
    x = np.stack([rng.integers(0, 100, 50), np.full(50, 9_000), rng.uniform(0, 5, 50)], 1).astype(float)
    nearest = ((x[:, None] - y[None]) ** 2).sum(2)
    first = [nearest[i, leaf == b].min() for i, b in enumerate(tree.close(x))]
    met = [(neighbours._gap(p[None], tree.lo[tree.leaves], tree.hi[tree.leaves]) <= r).sum() for p, r in zip(x, first)]
    assert len(own) == 40 and max(met) < 20 and np.mean(met) < 6


def test_vertices_take_the_least_square(spark):
    """As its SQL orders: of two roots that are equal the smaller square."""
    root = lambda p: (p[0] * p[0] + p[1] * p[1]) + p[2] * p[2]
    rng = np.random.default_rng(0)
    while True:
        a, b = sorted(itertools.permutations(rng.normal(size=3).tolist(), 3), key=root)[::5]
        if root(a) < root(b) and np.sqrt(root(a)) == np.sqrt(root(b)):
            break
    points = spark.createDataFrame([(1, *b, 0.5, "b", False), (2, *a, 0.5, "a", False)], POINT + ", conf double, source string, synthetic boolean")
    assert [r.source for r in mesh.vertex_attributes(spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "vid long, x double, y double, z double"), points).collect()] == ["a"]


def test_scales_of_all_points(spark):
    """Without refs every point counts, and no row holds them all."""
    x = np.random.default_rng(6).uniform(0, 9, (400, 3))
    df = spark.createDataFrame([*rows_of(x), (900, None, 0.0, 0.0), (901, float("inf"), 0.0, 0.0)], POINT)
    got = {r.id: r.scale for r in cloud.primitive_scales(df, None).collect()}
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)[:, 1]
    assert got == pytest.approx(dict(enumerate((np.clip(d, 0.02, 1.5) * 0.6).tolist())) | {900: 0.012, 901: 0.9})


@pytest.mark.parametrize("ratio", [0.95, 0.8])
def test_matches_in_blocks(spark, monkeypatch, ratio):
    """Copies, a small image, a null and one that is not finite; blocks smaller than an image. No row is a distance."""
    from scenespark.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 8)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 5)).astype("float32")
    x[20:32] = x[:12] + rng.normal(size=(12, 5)).astype("float32") * 0.05
    x[33] = x[32]
    img = [0] * 20 + [1] * 36 + [2] * 4
    rows = [(g, i, v.tolist()) for i, (g, v) in enumerate(zip(img, x))]
    desc = spark.createDataFrame([*rows, (0, 70, None), (1, 71, [float("inf")] * 5)], "img int, kp long, desc array<float>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "i int, j int")
    out = matching.mutual_matches(desc, pairs, ratio, 1)
    x, img, want = x.astype(float), np.array(img), set()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        a, b = np.flatnonzero(img == i), np.flatnonzero(img == j)
        d = np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))
        for u, v in np.argwhere((d == d.min(1)[:, None]) & (d == d.min(0)[None])):
            if d[u, v] < ratio * np.sort(d[u])[1] and d[u, v] < ratio * np.sort(d[:, v])[1]:
                want.add((i, j, int(a[u]), int(b[v])))
    assert {(r.i, r.j, r.ka, r.kb) for r in out.collect()} == want and len(want) > 5
    assert "zip_with" not in plan(out)
