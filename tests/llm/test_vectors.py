import numpy as np
import pytest

from scenespark.llm import ann, bsi

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def sample(n=300, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    return rows


ODD = [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, [1.0]), (None, [1.0] * 12), (5, [9.0] * 12)]


def test_bsi_equals_brute_force(spark):
    rows = sample()
    df = table(spark, rows + ODD)
    q = {int(r.vec_id): r for r in df.where("vec_id % 50 = 0").collect()}
    got = bsi.top_inner(df, df.where("vec_id % 50 = 0"), k=10).orderBy("query_id", "rank").collect()
    ints = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows + [(5, [9.0] * 12)]]
    want = []
    for i, v in sorted((x for x in ints if x[0] in q), key=lambda x: x[0]):
        s = sorted((-int(u @ v), j) for j, u in ints if j != i)[:10]
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    got = [tuple(r) for r in got if r.query_id in {i for i, _ in ints}]
    assert got == want


def test_repeated_ids_are_rows_of_their_own(spark):
    """Of three rows of id 1 two are equal: each finds the other two."""
    df = table(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0])])
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id = 1"), k=2).collect())
    assert got == sorted([(1, 1, 1, 0.0), (1, 2, 2, 1.0)] * 2 + [(1, 1, 2, 1.0), (1, 2, 1, 2.0)])
    got = sorted(tuple(r) for r in bsi.top_inner(df, df.where("vec_id = 1"), k=3, scale=1).collect())
    assert got == sorted([(1, 1, 1, 3), (1, 2, 2, 2), (1, 3, 1, 1)] * 2 + [(1, 1, 2, 6), (1, 2, 1, 3), (1, 3, 1, 3)])


def test_blocks_and_segments(spark, monkeypatch):
    """Many blocks of queries and, in each task, many segments."""
    from scenespark.llm import _vectors

    df = table(spark, sample(200))
    whole = [sorted(map(tuple, f(df, df.where("vec_id % 3 = 0"), k=5).collect())) for f in (ann.nearest, bsi.top_inner)]
    monkeypatch.setattr(_vectors, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(_vectors, "SEGMENT_BYTES", 12 * 4 * 16)
    assert whole == [sorted(map(tuple, f(df, df.where("vec_id % 3 = 0"), k=5).collect())) for f in (ann.nearest, bsi.top_inner)]


def test_bsi_few_rows_and_none(spark):
    df = table(spark, [(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, [0.0, 0.0])])
    assert [tuple(r) for r in bsi.top_inner(df, df.where("vec_id = 0")).collect()] == [(0, 1, 2, 0), (0, 2, 1, -3 * 1024 * 1024)]
    assert bsi.top_inner(df.limit(0), df.limit(0)).count() == 0
    assert bsi.top_inner(df.limit(1), df.limit(1)).count() == 0


def test_ann_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), rerank=60).collect()
    x = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    hits = total = 0
    for i in (i for i in x if i % 20 == 0):
        near = sorted((float(np.sqrt(((x[i] - v) ** 2).sum())), j) for j, v in x.items() if j != i)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert len(mine) == 10
        assert all(abs(s - np.sqrt(((x[i] - x[j]) ** 2).sum())) < 1e-12 for _, j, s in mine)
        hits += len({j for _, j in near} & {j for _, j, _ in mine})
        total += 10
    assert hits / total >= 0.9


def clustered(kind):
    rng = np.random.default_rng(4)
    n, dim = 32_768, 64
    x = rng.normal(size=(n, dim)).astype(np.float32)
    if kind == "copies":  # a third of a segment near one vector, with ties: the scan cannot tell these rows apart
        x[: n // 3] = x[0] + 0.02 * rng.normal(size=(n // 3, dim))
        x[100:400] = x[100]
    elif kind:
        centres = rng.normal(size=(kind, dim))
        x = (centres[rng.integers(0, kind, n)] + 0.2 * rng.normal(size=(n, dim))).astype(np.float32)
    return x[rng.permutation(n)]


@pytest.mark.parametrize("kind", ["copies", 10, 50, 0])
def test_ann_full_segment(kind):
    x = clustered(kind)
    ids = np.arange(len(x)) * 3

    class books:
        value = {64: ann.train(x[:2048])}

    segment = {"ids": ids.tobytes(), "dim": 64, **ann._build(ids, x, books)}
    asked = np.arange(0, len(x), 2000)
    p, v, s, own = ann._within(ids[asked], x[asked], segment, 11, 200, books)
    for k, i in enumerate(asked.tolist()):
        far = np.sqrt(((x.astype(np.float64) - x[i]) ** 2).sum(1))
        want = np.lexsort((ids != ids[i], ids, far))[:400]
        want = sorted(want.tolist(), key=lambda j: (far[j], ids[j]))[:11]
        assert v[p == k].tolist() == ids[want].tolist()
        assert np.array_equal(s[p == k], far[want])


def test_ann_odd_rows(spark):
    df = table(spark, sample() + ODD + [(3000, [0.0] * 12)])
    got = ann.nearest(df, df.where("vec_id = 7"), k=45, rerank=400).orderBy("rank").collect()
    assert [r.vec_id for r in got][:40] == list(range(1000, 1040)) and got[0].score == 0.0
    assert not {r.vec_id for r in got} & {7, 2000, 2001, 2002, 2003, 2004, 3000}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_anisotropic_codes_lose_less_along_the_vector():
    x = np.random.default_rng(1).normal(size=(400, 16))
    books = ann.train(x)
    eta = ann._weights(16)
    assert eta == ann.LEAST and ann._weights(64) > 2

    def along(codes):
        back = np.stack([books[s][codes[:, s]] for s in range(books.shape[0])], 1).reshape(400, -1)
        return (((x - back) * x).sum(1) ** 2 / (x * x).sum(1)).mean()

    assert along(ann.encode(x, books, eta)) < along(ann.encode(x, books, 1.0))
