import numpy as np

from visloom.operators import vector_search as vs


def tables(spark, x, q):
    images = spark.createDataFrame(
        [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(10**6, None, "x")], "image_id long, vector array<double>, cell string"
    )
    texts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "text_id long, vector array<double>")
    return images, texts


def plain(x, q, k):
    out = []
    for i, v in enumerate(q):
        scores = np.zeros(len(x))
        for j in range(x.shape[1]):
            scores += v[j] * x[:, j]
        order = sorted(range(len(x)), key=lambda n: (-scores[n], n))[:k]
        out += [(i, n, scores[n], r + 1) for r, n in enumerate(order)]
    return sorted(out)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("text_id", "image_id", "score", "rank").collect())


def test_clustered_vectors_are_pruned_exactly(spark, monkeypatch):
    monkeypatch.setattr(vs, "IMAGE_BLOCK", 300)  # the crowded cluster is dealt into blocks
    monkeypatch.setattr(vs, "TEXT_BLOCK", 7)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 4
    x = centres[np.minimum(rng.integers(0, 40, 3000), 29)] + rng.normal(size=(3000, 16)) * 0.2
    x[100:140] = x[99]  # equal vectors: ties by id
    q = np.vstack([x[99], x[5:30], rng.normal(size=(2, 16)), np.zeros(16)])
    work = {}
    got = vs.embedding_topk(*tables(spark, x, q), 10, work=work)
    assert rows(got) == plain(x, q, 10)
    assert work["pairs"] == 3000 * len(q) and work["scored"] < 0.5 * work["pairs"]


def test_vectors_without_clusters(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(400, 8)), rng.normal(size=(9, 8))
    assert rows(vs.embedding_topk(*tables(spark, x, q), 3)) == plain(x, q, 3)
    assert rows(vs.embedding_topk(*tables(spark, x[:2], q), 3)) == plain(x[:2], q, 3)


def test_no_images_or_no_texts(spark):
    x = np.ones((3, 2))
    images, texts = tables(spark, x, x)
    assert rows(vs.embedding_topk(images.where("vector IS NULL"), texts, 2)) == []
    assert rows(vs.embedding_topk(images, texts.where("false"), 2)) == []


def test_no_cross_join(spark):
    x = np.ones((3, 2))
    plan = vs.embedding_topk(*tables(spark, x, x), 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
