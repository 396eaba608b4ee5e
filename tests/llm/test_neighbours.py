"""Problem 4: most similar vectors."""

import numpy as np

from permeate.llm.neighbours import fit_forest, nearest, quantised, recall, similar_pairs


def brute(x, ids, k=10, least=0.9):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    out = set()
    for q in range(len(y)):
        order = sorted((j for j in range(len(y)) if j != q and s[q, j] >= least), key=lambda j: (-round(s[q, j], 6), ids[j]))[:k]
        out |= {(min(ids[q], ids[j]), max(ids[q], ids[j])) for j in order}
    return out


def data(n=600, d=16, groups=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    return (centres[rng.integers(0, groups, n)] + 0.12 * rng.standard_normal((n, d))).astype(np.float32)


def frame(spark, x, extra=()):
    rows = [(int(i), [float(v) for v in r], "m") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, other_id string")


def test_recall_against_brute_force(spark):
    x = data()
    bad = [(9001, None, ""), (9002, [0.0] * 16, ""), (9003, [1.0] * 5, ""), (9004, [1.0] * 15 + [None], ""), (9005, [float("nan")] * 16, "")]
    df = frame(spark, x, bad)
    near = nearest(df, dimension=16, leaf_rows=40)
    got = {tuple(r) for r in similar_pairs(near).collect()}
    want = brute(x.astype(np.float64), list(range(len(x))))
    assert len(got & want) >= 0.95 * len(want)
    assert max(max(p) for p in got) < 9000
    r = recall(df, near, every=20, dimension=16).first()
    assert r.recall >= 0.9 and r.n_queries > 0


def test_copies_and_crowded_leaves(spark):
    x = data(200, groups=6)
    x = np.vstack([x, np.tile(x[0], (60, 1))])
    near = nearest(frame(spark, x), dimension=16, leaf_rows=30, most_in_block=16)
    rows = near.collect()
    per = {}
    for r in rows:
        per.setdefault(r.vec_id, []).append(r)
    assert all(len(v) <= 10 for v in per.values())
    # a copied vector finds ten copies with similarity 1
    assert all(len(per[i]) == 10 and all(abs(r.similarity - 1) < 1e-6 for r in per[i]) for i in (0, 230, 259))
    assert all(r.vec_id != r.other_id for r in rows)


def test_blocks_lose_nothing(spark):
    x = data(300, groups=5)
    a = {tuple(r)[:2] for r in nearest(frame(spark, x), dimension=16, leaf_rows=100).collect()}
    b = {tuple(r)[:2] for r in nearest(frame(spark, x), dimension=16, leaf_rows=100, most_in_block=20).collect()}
    assert a == b


def test_crowded_leaves_get_trees_of_their_own(spark):
    x = data(3000, groups=300, seed=3)
    df = frame(spark, x)
    # the sample gives no more than two leaves a tree, so every leaf is crowded and split, some of them twice
    near = nearest(df, dimension=16, leaf_rows=40, sample_rows=8, crowded_rows=120, leaf_sample=100)
    assert recall(df, near, every=5, dimension=16).first().recall >= 0.9
    want = brute(x.astype(np.float64), list(range(len(x))))
    got = {tuple(r) for r in similar_pairs(near).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_similarities_are_exact(spark):
    x = data(400, groups=10)
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    for r in nearest(frame(spark, x), dimension=16, leaf_rows=50).collect():
        assert abs(r.similarity - y[r.vec_id] @ y[r.other_id]) < 1e-6


def test_codes_miss_no_pair():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 64))
    x = np.vstack([x, x + 0.35 * rng.standard_normal((200, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scales = quantised(x)
    approximate = (codes * scales[:, :1]) @ (codes * scales[:, :1]).T
    slack = scales[:, 1:] + (1 + scales[:, 1:]) * scales[:, 1]
    assert (np.abs(approximate - x @ x.T) <= slack + 1e-5).all()


def test_empty(spark):
    assert similar_pairs(nearest(frame(spark, np.zeros((0, 16))), dimension=16)).count() == 0
    assert similar_pairs(nearest(frame(spark, np.ones((1, 16))), dimension=16)).count() == 0


def test_forest_routes_every_vector_to_one_leaf_per_tree():
    x = data(400)
    f = fit_forest(x, 3, 8)
    row, leaf, own = f.probe(x, 4)
    assert (np.bincount(row[own]) == 3).all() and (np.bincount(row) == 7).all()
    assert len({(r, l) for r, l in zip(row, leaf)}) == len(row)
    sizes = np.bincount(leaf[own], minlength=f.n_leaves)
    assert sizes.max() <= 2 * 400 / 8
