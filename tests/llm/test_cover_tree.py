"""Cover-tree links against all pairs."""

import numpy as np
import pytest

from fleetlens.llm import cover_tree, queries

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, labels, cosine=0.93):
    n = len(ids)
    ok = [labels[i] is not None and vectors[i] is not None and len(vectors[i]) > 0
          and all(c is not None and np.isfinite(c) for c in vectors[i]) and any(c != 0 for c in vectors[i]) for i in range(n)]
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    root[x] = y
    low = {}
    for i in range(n):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((-1 if ids[i] is None else ids[i], links[i], low.get(find(i), -1)) for i in range(n))


def _got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


def _clusters(rng, n=300, dim=12):
    centers = rng.standard_normal((6, dim))
    x = [c + rng.standard_normal(dim) * rng.choice([0.02, 0.15, 0.3]) * np.linalg.norm(c) / np.sqrt(dim) for c in centers for _ in range(n // 12)]
    return np.array(x + list(rng.standard_normal((n - len(x), dim))))


@pytest.mark.parametrize("seed", range(4))
def test_link_blocks_match_all_pairs(seed):
    rng = np.random.default_rng(seed)
    x = _clusters(rng)
    x = np.concatenate([x, x[:3] * 2])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = rng.integers(1, 4, len(x))
    full = x @ x.T >= 0.93
    total, root = cover_tree.link_blocks(x, size)
    assert (total == full @ size).all()
    cut = 170
    across, root2 = cover_tree.link_blocks(x[:cut], size[:cut], x[cut:], size[cut:])
    assert (across[:cut] == full[:cut, cut:] @ size[cut:]).all() and (across[cut:] == size[:cut] @ full[:cut, cut:]).all()
    same = lambda root, m: all(root[i] == root[j] for i, j in zip(*np.nonzero(m)))
    assert same(root, full)
    cross = full.copy()
    cross[:cut, :cut] = cross[cut:, cut:] = False
    assert same(root2, cross)
    seen = np.eye(len(x), dtype=bool) | full  # nothing is joined without links
    for _ in range(9):
        seen = seen.astype(int) @ seen.astype(int) > 0
    assert (np.equal.outer(root, root) == seen).all()


def test_tree_invariants():
    x = _clusters(np.random.default_rng(9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover_tree.Tree(x)
    assert sorted(t.order) == list(range(len(x)))
    for k, kids in enumerate(t.kids):
        members = t.order[slice(*t.span[k])]
        far = np.linalg.norm(x[members] - x[t.center[k]], axis=1)
        assert far.max() == pytest.approx(t.radius[k], abs=1e-12)
        if kids:
            assert t.center[kids[0]] == t.center[k]  # nested
            assert all(t.radius[c] <= 2.0 ** np.ceil(np.log2(t.radius[k])) / 2 + 1e-12 for c in kids)


@pytest.mark.parametrize("block", [2048, 20])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = _clusters(rng, 160)
    vectors = [v.tolist() for v in x] + [x[0].tolist()] * 30 + [(x[1] * 3).tolist(), (x[2] * 1e-200).tolist()]
    labels = [int(k) for k in rng.integers(0, 2, len(x))] + [1] * 32
    vectors += [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0], [1.0, 2.0], x[5].tolist()]
    labels += [1] * 8 + [None]
    ids = list(range(100, 100 + len(vectors)))
    ids[3], ids[7] = ids[4], None
    df = spark.createDataFrame(list(zip(ids, vectors, labels, labels)), "vec_id long, embedding array<double>, label int, key int")
    assert _got(cover_tree.near_duplicates(df)) == brute(ids, vectors, labels)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = queries.op5_cover_tree(spark, SF)
    assert _got(got) == brute([r.vec_id for r in rows], [r.embedding for r in rows], [r.label for r in rows])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_empty_table(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_many_cells_and_string_ids(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 60)
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((40, 16))
    x = np.concatenate([np.repeat(centers, 30, axis=0) + 0.3 * rng.standard_normal((1200, 16)), rng.standard_normal((300, 16))])
    ids, labels = [f"v-{i:04}" for i in range(len(x))], [0] * 1400 + [1] * 100
    df = spark.createDataFrame(list(zip(ids, x.tolist(), labels)), "vec_id string, embedding array<double>, label int")
    got = sorted(tuple(r) for r in cover_tree.near_duplicates(df).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & np.equal.outer(labels, labels)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(linked, root[None, :], len(x)).min(axis=1)
        if (new == root).all():
            break
        root = new
    assert linked.sum() > len(x) * 2
    assert got == [(ids[i], int(linked[i].sum()) - 1, ids[root[i]]) for i in range(len(x))]
