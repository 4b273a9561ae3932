import numpy as np
import pandas as pd
import pytest

from tracksmith.operators import density
from tracksmith.operators import model as mm


def silhouette(d, labels):
    known = np.unique(labels[labels >= 0])
    if len(known) < 2:
        return -1.0
    out = []
    for i in np.nonzero(labels >= 0)[0]:
        own = labels == labels[i]
        a = d[i, own].sum() / max(own.sum() - 1, 1)
        b = min(d[i, labels == k].mean() for k in known if k != labels[i])
        out.append((b - a) / max(a, b, 1e-12) if own.sum() > 1 else 0.0)
    return float(np.mean(out))


def dense(d, eps, min_samples=4):
    near = d <= eps
    core = near.sum(1) >= min_samples
    labels, number = np.full(len(d), -1), 0
    for i in np.nonzero(core)[0]:
        if labels[i] < 0:
            todo = [i]
            labels[i] = number
            while todo:
                k = todo.pop()
                if core[k]:
                    fresh = np.nonzero(near[k] & (labels < 0))[0]
                    labels[fresh] = number
                    todo += fresh.tolist()
            number += 1
    return labels


def brute(v):
    d = np.stack([np.abs(v - row).mean(1) for row in v])
    steps = np.unique(np.quantile(d, np.linspace(0.005, 0.6, 60)))
    tried = {dense(d, e).tobytes(): dense(d, e) for e in (steps[steps > 0] if (steps > 0).any() else [1e-9])}
    scores = [silhouette(d, x) for x in tried.values()]
    return list(tried.values())[int(np.argmax(scores)) if max(scores) > -1 else -1]


def same(a, b):
    """The same groups and the same noise, whatever the numbers."""
    return len(set(zip(a, b))) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in zip(a, b))


def labels_of(spark, v):
    rows = pd.DataFrame({"user_id": np.repeat(np.arange(len(v)), v.shape[1]), "share": v.ravel()})
    got = mm.cluster_trajectories(spark.createDataFrame(rows)).toPandas().sort_values("user_id")
    assert got["user_id"].tolist() == list(range(len(v)))
    return got["cluster"].to_numpy()


@pytest.mark.parametrize("seed", range(2))
def test_density_against_brute_force(spark, monkeypatch, seed):
    # small blocks and many tasks, so that links and sums are put together from parts
    monkeypatch.setattr(density, "OF_TASK", 4000)
    rng = np.random.default_rng(seed)
    centre = rng.random((4, 12))
    v = np.concatenate([np.clip(c + rng.normal(0, s, (n, 12)), 0, 1) for c, s, n in zip(centre, (0.02, 0.05, 0.1, 0.02), (60, 60, 60, 5))] + [rng.random((40, 12))])
    v = np.sort(np.concatenate([v, v[:30], v[:10]]), axis=1)
    distinct, at, w = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    got = density.density_labels(spark, distinct, w, 4)[at.ravel()]
    # cluster numbers and border rows go by the first core row
    order = np.argsort(at.ravel(), kind="stable")
    assert got[order].tolist() == brute(v[order]).tolist()
    assert got.max() >= 1 and (got == -1).any()


def test_a_cluster_of_few_among_very_many_users(spark):
    rng = np.random.default_rng(5)
    many, few = np.linspace(0, 0.1, 8), np.linspace(0.9, 0.99, 8)
    # 2,995 users in two rhythms, and four of a rhythm of their own
    v = np.concatenate([many + rng.integers(0, 8, (1500, 1)) / 1000, 0.3 + many + rng.integers(0, 8, (1495, 1)) / 1000, np.tile(few, (4, 1))])
    got = labels_of(spark, np.sort(v, axis=1))
    assert len(set(got[-4:])) == 1 and got[-1] >= 0 and (got == got[-1]).sum() == 4
    assert len(set(got)) == 3


@pytest.mark.parametrize("n", [1, 3, 5])
def test_all_users_alike(spark, n):
    got = labels_of(spark, np.tile(np.linspace(0, 1, 6), (n, 1)))
    assert got.tolist() == [0 if n >= 4 else -1] * n
