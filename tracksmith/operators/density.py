"""Density clusters (DBSCAN) of vectors over all pairs, at the radius of the best silhouette."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins of equal width in which distances are counted before the exact values of a few of them are looked up.
BINS = 1 << 20
#: Distances held at once, and distances of a task as far as tasks are many enough.
HELD, OF_TASK, TASKS = 2_000_000, 5_000_000, 256
_NEVER = 255


def _blocks(v: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """``first, d``: mean absolute differences of a few rows from ``first`` on to all rows, from row ``lo`` to before ``hi``."""
    n, size = v.shape
    rows = max(1, HELD // n)
    part = max(1, 100_000 // size)
    held = np.empty((part, size))
    for first in range(lo, hi, rows):
        d = np.empty((min(first + rows, hi) - first, n))
        for i, row in enumerate(v[first : first + len(d)]):
            for a in range(0, n, part):
                x = held[: min(part, n - a)]
                np.abs(np.subtract(v[a : a + part], row, out=x), out=x)
                d[i, a : a + part] = x.mean(1)
        yield first, d


def _bins(d: np.ndarray, scale: float) -> np.ndarray:
    return np.minimum((d * scale).astype(np.int64), BINS - 1)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _counted(v, w, lo, hi, scale):
    total = np.zeros(BINS)
    for first, d in _blocks(v, lo, hi):
        total += np.bincount(_bins(d, scale).ravel(), (w[first : first + len(d), None] * w).ravel(), BINS)
    known = np.nonzero(total)[0]
    yield _batch(bin=known, n=total[known].astype(np.int64))


def _nearest(v, w, lo, hi, k):
    for first, d in _blocks(v, lo, hi):
        at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        far = np.take_along_axis(d, at, 1)
        yield _batch(row=np.repeat(np.arange(first, first + len(d)), at.shape[1]), other=at.ravel().astype(np.int64), far=far.ravel())


def _valued(v, w, lo, hi, asked):
    scale, wanted = asked
    for first, d in _blocks(v, lo, hi):
        i, j = np.nonzero(wanted[_bins(d, scale)])
        values, place = np.unique(d[i, j], return_inverse=True)
        yield _batch(value=values, n=np.bincount(place, w[first + i] * w[j], len(values)).astype(np.int64))


def _join(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components with the given links added; a component is named after its least node."""
    while True:
        a, b = comp[a], comp[b]
        apart = a != b
        if not apart.any():
            return comp
        a, b = a[apart], b[apart]
        comp = comp.copy()
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(comp, up := comp[comp]):
            comp = up


def _levels(n: int, levels: int, links: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each level the components up to it, and those nodes that ceased to be the least of theirs."""
    comp = np.arange(n)
    for level in range(levels):
        new = _join(comp, *links(level))
        yield level, new, np.nonzero((comp == np.arange(n)) & (new != np.arange(n)))[0]
        comp = new


def _forest(n: int, levels: int, links: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most n - 1 links, each with its level, that join at every level what the given links join."""
    found = [(np.full(len(gone), level, np.int32), gone, comp[gone]) for level, comp, gone in _levels(n, levels, links)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _by_level(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> Callable:
    order = np.argsort(level, kind="stable")
    level, a, b = level[order], a[order], b[order]

    def links(at: int):
        s = slice(*np.searchsorted(level, [at, at + 1]))
        return a[s], b[s]

    return links


def _linked(v, w, lo, hi, asked):
    """Links between core rows: two are linked at the first radius that holds their distance and both core distances."""
    steps, core = asked
    n, parts = len(v), []
    for first, d in _blocks(v, lo, hi):
        np.maximum(np.maximum(d, core, out=d), core[first : first + len(d), None], out=d)
        at = np.searchsorted(steps, d.ravel()).astype(np.uint8)

        def links(level, at=at, first=first):
            hit = np.nonzero(at == level)[0]
            return first + hit // n, hit % n

        parts.append(_forest(n, len(steps), links))
    level, a, b = _forest(n, len(steps), _by_level(*(np.concatenate(x) for x in zip(*parts))))
    yield _batch(level=level, a=a, b=b)


def _scored(v, w, lo, hi, labels):
    """Sum of the silhouettes of the rows at each labelling; noise is left out."""
    sums = np.zeros(len(labels))
    plans = []
    for of in labels:
        order = np.argsort(of, kind="stable")
        order = order[np.searchsorted(of[order], 0) :]
        starts = np.searchsorted(of[order], np.arange(of.max() + 1))
        plans.append((order, starts, np.add.reduceat(w[order], starts)))
    for first, d in _blocks(v, lo, hi):
        d *= w
        for k, (of, (order, starts, sizes)) in enumerate(zip(labels, plans)):
            own = of[first : first + len(d)]
            there = np.nonzero(own >= 0)[0]
            if not len(there):
                continue
            own = own[there]
            near = np.add.reduceat(d[there][:, order], starts, axis=1)
            at = np.arange(len(there))
            a = near[at, own] / np.maximum(sizes[own] - 1, 1)
            others = near / sizes
            others[at, own] = np.inf
            b = others.min(1)
            s = np.where(sizes[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
            sums[k] += (s * w[first + there]).sum()
    yield _batch(lo=np.full(len(sums), lo, np.int64), labelling=np.arange(len(sums)), score=sums)


def _quantiles(counts: np.ndarray, value_of: Callable, q: np.ndarray) -> np.ndarray:
    """Quantiles (linear between neighbours) of counted values; ``value_of`` gives the values of ranks."""
    at = q * (counts.sum() - 1)
    low = np.floor(at).astype(np.int64)
    t = at - low
    a, b = value_of(low), value_of(np.minimum(low + 1, int(counts.sum()) - 1))
    return np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))


def density_labels(spark: SparkSession, v: np.ndarray, w: np.ndarray, min_samples: int) -> np.ndarray:
    """Cluster of every row of ``v``, which stands for ``w`` equal ones; -1 is noise.

    The radius is the one of the best silhouette among 60 quantiles of the distances of all pairs (0.5 to 60 %); if none
    gives two clusters, the widest. Clusters are numbered by their first core row; a row within reach of several
    clusters, but not core, goes to the first.

    Exact over all pairs, in four passes of blocks of rows against all rows: distances are counted in narrow bins, the
    few bins that hold a quantile are looked up value by value, links are reduced to forests, one level for each radius,
    and silhouettes are summed. The rows go to all executors; no distances of all pairs are ever kept.
    """
    n, sc = len(v), spark.sparkContext
    w = w.astype(float)
    shared = sc.broadcast((v, w))
    tasks = max(1, min(TASKS, n, n * n // OF_TASK))

    def against_all(each: Callable, asked, schema: str) -> DataFrame:
        told = sc.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    yield from each(*shared.value, t * n // tasks, (t + 1) * n // tasks, told.value)

        return spark.range(0, tasks, 1, tasks).mapInArrow(run, schema)

    def columns(df: DataFrame) -> list[np.ndarray]:
        return [c.to_numpy() for c in df.toArrow().columns]

    # the core distance: how far it is to the min_samples-th row, itself included
    row, other, far = columns(against_all(_nearest, min_samples, "row long, other long, far double"))
    order = np.lexsort((other, far, row))
    k = len(row) // n
    other, far = other[order].reshape(n, k), far[order].reshape(n, k)
    enough = np.cumsum(w[other], axis=1) >= min_samples
    core = np.where(enough.any(1), far[np.arange(n), enough.argmax(1)], np.inf)

    scale = BINS / max(float(v.max() - v.min()), 1e-12)
    bins, amounts = columns(against_all(_counted, scale, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")))
    counts = np.zeros(BINS, np.int64)
    counts[bins] = amounts
    upto = np.cumsum(counts)
    q = np.linspace(0.005, 0.6, 60)
    wanted = np.zeros(BINS, bool)

    def mark(ranks: np.ndarray) -> np.ndarray:
        wanted[np.searchsorted(upto, ranks, "right")] = True
        return np.zeros(len(ranks))

    _quantiles(counts, mark, q)
    values, amounts = columns(against_all(_valued, (scale, wanted), "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy("value"))
    # ranks among the looked-up values: those of all values less the bins between that were not looked up
    left_out = np.cumsum(np.where(wanted, 0, counts))
    looked_up = np.cumsum(amounts)
    steps = np.unique(_quantiles(counts, lambda r: values[np.searchsorted(looked_up, r - left_out[np.searchsorted(upto, r, "right")], "right")], q))
    steps = steps[steps > 0] if (steps > 0).any() else np.array([1e-9])

    links = "level int, a long, b long"
    linked = against_all(_linked, (steps, core), links)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches]
        if held:
            level, a, b = _forest(n, len(steps), _by_level(*(np.concatenate(x) for x in zip(*held))))
            yield _batch(level=level, a=a, b=b)

    forest = columns(linked.repartition(8).mapInArrow(merge, links) if tasks > 8 else linked)
    labellings: dict[bytes, np.ndarray] = {}
    for level, comp, _ in _levels(n, len(steps), _by_level(*forest)):
        is_core = core <= steps[level]
        labels = np.full(n, -1, np.int64)
        labels[is_core] = np.unique(comp[is_core], return_inverse=True)[1]
        # a row that is not core has fewer than min_samples rows within reach, all of them among its nearest
        reached = (far <= steps[level]) & is_core[other]
        first = np.where(reached, labels[other], n).min(1)
        labels = np.where(is_core | (first == n), labels, first)
        labellings.setdefault(labels.tobytes(), labels)
    several = [x for x in labellings.values() if x.max() >= 1]
    if not several:
        return labels
    lo, labelling, score = columns(against_all(_scored, several, "lo long, labelling long, score double"))
    order = np.lexsort((lo, labelling))
    scores = [math.fsum(s) / w[x >= 0].sum() for s, x in zip(score[order].reshape(len(several), -1), several)]
    return several[int(np.argmax(scores))]
