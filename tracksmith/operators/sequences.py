"""Symbol sequences: entropy and predictability (IM15-IM23), and how much of one sequence recurs in another (IM26-IM30).

A sequence is a user's ``labels`` in order of time. Where only equal symbols matter, sequences are joined with
themselves on (user, label), so that only matching pairs are made. A user with too many pairs (few symbols, many
records) goes through a kernel instead, one array of integers per user.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.measures import num_of_distinct_locations, random_entropy, unc_entropy
from tracksmith.operators.trajectory import in_time

#: Matching pairs of a user beyond which the kernel takes over.
PAIRS = 2_000_000


def positions(df: DataFrame) -> DataFrame:
    """``user_id, i, labels``: the symbols with their places from 1, nulls left out."""
    there = df.where(F.col("labels").isNotNull())
    return there.select("user_id", F.row_number().over(in_time(there)).alias("i"), F.col("labels").cast("long").alias("labels"))


def _pairs_of(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many equal pairs each user has: ``user_id, pairs``."""
    counts = lambda df, c: df.groupBy("user_id", "labels").agg(F.count(F.lit(1)).alias(c))
    return counts(left, "a").join(counts(right, "b"), ["user_id", "labels"]).groupBy("user_id").agg(F.sum(F.col("a") * F.col("b")).alias("pairs"))


def _split(df: DataFrame, pairs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    many = pairs.where(F.col("pairs") > limit).select("user_id")
    return df.join(many, "user_id", "left_anti"), df.join(many, "user_id", "left_semi")


def match_lengths_of(symbols: list[int]) -> list[int]:
    """1 + length of the longest part that begins at each place and occurs whole before it.

    In time proportional to the length: a suffix automaton of what lies before grows along, and the part at the next
    place is at most one shorter, so the match only loses its first symbol and goes on from there.
    """
    follow: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = state = k = 0
    out, n = [], len(symbols)
    for i in range(n):
        if k:
            k -= 1
            if longest[link[state]] >= k:
                state = link[state]
            if not k:
                state = 0
        while i + k < n and symbols[i + k] in follow[state]:
            state = follow[state][symbols[i + k]]
            k += 1
        out.append(k + 1)
        # the symbol at i now lies before
        c, new = symbols[i], len(follow)
        follow.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
                if state == q and k <= longest[clone]:
                    state = clone
        last = new
    return out


def match_lengths(df: DataFrame, max_pairs: int = PAIRS) -> DataFrame:
    """IM17: ``user_id, i, length``: Lempel-Ziv match length at every symbol, nulls left out."""
    seq = positions(df)
    short, long = _split(seq, _pairs_of(seq, seq), 2 * max_pairs)
    a, b = short.alias("a"), short.alias("b")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.labels") == F.col("b.labels")) & (F.col("b.i") < F.col("a.i")))
    pairs = pairs.select(F.col("a.user_id").alias("user_id"), F.col("a.i").alias("i"), (F.col("a.i") - F.col("b.i")).alias("d"))
    w = Window.partitionBy("user_id", "d").orderBy("i")
    runs = pairs.withColumn("island", F.col("i") - F.row_number().over(w))
    runs = runs.withColumn("end", F.max("i").over(Window.partitionBy("user_id", "d", "island")))
    best = runs.groupBy("user_id", "i").agg(F.max(F.least(F.col("end") - F.col("i") + 1, F.col("d"))).alias("m"))
    joined = short.join(best, ["user_id", "i"], "left").select("user_id", "i", (F.lit(1) + F.coalesce("m", F.lit(0))).cast("long").alias("length"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"user_id": pdf["user_id"], "i": pdf["i"], "length": match_lengths_of(pdf["labels"].tolist())})

    kind = dict(df.dtypes)["user_id"]
    return joined.unionByName(long.groupBy("user_id").applyInPandas(kernel, f"user_id {kind}, i int, length long"))


def lz_entropy(df: DataFrame, max_pairs: int = PAIRS) -> DataFrame:
    """IM15: log2(n) over the mean match length, n counting the nulls too; null for a user without symbols."""
    n = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mean = match_lengths(df, max_pairs).groupBy("user_id").agg(F.avg("length").alias("mean"))
    return n.join(mean, "user_id", "left").select("user_id", (F.log2("n") / F.col("mean")).alias("value"))


def _entropy_of(symbols: list, n: int) -> float:
    lengths = match_lengths_of(symbols)
    return math.log2(n) / (sum(lengths) / len(lengths)) if lengths and n > 1 else 0.0


def _unc_of(symbols: list, n: int) -> float:
    counts = np.unique(np.array(symbols), return_counts=True)[1] / n
    return float(-(counts * np.log2(counts)).sum())


def fit_exponential(q: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """IM18: a, b, c of a * exp(b q) + c by damped least squares from (0.1, 2, 0.1); nothing if that fails."""
    p, damp = np.array([0.1, 2.0, 0.1]), 1e-3
    f = lambda p: p[0] * np.exp(p[1] * q) + p[2]
    if len(q) < 3:
        return None
    with np.errstate(all="ignore"):
        error = ((f(p) - y) ** 2).sum()
        for _ in range(500):
            e = np.exp(p[1] * q)
            j = np.column_stack([e, p[0] * q * e, np.ones_like(q)])
            h = j.T @ j
            try:
                step = np.linalg.solve(h + damp * np.diag(np.diag(h)) + 1e-12 * np.eye(3), j.T @ (y - f(p)))
            except np.linalg.LinAlgError:
                return None
            new = ((f(p + step) - y) ** 2).sum()
            if np.isfinite(new) and new <= error:
                done = error - new <= 1e-14 * max(error, 1e-14)
                p, error, damp = p + step, new, damp / 3
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
    return tuple(p) if np.isfinite(p).all() else None


def scaled_entropy_of(labels: list, seed: int, estimation_method: str = "unc") -> float | None:
    """IM16: entropy of a sequence with missing symbols (None), carried back to none missing.

    Up to 15 % missing it is taken as it is, beyond 90 % there is none. Between, more symbols are taken out in steps of
    5 %; how the entropy relates to the baseline's is fitted over the share missing and read at 0. A line takes the place
    of the curve only where the fit fails.
    """
    n = len(labels)
    there = [k for k, s in enumerate(labels) if s is not None]
    q = 1 - len(there) / n if n else 1.0
    if q > 0.9 or not there:
        return None
    symbols = [labels[k] for k in there]
    if q < 0.15:
        return _entropy_of(symbols, n)
    rng = np.random.default_rng(seed)
    if estimation_method == "unc":
        baseline = _unc_of
    elif estimation_method == "shuff":
        baseline = lambda s, n: _entropy_of(rng.permutation(np.array(s)).tolist(), n)
    else:
        raise ValueError("estimation_method is 'unc' or 'shuff'")
    base = baseline(symbols, n)
    shares, features = [], []
    for x in range(1, math.ceil((0.9 - q) / 0.05)):
        gone = min(round(0.05 * x * n), len(there) - 2)
        if gone < 0:
            break
        kept = np.sort(rng.permutation(len(there))[gone:])
        rest = [symbols[k] for k in kept]
        a, b = _entropy_of(rest, n), baseline(rest, n)
        if a > 0 and b > 0:
            shares.append(1 - len(rest) / n)
            features.append(math.log2(a / b))
    if base <= 0 or len(shares) < 2:
        return _entropy_of(symbols, n)
    shares, features = np.array(shares), np.array(features)
    fitted = fit_exponential(shares, features)
    at0 = fitted[0] + fitted[2] if fitted else float(np.polyfit(shares, features, 1)[1])
    value = 2.0**at0 * base
    return value if math.isfinite(value) else 2.0 ** float(np.polyfit(shares, features, 1)[1]) * base


def real_entropy(df: DataFrame, seed: int = 0, estimation_method: str = "unc") -> DataFrame:
    """IM19: IM16 of every user; a user's symbols are held in one task."""
    order = ["datetime", *(["seq"] if "seq" in df.columns else [])]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        labels = [None if pd.isna(s) else int(s) for s in pdf["labels"]]
        user = pdf["user_id"].iloc[0]
        own = int(pd.util.hash_array(np.array([str(user)], object))[0] % 2**32)
        value = scaled_entropy_of(labels, seed ^ own, estimation_method)
        return pd.DataFrame({"user_id": [user], "value": [value]}).astype({"value": "float64"})

    out = df.select("user_id", *order, "labels").groupBy("user_id").applyInPandas(kernel, f"user_id {dict(df.dtypes)['user_id']}, value double")
    return out.select("user_id", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def fano(n: Column, entropy: Column, steps: int = 60) -> Column:
    """IM20: the predictability x for which H(x) + (1 - x) log2(n - 1) is the entropy.

    1 for a single place or no entropy, 1/n where the entropy is log2 n or more, null without entropy. Found by halving
    [1/n, 1], on which the left side falls; all rows of a batch at once.
    """

    @F.pandas_udf("double")
    def solve(n: pd.Series, s: pd.Series) -> pd.Series:
        n, s = n.to_numpy(float), s.to_numpy(float)
        with np.errstate(all="ignore"):
            lo, hi = 1 / n, np.ones_like(n)
            for _ in range(steps):
                x = (lo + hi) / 2
                g = -(x * np.log2(x) + np.where(x < 1, (1 - x) * np.log2(np.where(x < 1, 1 - x, 1)), 0)) + (1 - x) * np.log2(np.maximum(n - 1, 1))
                lo, hi = np.where(g > s, x, lo), np.where(g > s, hi, x)
            out = np.where((n <= 1) | (s <= 0), 1.0, np.where(s >= np.log2(n), 1 / n, (lo + hi) / 2))
        return pd.Series(np.where(np.isnan(s) | np.isnan(n), np.nan, out))

    value = solve(n.cast("double"), entropy)
    return F.when(entropy.isNotNull() & ~F.isnan(value), value)


def _predictability(df: DataFrame, entropy: DataFrame) -> DataFrame:
    n = num_of_distinct_locations(df).select("user_id", F.col("value").alias("n_locations"))
    both = n.join(entropy.withColumnRenamed("value", "entropy"), "user_id")
    return both.withColumn("predictability", fano(F.col("n_locations"), F.col("entropy")))


def random_predictability(df: DataFrame) -> DataFrame:
    """IM21: ``user_id, n_locations, entropy, predictability``."""
    return _predictability(df, random_entropy(df))


def unc_predictability(df: DataFrame) -> DataFrame:
    """IM22"""
    return _predictability(df, unc_entropy(df))


def real_predictability(df: DataFrame, seed: int = 0) -> DataFrame:
    """IM23"""
    return _predictability(df, real_entropy(df, seed))


# -- one sequence in another ------------------------------------------------------------------------------------------


def _sizes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Users of either side and the length of their test sequence."""
    return train.select("user_id").distinct().join(test.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "full")


def _scaled(best: DataFrame, train: DataFrame, test: DataFrame, compat: bool) -> DataFrame:
    """(c - 1) / (n - 1), at least 0; null where a side is missing or n is 1. ``compat``: c - 1/n - 1."""
    users = _sizes(train, test).join(train.select("user_id").distinct().withColumn("_t", F.lit(True)), "user_id", "left").join(best, "user_id", "left")
    c = F.coalesce("c", F.lit(0))
    value = c - F.lit(1) / F.col("n") - 1 if compat else F.greatest(c - 1, F.lit(0)) / F.when(F.col("n") > 1, F.col("n") - 1)
    return users.select("user_id", F.when(F.col("_t") & F.col("n").isNotNull(), value).cast("double").alias("value"))


def _diagonals(train: DataFrame, test: DataFrame, max_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matching places of both sides, and the sequences of the users with too many of them."""
    pairs = _pairs_of(train, test)
    short, long = _split(test, pairs, max_pairs)
    b = train.withColumnRenamed("i", "j")
    return short.join(b, ["user_id", "labels"]).select("user_id", "i", (F.col("i") - F.col("j")).alias("d")), train.join(long.select("user_id").distinct(), "user_id", "left_semi"), long


def _cogroup(train: DataFrame, test: DataFrame, kernel) -> DataFrame:
    """A number per user from both sequences, as lists of symbols."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"user_id": pd.Series([], dtype=left["user_id"].dtype if len(left) else right["user_id"].dtype), "c": pd.Series([], dtype=float)})
        return pd.DataFrame({"user_id": [left["user_id"].iloc[0]], "c": [float(kernel(left.sort_values("i")["labels"].tolist(), right.sort_values("i")["labels"].tolist()))]})

    kind = dict(train.dtypes)["user_id"]
    # both may come from one table; new names keep their columns apart
    train, test = (df.select(*(F.col(c).alias(c) for c in ("user_id", "i", "labels"))) for df in (train, test))
    return train.groupBy("user_id").cogroup(test.groupBy("user_id")).applyInPandas(run, f"user_id {kind}, c double")


def common_substring(a: list, b: list) -> int:
    best, row = 0, np.zeros(len(b) + 1, np.int64)
    bs = np.array(b)
    for s in a:
        row[1:] = np.where(bs == s, row[:-1] + 1, 0)
        best = max(best, int(row.max()))
    return best


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence; a row of the table at a time."""
    row, bs = np.zeros(len(b) + 1, np.int64), np.array(b)
    for s in a:
        new = row.copy()
        new[1:] = np.where(bs == s, row[:-1] + 1, row[1:])
        row = np.maximum.accumulate(new)
    return int(row[-1])


def shifted_matches(a: list, b: list) -> int:
    at, counts = {}, {}
    for j, s in enumerate(a):
        at.setdefault(s, []).append(j)
    for i, s in enumerate(b):
        for j in at.get(s, ()):
            counts[i - j] = counts.get(i - j, 0) + 1
    return max(counts.values(), default=0)


def repeatability_dense(train: DataFrame, test: DataFrame, compat: bool = False, max_pairs: int = PAIRS) -> DataFrame:
    """IM26: longest run of the test sequence that occurs in the train sequence."""
    a, b = positions(train), positions(test)
    pairs, many_a, many_b = _diagonals(a, b, max_pairs)
    island = F.col("i") - F.row_number().over(Window.partitionBy("user_id", "d").orderBy("i"))
    best = pairs.withColumn("r", island).groupBy("user_id", "d", "r").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.max("c").cast("double").alias("c"))
    return _scaled(best.unionByName(_cogroup(many_a, many_b, common_substring)), a, b, compat)


def repeatability_sparse(train: DataFrame, test: DataFrame, compat: bool = False) -> DataFrame:
    """IM27: longest common subsequence."""
    a, b = positions(train), positions(test)
    return _scaled(_cogroup(a, b, common_subsequence), a, b, compat)


def repeatability_equally_sparse(train: DataFrame, test: DataFrame, max_pairs: int = PAIRS) -> DataFrame:
    """IM28: most matches at one distance between both."""
    a, b = positions(train), positions(test)
    pairs, many_a, many_b = _diagonals(a, b, max_pairs)
    best = pairs.groupBy("user_id", "d").count().groupBy("user_id").agg(F.max("count").cast("double").alias("c"))
    return _scaled(best.unionByName(_cogroup(many_a, many_b, shifted_matches)), a, b, False)


def align(a: list, b: list) -> tuple[float, list[int]]:
    """Global alignment: match 1, mismatch -1, a gap of any length -1, gaps at the ends free.

    The score, and for every symbol of ``b`` the place of its partner in ``a`` or -1.
    """
    n, m = len(a), len(b)
    low = -1e9
    # best score up to (i, j): ending in a pair, in a gap of b (a symbol of a alone), in a gap of a (a symbol of b alone)
    pair, up, left = (np.full((n + 1, m + 1), low) for _ in range(3))
    pair[0, 0] = 0
    up[1:, 0] = 0
    left[0, 1:] = 0
    bs = np.array(b, object)
    for i in range(1, n + 1):
        best = np.maximum(np.maximum(pair[i - 1], up[i - 1]), left[i - 1])
        pair[i, 1:] = best[:-1] + np.where(bs == a[i - 1], 1, -1)
        opened = np.ones(m + 1)
        opened[m] = 0
        up[i, 1:] = np.maximum(np.maximum(pair[i - 1, 1:], left[i - 1, 1:]) - opened[1:], up[i - 1, 1:])
        cost = 0 if i == n else 1
        left[i, 1:] = np.maximum.accumulate(np.maximum(pair[i, :-1], up[i, :-1]) - cost)
    i, j, partner = n, m, [-1] * m
    state = int(np.argmax([pair[n, m], up[n, m], left[n, m]]))
    score = float(max(pair[n, m], up[n, m], left[n, m]))
    while i > 0 and j > 0:
        if state == 0:
            partner[j - 1] = i - 1
            i, j = i - 1, j - 1
            state = int(np.argmax([pair[i, j], up[i, j], left[i, j]]))
        elif state == 1:
            opened = max(pair[i - 1, j], left[i - 1, j]) - (0 if j == m else 1)
            same = up[i - 1, j] >= opened
            i -= 1
            state = 1 if same else int(np.argmax([pair[i, j], low, left[i, j]]))
        else:
            opened = max(pair[i, j - 1], up[i, j - 1]) - (0 if i == n else 1)
            same = left[i, j - 1] >= opened
            j -= 1
            state = 2 if same else int(np.argmax([pair[i, j], up[i, j], low]))
    return score, partner


def aligned_again(a: list, b: list) -> float:
    """Alignment score less 1, plus that of the longest piece of ``b`` left without partners, aligned anew, and so on."""
    total, piece = 0.0, b
    while len(piece) > 1:
        score, partner = align(a, piece)
        if score <= 0:
            break
        total += score - 1
        spans, start = [], None
        for k, p in enumerate([*partner, 0]):
            if p < 0 and start is None:
                start = k
            elif p >= 0 and start is not None:
                spans.append((start, k))
                start = None
        # the longest; of equals the one at the end, then the one at the beginning, then the first
        if not spans:
            break
        s, e = max(spans, key=lambda x: (x[1] - x[0], x[1] == len(piece), x[0] == 0, -x[0]))
        if e - s == len(piece):
            break
        piece = piece[s:e]
    return total


def global_alignment(train: DataFrame, test: DataFrame) -> DataFrame:
    """IM29: alignment score over n - 1."""
    a, b = positions(train), positions(test)
    return _per_step(_cogroup(a, b, lambda x, y: align(x, y)[0]), a, b)


def iterative_global_alignment(train: DataFrame, test: DataFrame) -> DataFrame:
    """IM30: sum of the scores less 1 of repeated alignments, over n - 1."""
    a, b = positions(train), positions(test)
    return _per_step(_cogroup(a, b, aligned_again), a, b)


def _per_step(score: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    users = _sizes(train, test).join(score, "user_id", "left")
    return users.select("user_id", (F.col("c") / F.when(F.col("n") > 1, F.col("n") - 1)).alias("value"))
