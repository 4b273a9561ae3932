"""Next-place prediction (PD1-PD25). Sequences are ``labels`` in order of time; nulls are left out first.

Windows, splits, Markov chains and the simple predictors are joins and aggregations. The pattern predictor, roll-outs and
trained models take one user's sequence at a time.
"""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.operators.trajectory import in_time


def sequence(df: DataFrame) -> DataFrame:
    """``user_id, i, n, datetime, labels``: places from 1, and the length."""
    there = df.where(F.col("labels").isNotNull())
    return there.select(
        "user_id", F.row_number().over(in_time(there)).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"), "datetime", F.col("labels").cast("int").alias("labels")
    )


def windows(df: DataFrame, horizon: int = 1) -> DataFrame:
    """PD2: ``user_id, w, m, datetime, x1..xh, y``: ``horizon`` symbols and the one after them, whose time it is."""
    if horizon < 1:
        raise ValueError("horizon is at least 1")
    seq = sequence(df)
    w = Window.partitionBy("user_id").orderBy("i")
    xs = [F.lead("labels", k).over(w).alias(f"x{k + 1}") for k in range(horizon)]
    out = seq.select("user_id", F.col("i").alias("w"), (F.col("n") - horizon).alias("m"), F.lead("datetime", horizon).over(w).alias("datetime"), *xs, F.lead("labels", horizon).over(w).alias("y"))
    return out.where(F.col("w") <= F.col("m"))


def splitter(df: DataFrame, split_ratio: float = 0.2, horizon: int = 1, n_splits: int = 1) -> DataFrame:
    """PD1, PD3, PD4: windows with ``role`` and ``fold``.

    The last share ``split_ratio`` of a user's windows is ``test`` (fold 0); rounding is half to even. The windows before
    are in fold k of 1..n_splits ``train`` up to the share k/(n_splits + 1), and ``val`` up to the next one.
    """
    train = F.bround(F.col("m") * F.lit(1 - split_ratio))
    rows = windows(df, horizon).withColumn("_v", train)
    edge = lambda k: F.bround(F.col("_v") * k / F.lit(n_splits + 1))
    folds = F.transform(F.sequence(F.lit(1), F.lit(n_splits)), lambda k: F.struct(k.alias("fold"), F.when(F.col("w") <= edge(k), "train").when(F.col("w") <= edge(k + 1), "val").alias("role")))
    roles = F.when(F.col("w") > F.col("_v"), F.array(F.struct(F.lit(0).alias("fold"), F.lit("test").alias("role")))).otherwise(F.filter(folds, lambda x: x["role"].isNotNull()))
    return rows.withColumn("_r", F.explode(roles)).select("*", "_r.role", "_r.fold").drop("_r", "_v", "m")


def split(df: DataFrame, train_size: float, state_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """PD5: the first share of every sequence, and the rest from ``state_size`` symbols earlier."""
    seq = sequence(df)
    cut = F.bround(F.col("n") * F.lit(train_size))
    return seq.where(F.col("i") <= cut), seq.where(F.col("i") > F.greatest(cut - state_size, F.lit(0)))


def markov_counts(seq: DataFrame, state_size: int) -> DataFrame:
    """PD6, PD8: ``user_id, state, next, cnt`` for the states of all lengths from 0 to ``state_size``."""
    w = Window.partitionBy("user_id").orderBy("i")
    past = F.array(*(F.lag("labels", k).over(w) for k in range(state_size, 0, -1))) if state_size else F.array().cast("array<int>")
    rows = seq.select("user_id", "i", F.min("i").over(Window.partitionBy("user_id")).alias("first"), past.alias("past"), F.col("labels").alias("next"))
    orders = F.sequence(F.lit(0), F.least(F.lit(state_size), F.col("i") - F.col("first")))
    states = rows.select("user_id", "next", F.explode(F.transform(orders, lambda k: F.slice("past", F.lit(state_size + 1) - k, k))).alias("state"))
    return states.groupBy("user_id", "state", "next").agg(F.count(F.lit(1)).alias("cnt"))


def normalize_chain(counts: DataFrame) -> DataFrame:
    """PD10: counts to probabilities, per user and state."""
    return counts.withColumn("prob", F.col("cnt") / F.sum("cnt").over(Window.partitionBy("user_id", "state")))


def uniform(seed: int, *keys) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def markov_predict(counts: DataFrame, test: DataFrame, state_size: int, sample: bool = False, seed: int = 0) -> DataFrame:
    """PD7: ``user_id, i, datetime, truth, prediction``: from the longest suffix of the true past that was seen in training.

    The most frequent follower (a tie: the smallest symbol), or with ``sample`` one drawn by its frequency. -1 if the user
    has no training sequence. The first ``state_size`` symbols of ``test`` are context only.
    """
    w = Window.partitionBy("user_id").orderBy("i")
    past = F.array(*(F.lag("labels", k).over(w) for k in range(state_size, 0, -1))) if state_size else F.array().cast("array<int>")
    cut = F.min("i").over(Window.partitionBy("user_id")) + state_size
    rows = test.select("user_id", "i", "datetime", F.col("labels").alias("truth"), past.alias("past"), cut.alias("cut")).where(F.col("i") >= F.col("cut")).drop("cut")
    suffixes = F.transform(F.sequence(F.lit(0), F.lit(state_size)), lambda k: F.struct(k.alias("k"), F.slice("past", F.lit(state_size + 1) - k, k).alias("state")))
    asked = rows.withColumn("s", F.explode(suffixes)).select("user_id", "i", "datetime", "truth", "s.k", "s.state")
    if sample:
        by = Window.partitionBy("user_id", "state")
        drawn = counts.withColumns({"hi": F.sum("cnt").over(by.orderBy("next")) / F.sum("cnt").over(by)})
        drawn = drawn.withColumn("lo", F.coalesce(F.lag("hi").over(by.orderBy("next")), F.lit(0.0)))
        asked = asked.withColumn("u", uniform(seed, "user_id", "i"))
        seen = asked.join(drawn, ["user_id", "state"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    else:
        best = counts.groupBy("user_id", "state").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "next")).alias("b")).select("user_id", "state", F.col("b.next").alias("next"))
        seen = asked.join(best, ["user_id", "state"])
    longest = seen.groupBy("user_id", "i").agg(F.max_by("next", "k").alias("prediction"))
    return rows.select("user_id", "i", "datetime", "truth").join(longest, ["user_id", "i"], "left").withColumn("prediction", F.coalesce("prediction", F.lit(-1)))


def accuracy(predictions: DataFrame, extra: int = 0) -> DataFrame:
    """``user_id, accuracy``; ``extra`` positions count as missed."""
    return predictions.groupBy("user_id").agg((F.sum((F.col("truth") == F.col("prediction")).cast("int")) / (F.count(F.lit(1)) + extra)).alias("accuracy"))


def _cogrouped(train: DataFrame, test: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over both sequences of each user that has both. New names keep apart columns that come from one table."""

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            known = left if len(left) else right
            return pd.DataFrame({"user_id": known["user_id"][:0], "i": pd.Series([], dtype="int32"), "prediction": pd.Series([], dtype="int32")})
        return run(left, right)

    left, right = (df.select(*(F.col(c).alias(c) for c in ("user_id", "i", "labels"))).groupBy("user_id") for df in (train, test))
    return left.cogroup(right).applyInPandas(both, schema)


def markov_rollout(counts_of: DataFrame, test: DataFrame, state_size: int, update: bool = False) -> DataFrame:
    """PD9: predictions that go on from themselves, starting at the end of the training sequence.

    ``counts_of`` is the training sequence. With ``update`` each prediction is also learnt from.
    """
    kind = dict(counts_of.dtypes)["user_id"]

    def run(train: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        past, ahead = train.sort_values("i")["labels"].tolist(), ahead.sort_values("i").iloc[state_size:]
        seen: dict[tuple, Counter] = defaultdict(Counter)
        learn = lambda k: [seen[tuple(past[k - o : k])].update([past[k]]) for o in range(min(state_size, k) + 1)]
        for k in range(len(past)):
            learn(k)
        out = []
        for _ in range(len(ahead)):
            states = (tuple(past[len(past) - o :]) for o in range(min(state_size, len(past)), -1, -1))
            state = next((s for s in states if s in seen), None)
            guess = -1 if state is None else min(seen[state].items(), key=lambda x: (-x[1], x[0]))[0]
            out.append(guess)
            past.append(guess)
            if update and guess >= 0:
                learn(len(past) - 1)
        return pd.DataFrame({"user_id": ahead["user_id"], "i": ahead["i"], "prediction": out})

    guesses = _cogrouped(counts_of, test, run, f"user_id {kind}, i int, prediction int")
    return test.select("user_id", "i", "datetime", F.col("labels").alias("truth")).join(guesses, ["user_id", "i"])


def markov_wrapper(df: DataFrame, test_size: float = 0.2, state_size: int = 2, update: bool = False, online: bool = True, sample: bool = False, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """PD11: predictions and accuracy per user; without ``online`` by roll-out, the context counted among the positions."""
    train, test = split(df, 1 - test_size, state_size)
    if online:
        found = markov_predict(markov_counts(train, state_size), test, state_size, sample, seed)
        return found, accuracy(found)
    found = markov_rollout(train, test, state_size, update)
    return found, accuracy(found, state_size)


def top_loc(train: DataFrame, test: DataFrame) -> DataFrame:
    """PD17: every position predicted as the user's most frequent training label (a tie: the smallest)."""
    best = train.groupBy("user_id", "labels").count().groupBy("user_id").agg(F.min(F.struct((-F.col("count")).alias("c"), "labels")).alias("b"))
    return test.select("user_id", "i", "datetime", F.col("labels").alias("truth")).join(best.select("user_id", F.col("b.labels").alias("prediction")), "user_id")


def baseline(test: DataFrame) -> DataFrame:
    """PD18: the last symbol again: for windows from ``splitter`` or ``windows``."""
    last = max((c for c in test.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return test.select("user_id", F.col("w").alias("i"), "datetime", F.col("y").alias("truth"), F.col(last).alias("prediction"))


# -- fixed-offset patterns --------------------------------------------------------------------------------------------


def shifted_patterns(lookback: list, search: list):
    """PD14, PD15: for every offset (diagonal) of ``lookback`` in ``search`` with matches: the pattern and the symbol that follows it."""
    q = len(lookback)
    for d in range(1 - q, len(search)):
        end = d + q
        if not 0 <= end < len(search):
            continue
        pattern = tuple((i - q, s) for i, s in enumerate(lookback) if 0 <= i + d < len(search) and search[i + d] == s)
        if pattern:
            yield pattern, search[end]


def sparse_model(train: list) -> dict[tuple, Counter]:
    """PD12: how often each pattern was followed by each symbol, over all splits of the sequence in two."""
    n = len(train)
    counts: dict[tuple, Counter] = defaultdict(Counter)
    for q in range(1, n // 2 + 1):
        for lookback, search in ((train[n - q :], train[: n - q]), (train[:q], train[q:])):
            for pattern, follower in shifted_patterns(lookback, search):
                counts[pattern][follower] += 1
    return counts


def sparse_guess(model: dict[tuple, Counter], context: list, length: int):
    """PD13: the symbol of the greatest sum of matched share x count x greatest recency cubed; else the most frequent symbol."""
    scores: Counter = Counter()
    for pattern, followers in model.items():
        kept = [(o, s) for o, s in pattern if -o <= len(context)]
        matched = [o for o, s in kept if context[o] == s]
        if matched:
            weight = len(matched) / len(kept) * max((length + o) ** 3 for o in matched)
            for s, c in followers.items():
                scores[s] += weight * c
    source = scores or Counter(context)
    return min(source.items(), key=lambda x: (-x[1], x[0]))[0] if source else -1


def sparse_wrapper(df: DataFrame, test_size: float = 0.2, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """PD16: predictions of every test symbol from the whole true past, and accuracy per user.

    The model of a sequence of n symbols takes n squared memory; ``max_length``, if given, has every user learn from the
    latest so many training symbols only.
    """
    train, test = split(df, 1 - test_size)
    kind = dict(df.dtypes)["user_id"]

    def run(train: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        past, ahead = train.sort_values("i")["labels"].tolist(), ahead.sort_values("i")
        known = past[-max_length:] if max_length else list(past)
        model, n = sparse_model(known), len(known)
        out = []
        for truth in ahead["labels"].tolist():
            out.append(sparse_guess(model, past, n))
            past.append(truth)
        return pd.DataFrame({"user_id": ahead["user_id"], "i": ahead["i"], "prediction": out})

    guesses = _cogrouped(train, test, run, f"user_id {kind}, i int, prediction int")
    found = test.select("user_id", "i", "datetime", F.col("labels").alias("truth")).join(guesses, ["user_id", "i"])
    return found, accuracy(found)


# -- trained models ---------------------------------------------------------------------------------------------------


def iterate_random_values(space: dict[str, list], n_check: int, seed: int = 0) -> list[dict]:
    """PD20: ``n_check`` settings drawn, with replacement, from all combinations of a parameter space; each is listed once."""
    rng = random.Random(seed)
    drawn = [{k: rng.choice(v) for k, v in space.items()} for _ in range(n_check)]
    return [s for i, s in enumerate(drawn) if s not in drawn[:i]]


class NearestWindows:
    """The most frequent follower among the ``k`` most similar windows (equal symbols at equal places)."""

    def __init__(self, k: int = 5) -> None:
        self.k = k

    def fit(self, x: np.ndarray, y: np.ndarray) -> NearestWindows:
        self.x, self.y = np.asarray(x), np.asarray(y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        alike = (np.asarray(x)[:, None, :] == self.x[None]).sum(2)
        order = np.argsort(-alike, axis=1, kind="stable")[:, : self.k]
        # votes by symbol; a tie goes to the smallest
        symbols, at = np.unique(self.y, return_inverse=True)
        votes = np.zeros((len(order), len(symbols)), np.int64)
        np.add.at(votes, (np.arange(len(order))[:, None], at[order]), 1)
        return symbols[votes.argmax(1)]


class CountingBayes:
    """Naive Bayes over symbols at places, with additive smoothing ``alpha``."""

    def __init__(self, alpha: float = 1.0) -> None:
        self.alpha = alpha

    def fit(self, x: np.ndarray, y: np.ndarray) -> CountingBayes:
        x, y = np.asarray(x), np.asarray(y)
        self.classes, at = np.unique(y, return_inverse=True)
        self.prior = np.log(np.bincount(at) / len(y))
        self.tables = []
        for c in range(x.shape[1]):
            table: dict = {}
            for s, k in zip(x[:, c].tolist(), at.tolist()):
                table.setdefault(s, np.zeros(len(self.classes)))[k] += 1
            self.tables.append((table, np.bincount(at) + self.alpha * (len(table) + 1)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        none = np.zeros(len(self.classes))
        rows = [self.prior + sum(np.log((t.get(s, none) + self.alpha) / total) for s, (t, total) in zip(row, self.tables)) for row in np.asarray(x).tolist()]
        return self.classes[np.argmax(np.array(rows), 1)]


def classifier_search(frame: DataFrame, algorithm: Callable = NearestWindows, space: dict[str, list] | None = None, search_size: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """PD19: per user a random search of settings over the folds of ``splitter``, a fit on all training windows, and the
    predictions of the test windows with their accuracy.

    ``algorithm`` is a class with ``fit(x, y)`` and ``predict(x)`` whose arguments ``space`` lists. A user's windows are held
    in one task. A user without training windows has no predictions.
    """
    xs = [c for c in frame.columns if c[0] == "x" and c[1:].isdigit()]
    settings = iterate_random_values(space or {"k": [1, 3, 5, 9]}, search_size, seed)
    kind = dict(frame.dtypes)["user_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, y, role, fold = (pdf[c].to_numpy() for c in ("w", "y", "role", "fold"))
        x = pdf[xs].to_numpy()
        at = np.nonzero(role == "test")[0]
        test = at[np.argsort(w[at])]
        before = np.nonzero(role != "test")[0]
        learn = before[np.unique(w[before], return_index=True)[1]]
        if not len(test) or not len(learn):
            return pd.DataFrame({"user_id": pdf["user_id"][:0], **{c: pd.Series([], dtype="int32") for c in ("i", "truth", "prediction")}})
        parts = [(np.nonzero((fold == f) & (role == "train"))[0], np.nonzero((fold == f) & (role == "val"))[0]) for f in np.unique(fold[before])]
        parts = [(a, b) for a, b in parts if len(a) and len(b)] if len(settings) > 1 else []
        scores = []
        for s in settings:
            hits = [algorithm(**s).fit(x[a], y[a]).predict(x[b]) == y[b] for a, b in parts]
            scores.append(np.concatenate(hits).mean() if hits else 0.0)
        best = settings[int(np.argmax(scores))]
        guess = algorithm(**best).fit(x[learn], y[learn]).predict(x[test])
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "i": w[test], "truth": y[test], "prediction": guess})

    found = frame.select("user_id", "w", *xs, "y", "role", "fold").groupBy("user_id").applyInPandas(run, f"user_id {kind}, i int, truth int, prediction int")
    return found, accuracy(found)


def folds(df: DataFrame, n_splits: int, order: str = "w") -> DataFrame:
    """PD23: ``fold`` 1..n_splits of nearly equal size, in order."""
    return df.withColumn("fold", F.ntile(n_splits).over(Window.partitionBy("user_id").orderBy(order)))


def split_input_target(chunk: Column) -> tuple[Column, Column]:
    """PD24: a sequence without its last, and without its first symbol."""
    return F.slice(chunk, F.lit(1), F.greatest(F.size(chunk) - 1, F.lit(0))), F.slice(chunk, F.lit(2), F.greatest(F.size(chunk) - 1, F.lit(0)))


class GatedNetwork:
    """PD21, PD22, PD25: embedding, one or two gated recurrent layers, and a softmax over symbols, in NumPy.

    Trained by Adam on the cross-entropy of the logits with back-propagation through the window and dropout before the
    last layer. Training goes on from fold to fold: each part of the windows in turn validates and the others are learnt
    from (a single fold: the second half is learnt from and the first one validates); in every fold the epoch of the best
    validation loss is kept, and it ends after ``patience`` worse ones. Symbols are drawn from the softmax at ``temperature``;
    0 takes the most likely one.
    """

    def __init__(
        self, window: int = 5, embedding: int = 16, units: int = 24, layers: int = 1, epochs: int = 30, patience: int = 2, rate: float = 0.02, seed: int = 0,
        dropout: float = 0.2, folds: int = 5, batch: int = 32, temperature: float = 0.1,
    ) -> None:
        self.window, self.embedding, self.units, self.layers = window, embedding, units, layers
        self.epochs, self.patience, self.rate, self.seed = epochs, patience, rate, seed
        self.dropout, self.folds, self.batch, self.temperature = dropout, folds, batch, temperature

    def fit(self, x: np.ndarray, y: np.ndarray) -> GatedNetwork:
        rng = np.random.default_rng(self.seed)
        self.symbols = np.unique(np.concatenate([np.asarray(x).ravel(), np.asarray(y)]))
        v, e, u = len(self.symbols) + 1, self.embedding, self.units
        small = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape)
        p = {"E": small(v, e), "W": small(u, v), "b": np.zeros(v)}
        for k in range(self.layers):
            i = e if k == 0 else u
            p |= {f"{g}{k}": small(i + u, u) for g in "zrh"} | {f"b{g}{k}": np.zeros(u) for g in "zrh"}
        self.p = p
        x, y = self._codes(x), self._codes(y)
        m, s = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
        t = 0
        parts = [part for part in np.array_split(np.arange(len(x)), max(self.folds, 2)) if len(part)]
        for held in parts if self.folds > 1 else parts[:1]:
            learn = np.setdiff1d(np.arange(len(x)), held) if len(parts) > 1 else held
            best, kept, worse = math.inf, None, 0
            for _ in range(self.epochs):
                order = rng.permutation(learn)
                for at in (order[i : i + self.batch] for i in range(0, len(order), self.batch)):
                    mask = (rng.random((len(at), u)) >= self.dropout) / (1 - self.dropout)
                    grads, t = self._gradients(x[at], y[at], mask), t + 1
                    for n, g in grads.items():
                        m[n], s[n] = 0.9 * m[n] + 0.1 * g, 0.999 * s[n] + 0.001 * g * g
                        p[n] -= self.rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.999**t)) + 1e-8)
                now = self.loss(self._forward(x[held])[0], y[held])
                if now < best - 1e-6:
                    best, kept, worse = now, {n: a.copy() for n, a in p.items()}, 0
                elif (worse := worse + 1) >= self.patience:
                    break
            if kept:
                self.p = p = kept
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        logits = self._forward(self._codes(x))[0][:, :-1]
        if self.temperature > 0:
            # the greatest of logits with Gumbel noise is a draw from the softmax
            logits = logits / self.temperature + np.random.default_rng([self.seed, 1]).gumbel(size=logits.shape)
        return self.symbols[np.argmax(logits, 1)]

    @staticmethod
    def loss(logits: np.ndarray, y: np.ndarray) -> float:
        top = logits.max(1, keepdims=True)
        return float((np.log(np.exp(logits - top).sum(1)) + top[:, 0] - logits[np.arange(len(y)), y]).mean())

    def _codes(self, x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.symbols, x), len(self.symbols) - 1)
        return np.where(self.symbols[at] == x, at, len(self.symbols))

    def _forward(self, x: np.ndarray):
        p, sig = self.p, lambda a: 1 / (1 + np.exp(-a))
        inputs, tapes = [p["E"][x[:, t]] for t in range(x.shape[1])], []
        for k in range(self.layers):
            h, tape = np.zeros((len(x), self.units)), []
            for a in inputs:
                c = np.concatenate([a, h], 1)
                z, r = sig(c @ p[f"z{k}"] + p[f"bz{k}"]), sig(c @ p[f"r{k}"] + p[f"br{k}"])
                d = np.concatenate([a, r * h], 1)
                n = np.tanh(d @ p[f"h{k}"] + p[f"bh{k}"])
                tape.append((a, h, c, z, r, d, n))
                h = (1 - z) * h + z * n
            tapes.append(tape)
            inputs = [(1 - t[3]) * t[1] + t[3] * t[6] for t in tape]
        return inputs[-1] @ p["W"] + p["b"], inputs[-1], tapes

    def _gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        p, (_, last, tapes) = self.p, self._forward(x)
        last = last * mask
        logits = last @ p["W"] + p["b"]
        g = {n: np.zeros_like(a) for n, a in p.items()}
        soft = np.exp(logits - logits.max(1, keepdims=True))
        soft /= soft.sum(1, keepdims=True)
        soft[np.arange(len(y)), y] -= 1
        soft /= len(y)
        g["W"], g["b"] = last.T @ soft, soft.sum(0)
        steps = x.shape[1]
        from_above = [np.zeros_like(last) for _ in range(steps)]
        from_above[-1] = soft @ p["W"].T * mask
        for k in reversed(range(self.layers)):
            dh, below = np.zeros_like(last), [None] * steps
            for t in reversed(range(steps)):
                a, h, c, z, r, d, n = tapes[k][t]
                dh = dh + from_above[t]
                dz, dn = dh * (n - h) * z * (1 - z), dh * z * (1 - n * n)
                g[f"h{k}"] += d.T @ dn
                g[f"bh{k}"] += dn.sum(0)
                dd = dn @ p[f"h{k}"].T
                w = a.shape[1]
                dr = dd[:, w:] * h * r * (1 - r)
                g[f"z{k}"] += c.T @ dz
                g[f"bz{k}"] += dz.sum(0)
                g[f"r{k}"] += c.T @ dr
                g[f"br{k}"] += dr.sum(0)
                dc = dz @ p[f"z{k}"].T + dr @ p[f"r{k}"].T
                below[t] = dd[:, :w] + dc[:, :w]
                dh = dh * (1 - z) + dd[:, w:] * r + dc[:, w:]
            from_above = below
        for t in range(steps):
            np.add.at(g["E"], x[:, t], from_above[t])
        return g


def deep_pred(frame: DataFrame, space: dict[str, list] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """PD21: a recurrent network per user over the windows of ``splitter``; see ``GatedNetwork`` for its settings."""
    return classifier_search(frame, GatedNetwork, space or {"layers": [1]}, 1, seed)
