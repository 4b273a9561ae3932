from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracksmith.operators import generators as gn
from tracksmith.operators import prediction as pd_


def frame(spark, sequences):
    rows = [(u, f"2020-01-01 00:{i // 60:02d}:{i % 60:02d}", s) for u, seq in sequences.items() for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "user_id string, datetime string, labels int").withColumn("datetime", F.to_timestamp("datetime"))


def test_markov_backs_off_to_shorter_states(spark):
    df = frame(spark, {"a": [1, 2, 3, 1, 2, 3, 1, 2, 9, 2]})
    train, test = pd_.split(df, 0.6, 2)
    got = pd_.markov_predict(pd_.markov_counts(train, 2), test, 2).orderBy("i").collect()
    assert [(r["truth"], r["prediction"]) for r in got] == [(1, 1), (2, 2), (9, 3), (2, 1)]
    assert pd_.accuracy(pd_.markov_predict(pd_.markov_counts(train, 2), test, 2)).first()["accuracy"] == 0.5
    rolled = pd_.markov_wrapper(df, 0.4, 2, online=False)[0].orderBy("i").collect()
    assert [r["prediction"] for r in rolled] == [1, 2, 3, 1]


def test_user_without_training_is_predicted_as_unknown(spark):
    train, test = frame(spark, {"a": [1, 2]}), frame(spark, {"b": [1, 2, 1]})
    got = pd_.markov_predict(pd_.markov_counts(pd_.sequence(train), 1), pd_.sequence(test), 1).collect()
    assert [r["prediction"] for r in got] == [-1, -1]


def test_sampled_predictions_follow_the_counts(spark):
    df = frame(spark, {"a": [0, 0, 0, 1] * 400})
    got = Counter(r["prediction"] for r in pd_.markov_wrapper(df, 0.5, 0, sample=True, seed=5)[0].collect())
    assert 0.65 < got[0] / sum(got.values()) < 0.85
    again = Counter(r["prediction"] for r in pd_.markov_wrapper(df.repartition(5), 0.5, 0, sample=True, seed=5)[0].collect())
    assert again == got


def test_windows_need_a_horizon(spark):
    with pytest.raises(ValueError):
        pd_.windows(frame(spark, {"a": [1, 2]}), 0)
    assert pd_.windows(frame(spark, {"a": [1, 2]}), 5).count() == 0


def test_sparse_patterns_of_a_cycle(spark):
    assert pd_.sparse_model([1, 2, 1, 2]) == {((-1, 2),): Counter({1: 1}), ((-1, 1),): Counter({2: 1})}
    found, score = pd_.sparse_wrapper(frame(spark, {"a": [1, 2, 3] * 6}), 0.3)
    assert score.first()["accuracy"] == 1.0 and found.count() == 5
    assert pd_.sparse_guess({}, [4, 4, 5], 3) == 4


@pytest.mark.parametrize("algorithm,space", [(pd_.NearestWindows, {"k": [1, 3]}), (pd_.CountingBayes, {"alpha": [0.1, 1.0]}), (pd_.GatedNetwork, {"epochs": [80], "layers": [1, 2], "patience": [20]})])
def test_classifiers_learn_a_cycle(spark, algorithm, space):
    windows = pd_.splitter(frame(spark, {"a": [1, 2, 3, 4] * 20, "short": [1]}), 0.25, 3, 2)
    found, score = pd_.classifier_search(windows, algorithm, space, 2)
    assert {r["user_id"]: r["accuracy"] for r in score.collect()} == {"a": 1.0}


def test_gradients_of_the_network():
    net = pd_.GatedNetwork(embedding=3, units=4, layers=2, epochs=0)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (6, 4)), rng.integers(0, 3, 6)
    net.fit(x, y)
    x, y = net._codes(x), net._codes(y)
    grads = net._gradients(x, y)
    for name, at in (("E", (1, 2)), ("z0", (2, 1)), ("r1", (5, 0)), ("h0", (4, 3)), ("bh1", (2,)), ("W", (1, 1))):
        p, e = net.p[name], 1e-5
        p[at] += e
        up = net.loss(net._forward(x)[0], y)
        p[at] -= 2 * e
        down = net.loss(net._forward(x)[0], y)
        p[at] += e
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_dropout_masks_the_last_layer_alone():
    net = pd_.GatedNetwork(embedding=3, units=4, epochs=0)
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, (6, 4)), rng.integers(0, 3, 6)
    net.fit(x, y)
    x, y, mask = net._codes(x), net._codes(y), (rng.random((6, 4)) < 0.7) / 0.7
    grads = net._gradients(x, y, mask)
    of = lambda: net.loss(net._forward(x)[1] * mask @ net.p["W"] + net.p["b"], y)
    for name, at in (("E", (1, 2)), ("h0", (4, 3)), ("W", (1, 1))):
        p, e = net.p[name], 1e-5
        p[at] += e
        up = of()
        p[at] -= 2 * e
        down = of()
        p[at] += e
        assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_any_class_with_fit_and_predict(spark):
    class Follower:
        """A classifier from elsewhere: what followed the last symbol most often."""

        def __init__(self, fallback=0):
            self.fallback = fallback

        def fit(self, x, y):
            self.table = {s: int(np.bincount(y[x[:, -1] == s]).argmax()) for s in np.unique(x[:, -1])}
            return self

        def predict(self, x):
            return np.array([self.table.get(s, self.fallback) for s in x[:, -1]])

    windows = pd_.splitter(frame(spark, {"a": [1, 2, 3, 4] * 20}), 0.25, 3, 2)
    assert {r["user_id"]: r["accuracy"] for r in pd_.classifier_search(windows, Follower, {"fallback": [1, 2]}, 3)[1].collect()} == {"a": 1.0}


def test_settings_are_drawn_by_seed():
    space = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert pd_.iterate_random_values(space, 4, 1) == pd_.iterate_random_values(space, 4, 1)
    assert all(s["a"] in space["a"] and s["b"] in space["b"] for s in pd_.iterate_random_values(space, 9))


def test_generators(spark):
    def by_user(df):
        out = {}
        for r in df.orderBy("user_id", "datetime").collect():
            out.setdefault(r["user_id"], []).append(r["labels"])
        return out

    assert all(sorted(s) == list(range(12)) for s in by_user(gn.exploratory_sequences_generator(spark, 5, 12, 3)).values())
    assert len(set(map(tuple, by_user(gn.exploratory_sequences_generator(spark, 5, 12, 3)).values()))) > 1
    same = [sorted(map(tuple, gn.random_sequences_generator(spark, 4, 5, 50, 9).repartition(n).collect())) for n in (1, 7)]
    assert same[0] == same[1] and {r[2] for r in same[0]} == set(range(5))
    mixed = by_user(gn.markovian_sequences_generator(spark, 3, 10, 500, 0.5, 2))
    assert all(0.4 < np.mean([s == n % 10 for n, s in enumerate(seq)]) < 0.7 for seq in mixed.values())
    states = by_user(gn.non_stationary_sequences_generator(spark, 3, 6, 2, 300, 2))
    assert all(set(s) <= set(range(6)) and len(set(s)) > 1 for s in states.values())
    assert gn.deterministic_sequences_generator(spark, 2, 3, 0).count() == 0
