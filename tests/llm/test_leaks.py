import random

import pytest

from tracksmith.llm.leaks import leaked_items, words_of

VOCABULARY = [f"word{i}" for i in range(12)] + ["ключ", "clé", "42"]


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc long, body string, shingle string, item long")
    e = spark.createDataFrame([(i, t, 1) for i, t in items], "nr long, q string, id long")
    return sorted(map(tuple, leaked_items(d, "doc", "body", e, "nr", "q", **options).collect()))


def brute(docs, items, n=13):
    windows = lambda t: {tuple(w[i : i + n]) for w in [words_of(t or "")] for i in range(len(w) - n + 1)}
    sets = [(i, windows(t)) for i, t in items]
    return sorted({(d, i) for d, t in docs for i, s in sets if windows(t) & s})


@pytest.mark.parametrize("broadcast_chars", [10**6, 0])
def test_against_brute_force(spark, broadcast_chars):
    rng = random.Random(8)
    text = lambda n: rng.choice([" ", "\n", ", ", "-"]).join(rng.choice(VOCABULARY) for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(25)]
    docs = []
    for d in range(150):
        t = text(rng.randrange(0, 80))
        if d % 3 == 0:
            w = rng.choice(items)[1].replace("\n", " ").replace(", ", " ").replace("-", " ").split(" ")
            a = rng.randrange(max(1, len(w) - 12))
            t += " " + " ".join(w[a : a + rng.choice([12, 13, 20])]).upper() + " " + text(9)
        docs.append((d, t))
    docs += docs[:10] + [(900, None), (901, ""), (902, " \n")]
    items += items[:3] + [(800, None), (801, "")]
    want = brute(docs, items)
    assert len(want) > 20
    assert run(spark, docs, items, broadcast_chars=broadcast_chars) == want


def test_written_with_other_characters(spark):
    words = "Read the change and state what it does now Avoid the brittle signal".split()
    disguised = "ｒｅａｄ the сhange and sta​te what it does-now avoid/the brіttle\nSIGNAL!"
    assert run(spark, [(1, "x " + disguised), (2, " ".join(words[:12]))], [(7, " ".join(words))]) == [(1, 7)]


def test_empty(spark):
    assert run(spark, [], [(1, "a b c d e f g h i j k l m n")]) == []
    assert run(spark, [(1, "a b c d e f g h i j k l m n")], []) == []


def test_rows_without_id_and_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    long = "filler w3 w4 " * 200_000 + item + " end " * 1000
    assert run(spark, [(1, long), (None, item), (2, item + "x")], [(7, item), (None, item)]) == [(1, 7), (2, 7)]


@pytest.mark.parametrize("broadcast_chars", [10**6, 0])
def test_boilerplate_in_all_texts_and_items(spark, broadcast_chars, monkeypatch):
    """One sentence in every text and every item: the rows that verify candidates stay in proportion to the pairs."""
    from tracksmith.llm import leaks

    same = " ".join(f"same{i}" for i in range(12))
    items = [(i, f"{same} own{i} tail{i} " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(40)]
    docs = [(d, f"{same} other{d} " * 20) for d in range(300)] + [(1000 + i, "a b c " + items[i][1]) for i in range(5)]
    sizes = {}
    real = leaks.materialize
    monkeypatch.setattr(leaks, "materialize", lambda df, name: sizes.setdefault(name, real(df, name)))
    assert run(spark, docs, items, broadcast_chars=broadcast_chars) == [(1000 + i, i) for i in range(5)]
    assert sizes["candidates"].count() < 200


def test_words_are_compared_not_hashes(spark, monkeypatch):
    from tracksmith.llm import leaks

    words = [f"w{i}" for i in range(14)]
    docs, items = [(1, " ".join(words)), (2, " ".join(words[:12] + ["zz", "yy"]))], [(7, " ".join(words))]
    assert run(spark, docs, items) == [(1, 7)]
    df = spark.createDataFrame([(1, "a b c d e f")], "id long, t string")
    got = df.mapInArrow(leaks._postings(None), "id long, shingle long, pos int, after int, words string").collect()
    assert [(r["pos"], r["words"]) for r in got] == [(0, "a b c d e"), (1, "b c d e f")]
