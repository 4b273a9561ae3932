import random

from tracksmith.llm.unify import folded, plain, repair, repairs, same_looking_pairs, unified_forms

CLEAN = ["Rename the local cache", "Переименуй опору моста", "Μετακίνησε την καμπύλη", "a о c e", "über naïve façade\nline two", "def cope(a, c):\n  return x"]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", b"y") for i, t in docs], "doc long, body string, form string, raw binary")


def pairs(spark, docs):
    return sorted(map(tuple, same_looking_pairs(unified_forms(frame(spark, docs), "doc", "body"), "doc").collect()))


def disguise(rng, text):
    swap = {"a": "аɑ", "e": "е", "o": "оο", "c": "с", "p": "р", "а": "a", "о": "oο", "р": "p", "α": "aа", "ν": "v", "ü": ["ü"], "ï": ["ï"], "R": ["Ｒ"], " ": " 　 "}
    out = []
    for c in text:
        out.append(rng.choice(list(swap[c])) if c in swap and rng.random() < 0.4 else c)
        if rng.random() < 0.05:
            out.append(rng.choice("​‍­﻿"))
    return "".join(out)


def test_pairs_against_brute_force(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(CLEAN)) for i in range(12)]
    docs += [(100 + i, disguise(rng, rng.choice(CLEAN))) for i in range(40)]
    docs += [(200, None), (201, ""), (202, " "), (203, " "), (204, "​")] + docs[:5]
    rng.shuffle(docs)
    unique = dict(docs)
    want = sorted((a, b) for a in unique for b in unique if a < b and unique[a] != unique[b] and (unique[a] or "").strip() and (unique[b] or "").strip() and folded(unique[a]) == folded(unique[b]) and folded(unique[a]).strip())
    assert len(want) > 50
    assert pairs(spark, docs) == want


def test_differences_that_stay(spark):
    docs = list(enumerate(["cafe", "café", "Cafe", "cafe1", "cafe\n", "cafe 1", "ca fe"]))
    assert pairs(spark, docs) == []


def test_repair_needs_the_vocabulary(spark):
    docs = [(1, "the cache"), (2, "the сache"), (3, "a zеbra")]
    got = {r["doc"]: r["text"] for r in unified_forms(frame(spark, docs), "doc", "body", keep_text=True).collect()}
    assert got == {1: "the cache", 2: "the cache", 3: "a zеbra"}


def test_scripts_of_tokens():
    assert plain("ｆｏｏ​ é x") == "foo é x"
    assert [r[3] for r in repairs("tools/оffset привет\nпривет c водой")] == ["offset", "с"]
    assert repair("Прiвет cop", {"Привет"}) == "Прiвет cop"
    assert repair("мoст", {"мост"}) == "мост"
    assert repair("λoγος", {"λογος"}) == "λογος"


def test_empty(spark):
    assert pairs(spark, []) == []
    got = unified_forms(frame(spark, [(1, None), (2, "")]), "doc", "body").collect()
    assert {r["doc"]: (r["blank"], r["form"] is None) for r in got} == {1: (True, True), 2: (True, False)}


def test_rows_without_id_and_very_long_text(spark):
    long = "the local cache naïve\n" * 60_000
    docs = [(1, long), (2, long.replace("cache", "сache", 1)), (None, "the сache"), (None, "the cache"), (3, "the cache"), (4, "the cаche")]
    assert pairs(spark, docs) == [(1, 2), (3, 4)]


def test_ascii_line_of_a_text_in_another_script(spark):
    for first in ("Переименуй опору моста", "Μετακίνησε την καμπύλη"):
        o = "о" if first[0] == "П" else "ο"
        docs = [(1, first + "\n@@ -263,5 +263,8 @@ vipo"), (2, first + "\n@@ -263,5 +263,8 @@ vip" + o), (3, first + "\n@@ -263,5 +263,8 @@ vipe")]
        assert pairs(spark, docs) == [(1, 2)]
    assert [r[3] for r in repairs("привет вода\nvipe\nbase")] == ["ѵіре"]
    # a text in Latin letters keeps its lines
    assert list(repairs("naïve tale\nvipe\nα")) == [(16, 17, "α", "a")]


def test_two_lines_against_brute_force(spark):
    rng = random.Random(8)
    clean = [a + "\n" + b for a in ("Переименуй опору моста", "Μετακίνησε την καμπύλη", "Rename the local cache") for b in ("a x = cop", "ор", "vipe 12 oxo")]
    docs = [(i, rng.choice(clean)) for i in range(12)] + [(100 + i, disguise(rng, rng.choice(clean))) for i in range(60)]
    unique = dict(docs)
    want = sorted((a, b) for a in unique for b in unique if a < b and unique[a] != unique[b] and folded(unique[a]) == folded(unique[b]))
    assert len(want) > 50
    assert pairs(spark, docs) == want
