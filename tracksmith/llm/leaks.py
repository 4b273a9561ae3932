"""Problem 9: passages of evaluation items in a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.llm.unify import folded
from tracksmith.storage import materialize

#: Words of a shingle.
SHINGLE = 5
#: Items' texts are sent to all executors only up to this many characters.
BROADCAST_CHARS = 16_000_000

_WORD, _ASCII_WORD = re.compile(r"[^\W_]+"), re.compile("[a-z0-9]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words in the common form of look-alikes, case ignored: the longest runs of letters and digits."""
    form = folded(text)
    return _ASCII_WORD.findall(form.lower()) if form.isascii() else _WORD.findall(folded(form.casefold()))


def _code(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of every run of SHINGLE codes."""
    n = len(codes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = (h ^ codes[i : i + n]) * _PRIME
            h ^= h >> np.uint64(29)
    return h


def _postings(known: tuple[dict[str, int], np.ndarray, list[str]] | None, spelled: bool = True):
    """Shingles of each text with their place, the number of shingles after it and, ``spelled``, the words.

    Only those ``known``, if told which: by the codes of words, the hashes in order, and their words, which are compared.
    """
    schema = pa.schema([("id", pa.int64()), ("shingle", pa.int64()), ("pos", pa.int32()), ("after", pa.int32()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = dict(known[0]) if known else {}
        wanted = known[1] if known else None
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                ids, sizes, flat, all_words = [], [], [], []
                for i, text in zip(*(c.to_pylist() for c in part.columns)):
                    if i is None or not text:
                        continue
                    words = words_of(text)
                    if len(words) < SHINGLE:
                        continue
                    if known:
                        flat += [codes.get(w, 0) for w in words]
                    else:
                        if len(codes) > 1_000_000:
                            codes.clear()
                        for w in words:
                            if w not in codes:
                                codes[w] = _code(w)
                            flat.append(codes[w])
                    ids.append(i)
                    sizes.append(len(words))
                    if spelled or known:
                        all_words += words
                if not ids:
                    continue
                all_codes, sizes = np.array(flat, np.uint64), np.array(sizes)
                h = shingle_hashes(all_codes)
                ends = np.cumsum(sizes)
                doc = np.repeat(np.arange(len(ids)), sizes)[: len(h)]
                place = np.arange(len(h))
                after = ends[doc] - SHINGLE - place
                keep = after >= 0
                if known:
                    blank = np.concatenate([[0], np.cumsum(all_codes == 0)])
                    keep &= blank[SHINGLE:] == blank[: len(h)]
                    at = np.nonzero(keep)[0]
                    found = np.searchsorted(wanted, h[at])
                    found = np.minimum(found, len(wanted) - 1)
                    hit = wanted[found] == h[at]
                    at = np.array([k for k, f in zip(at[hit].tolist(), found[hit].tolist()) if " ".join(all_words[k : k + SHINGLE]) == known[2][f]], np.int64)
                else:
                    at = np.nonzero(keep)[0]
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(ids, np.int64)[doc[at]]), pa.array(h[at].view(np.int64)),
                        pa.array((at - (ends - sizes)[doc[at]]).astype(np.int32)), pa.array(after[at].astype(np.int32)),
                        pa.array([" ".join(all_words[k : k + SHINGLE]) if spelled else None for k in at], pa.string()),
                    ], schema=schema)

    return run


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 13, broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """Documents that hold at least ``words`` consecutive words of an item: ``doc_id, item_id``, each pair once.

    Both texts are brought to the form of problem 10, look-alikes compared alike, and letter case is ignored; words are
    the longest runs of letters and digits. Null, empty and blank texts, and items of fewer than ``words`` words, match
    nothing; repeated rows change nothing; empty tables give no rows. Ids are integers. Other columns are ignored.

    A set join with a prefix filter: both sides become sets of shingles of five words with their places. How rare each
    item's shingle is, is counted over the whole corpus. Of the shingles of a window of ``words`` words of an item all
    must be in the document, so the rarest one is a sufficient prefix: only its occurrences are joined, and a window
    that has a shingle found nowhere is not joined at all. An occurrence is a candidate if the window fits into the text
    around it (length and position). For candidates alone the item's shingles around are looked up in the text, each at the
    place where it must stand, and compared word by word; ``words - 4`` in a row are a passage.

    If the items' texts have at most ``broadcast_chars`` characters together (checked), their shingles go to the
    executors and the corpus brings in only those; else the corpus brings in the hashes of all its shingles, is joined by
    them, and the texts with candidates are read once more for their words.
    """
    needed = words - SHINGLE + 1
    if needed < 1:
        raise ValueError(f"at least {SHINGLE} words")
    its = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("t"))
    ddl = "id long, shingle long, pos int, after int, words string"
    item_side = its.distinct().mapInArrow(_postings(None), ddl).select(F.col("id").alias("item"), "shingle", F.col("pos").alias("ipos"), F.col("after").alias("iafter"), "words")
    size = its.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    corpus = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
    if size <= broadcast_chars:
        vocabulary = {w: _code(w) for (t,) in its.select("t").where(F.col("t").isNotNull()).toLocalIterator() for w in words_of(t)}
        shingles = dict(item_side.groupBy("shingle").agg(F.min("words"), F.max("words")).select("shingle", F.array("min(words)", "max(words)")).toLocalIterator())
    # two shingles of the items of one hash (not to be expected) are told apart by the other way
    few = size <= broadcast_chars and all(a == z for a, z in shingles.values())
    if few:
        hashes = np.sort(np.array(list(shingles), np.int64).view(np.uint64))
        spellings = [shingles[h][0] for h in hashes.view(np.int64).tolist()]
        known = (vocabulary, hashes, spellings) if len(hashes) else ({}, np.zeros(1, np.uint64), [""])
        found = corpus.mapInArrow(_postings(known, spelled=False), ddl)
    else:
        found = corpus.mapInArrow(_postings(None, spelled=False), ddl).join(item_side.select("shingle").distinct(), "shingle", "left_semi")
    found = materialize(found, "postings")
    item_side = materialize(item_side, "items")
    counts = found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    # all windows of the items: the place of the window, and each of its shingles with how far in it stands
    counted = item_side.join(counts, "shingle", "left").select("item", "shingle", "ipos", "iafter", F.coalesce("n", F.lit(0)).alias("n"))
    windows = counted.select("item", "shingle", "ipos", "n", "iafter", F.explode(F.sequence(F.lit(0), F.lit(needed - 1))).alias("off")).where((F.col("ipos") >= F.col("off")) & (F.col("iafter") >= F.lit(needed - 1) - F.col("off")))
    rarest = windows.groupBy("item", (F.col("ipos") - F.col("off")).alias("w")).agg(F.min(F.struct("n", "shingle", "ipos", "off")).alias("p")).where(F.col("p.n") > 0)
    # windows that share their rarest shingle need its occurrences once; the least demand on the text around it is kept
    prefixes = rarest.groupBy("item", F.col("p.shingle").alias("shingle"), F.col("p.ipos").alias("ipos")).agg(F.min("p.off").alias("least_before"), F.min(F.lit(needed - 1) - F.col("p.off")).alias("least_after"))
    candidates = found.join(prefixes, "shingle").where((F.col("pos") >= F.col("least_before")) & (F.col("after") >= F.col("least_after")))
    candidates = materialize(candidates.select("id", "item", (F.col("pos") - F.col("ipos")).alias("shift"), F.col("ipos").alias("at")).distinct(), "candidates")
    if not few:
        found = corpus.join(candidates.select("id").distinct(), "id", "left_semi").mapInArrow(_postings(None), ddl)
    # the item's shingles around a candidate, each at the place of the text where it must stand
    around = candidates.join(item_side.select("item", "ipos", "shingle", F.col("words").alias("its_words")), "item").where(F.abs(F.col("ipos") - F.col("at")) < needed)
    around = around.select("id", "item", "shift", "ipos", (F.col("ipos") + F.col("shift")).alias("pos"), "shingle", "its_words").distinct()
    spelled = found.select("id", "pos", "shingle") if few else found.select("id", "pos", "shingle", "words")
    lined = around.join(spelled, ["id", "pos", "shingle"])
    # the known shingles have been compared by their words already
    lined = (lined if few else lined.where(F.col("words") == F.col("its_words"))).select("id", "item", "shift", "ipos")
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("id", "item", "shift").orderBy("ipos"))
    hits = lined.distinct().select("id", "item", "shift", run.alias("run")).groupBy("id", "item", "shift", "run").count().where(F.col("count") >= needed)
    return hits.select(F.col("id").alias(doc_id), F.col("item").alias(item_id)).distinct()
