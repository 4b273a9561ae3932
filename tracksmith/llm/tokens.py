"""Problem 8: a corpus encoded with a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracksmith.storage import materialize

#: Where the vocabulary files lie.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and by how many it reads on into the next one.
CHUNK, OVERLAP = 32_768, 2_048


@lru_cache(maxsize=4)
def encoder(folder: str, name: str):
    """The tokenizer of a rank file, without special tokens: strings that look like one are ordinary text."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int32)))


def _encode(folder: str, name: str, names: list[str]):
    """The last column of a batch encoded; no text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, name).encode_to_numpy
        for batch in batches:
            # a batch of texts may be large, so its ids go out in parts
            ids, texts = batch.columns[:-1], batch.columns[-1].to_pylist()
            start, held, size = 0, [], 0
            for i, t in enumerate(texts):
                held.append(encode(t, disallowed_special=()) if t else np.zeros(0, np.int32))
                size += len(held[-1])
                if size > 4_000_000 or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(held)) for c in ids), _lists(held)], names=names)
                    start, held, size = i + 1, [], 0

    return run


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens, and the length."""
    return [*(m.start() for m in regex.finditer(PATTERN, text)), len(text)]


def _slices(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                n = max(1, -(-len(text) // chunk))
                for first in range(0, n, 64):
                    ks = range(first, min(n, first + 64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([i] * len(ks), pa.int64()), pa.array(ks, pa.int64()), pa.array([k + 1 == n for k in ks]),
                        pa.array([text[k * chunk : (k + 1) * chunk + overlap] for k in ks], pa.string()),
                    ], names=["id", "k", "is_last", "t"])

    return run


_KINDS = regex.compile(r"(\s)|(\p{L})|(\p{N})|(.)", regex.DOTALL)
# signs that are space to some libraries only
_UNSURE = "\x1c\x1d\x1e\x1f\x85"


def _kind(c: str) -> int:
    return _KINDS.match(c).lastindex


def is_sure(text: str, at: int) -> bool:
    """Whether every reading has a boundary at this place, wherever it began.

    A pre-token takes in all of a run of letters, digits or other signs once it has one of them, and goes over from one
    kind to another only from a space, or from an apostrophe to letters. So where a run of one kind ends otherwise, a
    pre-token ends.
    """
    if at == 0:
        return True
    if text[at - 1] in _UNSURE or text[at] in _UNSURE:
        return False
    before, after = _kind(text[at - 1]), _kind(text[at])
    return before != 1 and before != after and not (text[at - 1] == "'" and after == 2)


def _edges(chunk: int, overlap: int):
    """Sure boundaries among the pre-tokens that a chunk sees: in its first characters, and past its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for last, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                # the pre-tokens of the first and the last characters; what lies between plays no part
                at = [b for b in boundaries(t[: 2 * overlap]) if b < min(overlap, len(t)) and is_sure(t, b)]
                heads.append(at)
                near = max(0, chunk - overlap)
                tails.append([] if last else [b + near - chunk for b in boundaries(t[near:])[:-1] if b + near >= chunk and is_sure(t, b + near)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, kind), pa.array(tails, kind)], names=["id", "k", "heads", "tails"])

    return run


def cut_into_pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Texts (``id, t``) in pieces that can be encoded each for itself: ``id, piece, t``."""
    slices = materialize(long.mapInArrow(_slices(chunk, overlap), "id long, k long, is_last boolean, t string").repartition("id", "k"), "chunks")
    edges = slices.mapInArrow(_edges(chunk, overlap), "id long, k long, heads array<int>, tails array<int>")
    w = Window.partitionBy("id").orderBy("k")
    # a piece begins at place r of chunk k
    meets = edges.select("id", "k", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(w)))).alias("r"))
    meets = meets.select("id", "k", "r", F.lead("r").over(w).alias("next_r"), F.last(F.when(F.col("r").isNotNull(), F.col("k")), ignorenulls=True).over(w).alias("piece"))
    own = F.when(F.col("is_last"), F.length("t")).otherwise(F.lit(chunk) + F.coalesce("next_r", F.lit(0)))
    start = F.coalesce("r", F.lit(0))
    parts = slices.join(meets, ["id", "k"]).select("id", "k", "piece", F.substring("t", start + 1, own - start).alias("t"))
    return parts.groupBy("id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("t"))


def encode_corpus(
    df: DataFrame, doc_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """Token ids of every text without special tokens: ``doc_id, ids`` (array of int).

    Null and empty texts both have an empty array. ``doc_id`` is an integer and unique; rows without it are left out; an empty table gives no rows.
    Other columns are ignored, whatever their names.

    A text of at most ``chunk`` characters is encoded where it is read. A longer one is cut into chunks that overlap
    and go to different tasks. Each is split into pre-tokens on its own; where a chunk and the one before see a sure
    boundary (see ``is_sure``) at the same place of their overlap, both go on alike from there, as the pattern never looks
    back. The pieces between such places are encoded in parallel and their ids put together by text. Two chunks without
    such a place between them (a word longer than the overlap) are one piece; the places after it count as before.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull())
    length = F.coalesce(F.length("t"), F.lit(0))
    done = rows.where(length <= chunk).mapInArrow(_encode(folder, name, ["id", "ids"]), "id long, ids array<int>")
    pieces = cut_into_pieces(rows.where(length > chunk), chunk, overlap)
    encoded = pieces.mapInArrow(_encode(folder, name, ["id", "piece", "ids"]), "id long, piece long, ids array<int>")
    long = encoded.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return done.unionByName(long).withColumnRenamed("id", doc_id)


def decode_corpus(df: DataFrame, doc_id: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Texts from ids: ``doc_id, text``; the bytes of the tokens are put together and then read as UTF-8. Null gives ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(folder, name).decode_bytes
        for batch in batches:
            texts = [decode(x).decode("utf-8", "replace") if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return df.select(F.col(doc_id).cast("long").alias("id"), F.col(ids).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", doc_id)
