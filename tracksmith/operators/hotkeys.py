"""Problem 2: results per key when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracksmith.storage import materialize

#: Distinct keys of a task's dictionary before its arrays are handed on.
DICTIONARY_KEYS = 500_000

_LOW, _HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Accumulators:
    """Dense arrays of count, and of count, sum, least and greatest of each value, by dictionary code of the key."""

    def __init__(self, n_values: int) -> None:
        self.codes: dict = {}
        self.size = 1024
        self.n = np.zeros(self.size, np.int64)
        self.values = [(np.zeros(self.size, np.int64), np.zeros(self.size, np.float64), np.full(self.size, np.inf), np.full(self.size, -np.inf)) for _ in range(n_values)]

    def slots(self, keys: pa.Array) -> np.ndarray:
        """Codes of a batch: encoded by Arrow, and the batch's distinct keys by the dictionary."""
        encoded = keys.dictionary_encode(null_encoding="encode")
        codes = self.codes
        to = np.fromiter((codes.setdefault(k, len(codes)) for k in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
        while len(codes) > self.size:
            self.n = np.concatenate([self.n, np.zeros(self.size, np.int64)])
            self.values = [tuple(np.concatenate([a, np.full(self.size, fill, a.dtype)]) for a, fill in zip(v, (0, 0, np.inf, -np.inf))) for v in self.values]
            self.size *= 2
        return to[encoded.indices.to_numpy(zero_copy_only=False)]

    def add_rows(self, keys: pa.Array, values: list[pa.Array]) -> None:
        at = self.slots(keys)
        k = len(self.codes)
        self.n[:k] += np.bincount(at, minlength=k)
        for (count, total, low, high), column in zip(self.values, values):
            x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            there = ~np.isnan(x)
            a, x = at[there], x[there]
            count[:k] += np.bincount(a, minlength=k)
            total[:k] += np.bincount(a, weights=x, minlength=k)
            np.minimum.at(low, a, x)
            np.maximum.at(high, a, x)

    def add_blocks(self, columns: list[pa.Array]) -> None:
        at = self.slots(columns[0])
        get = [c.to_numpy(zero_copy_only=False) for c in columns[1:]]
        np.add.at(self.n, at, get[0])
        for i, (count, total, low, high) in enumerate(self.values):
            c, t, lo, hi = get[1 + 4 * i : 5 + 4 * i]
            np.add.at(count, at, c)
            np.add.at(total, at, t)
            np.minimum.at(low, at, lo)
            np.maximum.at(high, at, hi)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        k = len(self.codes)
        flat = [self.n[:k], *(a[:k] for v in self.values for a in v)]
        return pa.RecordBatch.from_arrays([pa.array(list(self.codes), schema.types[0]), *(pa.array(a, t) for a, t in zip(flat, schema.types[1:]))], schema=schema)


def key_totals(df: DataFrame, key: str, values: dict[str, Column] | None = None) -> DataFrame:
    """One row per value of ``key``, null included: ``key, n`` and ``<v>_n, <v>_sum, <v>_min, <v>_max`` of each value.

    ``values`` names numeric expressions; nulls and NaN do not count in them, and a key without any has null sum, least
    and greatest. Repeated rows count as often as they stand. An empty table gives no rows.

    Work is even whatever the keys are: every input split, equal in size, dictionary-encodes its keys and adds its rows
    into dense arrays (``bincount``, scatter least and greatest). What is shuffled is one entry per key and split.
    The entries are summed as blocks of the key space, block by block on all executors.
    """
    values = values or {}
    kind = df.schema[key].dataType
    per_value = [("n", T.LongType()), ("sum", T.DoubleType()), ("min", T.DoubleType()), ("max", T.DoubleType())]
    schema = T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType()), *(T.StructField(f"{v}_{c}", t) for v in values for c, t in per_value)])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    n_values = len(values)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulators(n_values)
        for b in batches:
            acc.add_rows(b.column(0), b.columns[1:])
            if len(acc.codes) > DICTIONARY_KEYS:
                yield acc.batch(arrow)
                acc = Accumulators(n_values)
        if acc.codes:
            yield acc.batch(arrow)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulators(n_values)
        for b in batches:
            acc.add_blocks(b.columns)
        if acc.codes:
            yield acc.batch(arrow)

    rows = df.select(F.col(key).alias("k"), *(v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())))
    out = rows.mapInArrow(split, schema).repartition("k").mapInArrow(reduce, schema)
    some = lambda v, c: F.when(F.col(f"{v}_n") > 0, F.col(f"{v}_{c}")).alias(f"{v}_{c}")
    return out.select(F.col("k").alias(key), "n", *(c for v in values for c in (F.col(f"{v}_n"), some(v, "sum"), some(v, "min"), some(v, "max"))))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys (not null) that hold at least ``share`` of all rows, rows without key counted in the total: ``key, n``.

    The rows are read once; their number is the sum of the totals, which are kept in a table.
    """
    totals = materialize(key_totals(df, key), "totals")
    rows = totals.agg(F.sum("n")).scalar()
    # the quotient is rounded to the nearest double, as the constant is, so an exact share counts
    return totals.where(F.col(key).isNotNull() & (F.col("n") / rows >= share))
