"""Problem 1: overlapping and gapped intervals per entity, as continuous periods and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracksmith.functions.timebins import micros, micros_of
from tracksmith.storage import materialize

#: Intervals that a map-side combiner keeps before it hands them on.
COMBINER_INTERVALS = 200_000


class IntervalMap:
    """An ordered map of disjoint closed intervals; touching ones are one.

    ``starts`` and ``ends`` are parallel and ascending, so the intervals met by a new one are a slice found by binary
    search. The gaps are what lies between neighbours and are kept implicitly: an insertion changes those inside the
    slice and at its two ends, and no others.
    """

    __slots__ = ("ends", "starts")

    def __init__(self, starts: Iterable[int] = (), ends: Iterable[int] = ()) -> None:
        self.starts, self.ends = list(starts), list(ends)

    def __len__(self) -> int:
        return len(self.starts)

    def insert(self, start: int, end: int) -> None:
        i = bisect_left(self.ends, start)
        j = bisect_right(self.starts, end, i)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = (start,), (end,)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def _combine(schema: pa.Schema):
    """Map side: the interval maps of all keys of a split, handed on when they hold too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, IntervalMap] = {}
        held = 0

        def out() -> pa.RecordBatch:
            keys, blocks, starts, ends = [], [], [], []
            for (k, b), m in maps.items():
                keys += [k] * len(m)
                blocks += [b] * len(m)
                starts += m.starts
                ends += m.ends
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((keys, blocks, starts, ends), schema.types)], schema=schema)

        for batch in batches:
            for k, b, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                m = maps.get((k, b))
                if m is None:
                    m = maps[k, b] = IntervalMap()
                before = len(m)
                m.insert(s, e)
                held += len(m) - before
            if held > COMBINER_INTERVALS:
                yield out()
                maps.clear()
                held = 0
        if maps:
            yield out()

    return run


def _keyed(schema: pa.Schema):
    """Reduce side: rows sorted by key and block; the state is the interval map of the key at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, IntervalMap()
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), schema.types)], schema=schema)

        for batch in batches:
            for k, b, s, e in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (k, b):
                    if at is not None:
                        done.append((*at, state.starts, state.ends))
                    at, state = (k, b), IntervalMap()
                state.insert(s, e)
            if len(done) > 20_000:
                yield out()
                done.clear()
        if at is not None:
            done.append((*at, state.starts, state.ends))
            yield out()

    return run


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def merge_intervals(df: DataFrame, key: str, start: str, end: str, max_gap: str | None = None, block: str = "7 days") -> DataFrame:
    """Continuous periods of each ``key`` and the gaps between successive ones: ``key, kind, start, end``.

    An interval is usable if both ends are there and ``end >= start``; others and rows without key are left out.
    Touching intervals join, a zero-length one counts, repeated rows change nothing. A gap longer than ``max_gap`` is
    not listed. An empty table, or one without a usable interval, gives no rows. Other columns are ignored, whatever
    their names.

    A key's intervals are worked on in blocks of time, so that a key with very many rows is spread over many tasks.
    Each split first folds its rows into the ordered disjoint-interval maps of its (key, block) pairs; those maps are
    merged by (key, block). What a block needs from earlier ones is one number, the largest end so far; it comes
    from a window over one row per block, as does the start of the next period.
    """
    kind = df.schema[key].dataType
    size = micros_of(block)
    rows = (
        df.select(F.col(key).alias("k"), micros(F.col(start)).alias("s"), micros(F.col(end)).alias("e"))
        .where(F.col("k").isNotNull() & (F.col("e") >= F.col("s")))
        .select("k", F.floor(F.col("s") / size).cast("long").alias("b"), "s", "e")
    )
    row_type = T.StructType([T.StructField("k", kind), *(T.StructField(c, T.LongType()) for c in "bse")])
    flat = pa.schema([("k", _arrow_type(kind)), *((c, pa.int64()) for c in "bse")])
    array_type = T.StructType([T.StructField("k", kind), T.StructField("b", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("ss", "es"))])
    nested = pa.schema([("k", _arrow_type(kind)), ("b", pa.int64()), ("ss", pa.list_(pa.int64())), ("es", pa.list_(pa.int64()))])

    islands = materialize(
        rows.mapInArrow(_combine(flat), row_type).repartition("k", "b").sortWithinPartitions("k", "b").mapInArrow(_keyed(nested), array_type), "islands"
    )
    by_block = Window.partitionBy("k").orderBy("b")
    carried = islands.select("k", "b", F.max(F.element_at("es", -1)).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    # the islands of a block that begin after everything before it has ended ("own"), and the end of what continues into it
    own = F.filter(F.arrays_zip("ss", "es"), lambda x: F.col("carry").isNull() | (x["ss"] > F.col("carry")))
    joined = islands.join(carried, ["k", "b"]).select("k", "b", "carry", "ss", "es", own.alias("own"))
    n, m = F.size("own"), F.size("ss") - F.size("own")
    before = F.greatest(F.col("carry"), F.when(m > 0, F.element_at("es", F.greatest(m, F.lit(1)))))
    total = F.greatest(F.col("carry"), F.element_at("es", -1))
    last = F.when(n > 0, F.element_at("own", -1))
    edge = F.struct(
        F.lit(-1).cast("long").alias("part"), last["ss"].alias("s"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("next"),
        F.when(n > 0, F.struct(F.element_at("own", 1)["ss"].alias("s"), before.alias("before"))).alias("first"), total.alias("total"),
    )
    inner = F.transform(
        F.arrays_zip(F.slice("own", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("own", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("z")),
        lambda x: F.struct(
            F.col("b").alias("part"), x["a"]["ss"].alias("s"), x["a"]["es"].alias("e"), x["z"]["ss"].alias("next"),
            F.lit(None).cast("struct<s:bigint,before:bigint>").alias("first"), F.lit(None).cast("long").alias("total"),
        ),
    )
    # blocks are floors of times and may be negative; the edge rows' own part is told apart by `total`
    pieces = joined.select("k", "b", F.explode(F.concat(F.array(edge), inner)).alias("x")).select("k", "b", "x.*")
    backwards = Window.partitionBy("k", "part", F.col("total").isNull()).orderBy(F.desc("b"))
    pieces = pieces.select(
        "k", "s", "e", "next", F.col("total").isNotNull().alias("is_edge"),
        F.last("first", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
        F.first("total").over(backwards.rowsBetween(Window.unboundedPreceding, 0)).alias("top"),
    ).where(F.col("s").isNotNull())
    e = F.when(F.col("is_edge"), F.coalesce("after.before", "top")).otherwise(F.col("e"))
    nxt = F.when(F.col("is_edge"), F.col("after.s")).otherwise(F.col("next"))
    pieces = pieces.select("k", "s", e.alias("e"), nxt.alias("next"))
    wanted = F.col("next").isNotNull() if max_gap is None else F.col("next") - F.col("e") <= micros_of(max_gap)
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.timestamp_micros(a).alias("start"), F.timestamp_micros(b).alias("end"))
    listed = F.filter(F.array(span("period", F.col("s"), F.col("e")), F.when(wanted, span("gap", F.col("e"), F.col("next")))), lambda x: x.isNotNull())
    return pieces.select(F.col("k").alias(key), F.explode(listed).alias("x")).select(key, "x.kind", "x.start", "x.end")
