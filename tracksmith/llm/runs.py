"""Problem 3: runs of identical or near-identical consecutive events."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracksmith.functions.geo import haversine, haversine_np
from tracksmith.functions.timebins import micros, micros_of

#: The symbols: code points of the two private-use planes, the sign of a break, and the pattern of a run.
SYMBOLS = np.concatenate([np.arange(0xF0000, 0xFFFFE), np.arange(0x100000, 0x10FFFE)]).astype("<u4")
BREAK = 0xF8FF
RUN = re.compile("([^\uf8ff])\\1*")


def canonical(lat: np.ndarray, lon: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for the canonical event of each event of a sequence: one number for each place, wherever it comes.

    The canonical event of an event within reach of the one before is that one's; any other event is its own.
    """
    first = np.maximum.accumulate(np.where(starts, np.arange(len(lat)), 0))
    places = np.stack([lat[first], lon[first]], 1)
    return np.unique(places, axis=0, return_inverse=True)[1].reshape(-1) if len(lat) else np.zeros(0, np.int64)


def spans_of_runs(events: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans of the runs of a sequence of canonical events, found as back-reference repetitions in a text.

    Each canonical event is a code point, the same wherever it comes, and the text is searched for repetitions of one.
    Where a run begins with the symbol that the one before ends with (a step out of reach that comes back to the same
    canonical event, or the next key), a break stands between them.
    """
    out = []
    for at in range(0, len(events), len(SYMBOLS)):
        # more different events than symbols: parts of as many events, of which a run may go on in the next
        part, new = events[at : at + len(SYMBOLS)], starts[at : at + len(SYMBOLS)]
        codes = np.unique(part, return_inverse=True)[1].reshape(-1)
        breaks = np.nonzero(new[1:] & (codes[1:] == codes[:-1]))[0] + 1
        text = np.insert(SYMBOLS[codes], breaks, BREAK).astype("<u4").tobytes().decode("utf-32-le")
        spans = np.array([m.span() for m in RUN.finditer(text)], np.int64).reshape(-1, 2)
        spans -= np.searchsorted(breaks + np.arange(len(breaks)), spans[:, :1], "left")
        spans += at
        if out and len(spans) and not new[0]:
            spans[0, 0] = out[-1][-1, 0]
            out[-1] = out[-1][:-1]
        out.append(spans)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def collapse_runs(
    df: DataFrame, key: str, time: Column, order: str, lat: Column, lon: Column, within: float = 5.0, chunk: str = "7 days", least: int = 2,
) -> DataFrame:
    """Longest runs of consecutive events of a ``key``, each at most ``within`` metres from the one before.

    ``key, start, end, n, duration_s, lat, lon``: times of the first and last event, how many there are, and where the
    first one is. Events are taken in order of ``time``, then ``order`` (integer), and rows equal in key, time and ``order``
    are one event. Rows without key, time or coordinates are left out. Runs of fewer than ``least`` events are not
    listed (``least=1`` lists the whole sequence, collapsed). An empty table gives no rows. Other columns are ignored.

    A key's events are handled in chunks of time, so a key with very many rows goes to many tasks. The events of a batch
    of rows become canonical (see ``canonical``) and one text of symbols, which is searched at once for repetitions. Runs inside a chunk are final; of the first and the last of
    each chunk a row is kept, and a window over those rows joins the ones that go on.
    """
    kind = df.schema[key].dataType
    size = micros_of(chunk)
    rows = df.select(F.col(key).alias("k"), micros(time).alias("t"), F.col(order).cast("long").alias("o"), lat.alias("la"), lon.alias("lo"))
    rows = rows.where(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("o").isNotNull() & F.col("la").between(-90, 90) & F.col("lo").between(-180, 180))
    rows = rows.select("k", F.floor(F.col("t") / size).cast("long").alias("c"), "t", "o", "la", "lo").repartition("k", "c").sortWithinPartitions("k", "c", "t", "o")
    longs, doubles = ("part", "t0", "o0", "t1", "n", "head", "tail"), ("la0", "lo0", "la1", "lo1")
    schema = T.StructType([T.StructField("k", kind), *(T.StructField(c, T.LongType()) for c in longs), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    arrow = pa.schema([("k", to_arrow_type(kind)), *((c, pa.int64()) for c in longs), *((c, pa.float64()) for c in doubles)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            keys, n = batch.column(0), batch.num_rows
            if not n:
                continue
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            c, t, o, la, lo = (batch.column(i).to_numpy() for i in range(1, 6))
            new_chunk = np.ones(n, bool)
            new_chunk[1:] = (codes[1:] != codes[:-1]) | (c[1:] != c[:-1])
            same = np.zeros(n, bool)
            same[1:] = ~new_chunk[1:] & (t[1:] == t[:-1]) & (o[1:] == o[:-1])
            first = (keys[0].as_py(), c[0], t[0], o[0])
            same[0] = before == first  # goes on with the last row of the batch before
            before = (keys[n - 1].as_py(), c[-1], t[-1], o[-1])
            at = np.nonzero(~same)[0]
            if not len(at):
                continue
            c, t, o, la, lo, codes = c[at], t[at], o[at], la[at], lo[at], codes[at]
            new_chunk = np.ones(len(at), bool)
            new_chunk[1:] = (codes[1:] != codes[:-1]) | (c[1:] != c[:-1])
            starts = new_chunk.copy()
            starts[1:] |= haversine_np(la[:-1], lo[:-1], la[1:], lo[1:]) > within
            spans = spans_of_runs(canonical(la, lo, starts), starts)
            a, z = spans[:, 0], spans[:, 1] - 1
            last_of_chunk = np.concatenate([new_chunk[1:], [True]])
            head, tail = new_chunk[a], last_of_chunk[z]
            keep = head | tail | (z - a + 1 >= least)
            a, z, head, tail = a[keep], z[keep], head[keep], tail[keep]
            columns = [np.where(head | tail, -(2**62), c[a]), t[a], o[a], t[z], z - a + 1, head.astype(np.int64), tail.astype(np.int64), la[a], lo[a], la[z], lo[z]]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at[a])), *(pa.array(x, ty) for x, ty in zip(columns, arrow.types[1:]))], schema=arrow)

    w = Window.partitionBy("k", "part").orderBy("t0", "o0")
    # the first run of a chunk (or batch) goes on with the last one of the chunk before
    goes_on = (F.col("head") == 1) & (F.lag("tail").over(w) == 1) & (F.col("part") == -(2**62)) & (haversine(F.lag("la1").over(w), F.lag("lo1").over(w), F.col("la0"), F.col("lo0")) <= within)
    found = rows.mapInArrow(run, schema).withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    found = found.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "part", "run").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sum("n").alias("n"), F.min_by(F.struct("la0", "lo0"), F.struct("t0", "o0")).alias("p")
    )
    return found.where(F.col("n") >= least).select(
        F.col("k").alias(key), F.timestamp_micros("t0").alias("start"), F.timestamp_micros("t1").alias("end"), "n",
        ((F.col("t1") - F.col("t0")) / 1_000_000).alias("duration_s"), F.col("p.la0").alias("lat"), F.col("p.lo0").alias("lon"),
    )
