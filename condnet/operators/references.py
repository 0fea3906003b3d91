"""References to records that do not exist: missing, not yet added or already removed at the reference's time.

Method: parents are range-partitioned by key; each range becomes one record of sorted arrays (key, from, until) with overlapping
and touching spans of a key merged. Batches of references are probed by vectorised binary search, and only misses go on.
While all ranges together stay under `BOUND` spans (counted, not guessed) they travel to the references, which then need no
shuffle; beyond that, references go to their range, heavy ranges salted, with the range's arrays repeated per salt.

Defined cases: a null reference or a null time is no case; a null start means since ever, a null end means still there; a
span that ends at or before its start never holds; repeated parents or references count once; without parents every
reference is an orphan. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spans (24 bytes each) up to which the parents' arrays are sent to every task.
BOUND = 1_000_000
#: References of one range that go to one task where the parents are larger than that.
PER_SALT = 2_000_000
EVER, STILL = -(2**62), 2**62
_RANGE = T.StructType([T.StructField("lo", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("since", T.ArrayType(T.LongType())), T.StructField("until", T.ArrayType(T.LongType()))])


def micros(c: Column | str) -> Column:
    """A timestamp (with or without zone) as microseconds of its wall time in UTC sessions."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def parents(df: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """(key, since, until) with the open ends filled in."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(micros(since), F.lit(EVER)).alias("since"), F.coalesce(micros(until), F.lit(STILL)).alias("until")).where("since < until")


def _merged(key: np.ndarray, since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((since, key))
    key, since, until = key[order], since[order], until[order]
    if not len(key):
        return key, since, until
    reach = pd.Series(until).groupby(key).cummax().to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (since[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], since[first], reach[last]


def sorted_ranges(spans: DataFrame, ranges: int) -> DataFrame:
    """One record of sorted arrays per key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got)
        k, s, u = _merged(*(t.column(i).to_numpy() for i in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array([k[0]]), *(pa.array([x]) for x in (k, s, u))], names=_RANGE.names)

    return spans.select("key", "since", "until").repartitionByRange(ranges, "key").mapInArrow(run, _RANGE)


class Probe:
    """Binary search in sorted (key, since, until) arrays with disjoint spans per key."""

    def __init__(self, keys: np.ndarray, since: np.ndarray, until: np.ndarray):
        self.until = until
        self.ids, code = np.unique(keys, return_inverse=True)
        self.times = np.unique(since)
        self.base = len(self.times) + 1
        self.comp = code * self.base + np.searchsorted(self.times, since, "right")

    def there(self, key: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(key), bool)
        k = np.minimum(np.searchsorted(self.ids, key), len(self.ids) - 1)
        i = np.searchsorted(self.comp, k * self.base + np.searchsorted(self.times, at, "right"), "right") - 1
        ok = (self.ids[k] == key) & (i >= 0)
        i = np.maximum(i, 0)
        return ok & (self.comp[i] // self.base == k) & (at < self.until[i])


def orphans(refs: DataFrame, spans: DataFrame, row_id: str, fields: list[str], at: str, bound: int = BOUND) -> DataFrame:
    """(row_id, field, period): every reference in one of the fields whose key isn't in place at the row's time, once per id and field; period is yyyy-MM."""
    spark = refs.sparkSession
    src = refs.where(F.col(at).isNotNull() & F.coalesce(*fields).isNotNull()).select(F.col(row_id).cast("long").alias("row_id"), micros(at).alias("at"), F.substring(F.col(at).cast("string"), 1, 7).alias("period"), *(F.col(f).cast("long").alias(f"f{i}") for i, f in enumerate(fields)))
    out = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("period", T.StringType())])
    n = spans.count()
    if n <= bound:
        rows = sorted_ranges(spans, max(1, n // 50_000)).orderBy("lo").collect()  # at most `bound` spans
        arrays = tuple(np.concatenate([np.asarray(r[c], np.int64) for r in rows] or [np.zeros(0, np.int64)]) for c in ("keys", "since", "until"))
        sent = spark.sparkContext.broadcast(arrays)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Probe(*sent.value)
            for b in batches:
                t = b.column(1).to_numpy()
                for i, f in enumerate(fields):
                    c = b.column(3 + i)
                    ok = c.is_valid().to_numpy(zero_copy_only=False)
                    miss = np.flatnonzero(ok & ~probe.there(c.fill_null(0).to_numpy(), t))
                    if len(miss):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(miss)), pa.array([f] * len(miss)), b.column(2).take(pa.array(miss))], names=out.names)

        found = src.mapInArrow(run, out)
    else:
        long = src.select("row_id", "at", "period", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("key")) for i, f in enumerate(fields)))).alias("x")).select("row_id", "at", "period", "x.field", "x.key").where("key is not null")
        found = _apart(long, spans, max(8, n // max(1, bound) * 8))
    return found.dropDuplicates(["row_id", "field", "period"])


def _apart(long: DataFrame, spans: DataFrame, ranges: int) -> DataFrame:
    """The same where the parents don't fit: references go to the ranges."""
    from condnet.common import materialize

    spark = long.sparkSession
    stored = materialize(sorted_ranges(spans, ranges), "ranges")
    lows = np.array(sorted(r["lo"] for r in stored.select("lo").collect()), np.int64)  # one number per range
    sent = spark.sparkContext.broadcast(lows)
    with_range = T.StructType([*long.schema.fields, T.StructField("lo", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = np.maximum(np.searchsorted(sent.value, b.column(4).to_numpy(), "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value[i])], names=with_range.names)

    placed = long.mapInArrow(assign, with_range)
    salts = placed.groupBy("lo").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    placed = placed.join(F.broadcast(salts), "lo").withColumn("salt", F.pmod(F.xxhash64("row_id", "field"), F.col("salts")).cast("int"))
    repeated = stored.join(F.broadcast(salts), "lo").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    out = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("period", T.StringType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda c: np.asarray(right.column(c)[0].values) if len(right) else np.zeros(0, np.int64)
        miss = ~Probe(get("keys"), get("since"), get("until")).there(left.column("key").to_numpy(), left.column("at").to_numpy())
        return left.filter(pa.array(miss)).select(out.names)

    return placed.groupBy("lo", "salt").cogroup(repeated.groupBy("lo", "salt")).applyInArrow(run, out)
