"""The fourteen features of a transaction, in single precision.

A float times a float stays a float in Spark SQL; a quotient of floats does not and is cast back,
which equals the single-precision quotient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import SCALE, quantize

DIMS = 14
#: What Spark reads of a transaction for them.
INPUTS = 15
#: Vectors of a block, at least, as far as a task has them.
BLOCK_ROWS = 50_000

# Risk by merchant category code; others are UNKNOWN_RISK.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
UNKNOWN_RISK = 0.5

# What features are divided by.
MOST_AMOUNT, MOST_INSTALLMENTS, MOST_RATIO, MOST_HOUR, MOST_WEEKDAY, MOST_MINUTES, MOST_KM, MOST_TX = 10000, 12, 10, 23, 6, 1440, 1000, 20


def single(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def to_single(x: Column) -> Column:
    """A whole number in single precision.  By way of double: the optimiser drops the rounding of int to float to double."""
    return x.cast("double").cast("float")


def clamp(x: Column) -> Column:
    """SC-1."""
    return F.greatest(single(0), F.least(single(1), x))


def _per(x: Column, most: int) -> Column:
    """x times the single-precision reciprocal."""
    return to_single(x) * single(1 / most)


def mcc_risk(mcc: Column) -> Column:
    """SC-2."""
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(F.try_element_at(table, mcc), F.lit(UNKNOWN_RISK)).cast("float")


def units(x: Column) -> Column:
    """Hundred-millionths of a decimal as bigint, what is beyond cut off; null and negative numbers are 0."""
    size = F.greatest(F.coalesce(x.try_cast("decimal(28,18)"), F.lit(0).cast("decimal(28,18)")), F.lit(0).cast("decimal(28,18)"))
    return F.floor(size * F.lit(10**8)).cast("bigint")


def from_units(u: Column) -> Column:
    """SC-3: whole part and first eight decimals without zeros at the end, each rounded to single precision, and their sum."""
    rest = F.pmod(u, F.lit(10**8))
    part = F.when(rest == 0, single(0))
    for n in range(7, -1, -1):  # zeros at the end
        part = part.when(rest % 10**n == 0, (to_single(F.floor(rest / 10**n)) / single(10 ** (8 - n))).cast("float"))
    return to_single(F.floor((u - rest) / 10**8)) + part


def from_decimal(x: Column) -> Column:
    """SC-3 of a decimal."""
    return from_units(units(x))


def to_time(text: Column) -> Column:
    """Timestamps by position: the first 19 characters, whatever zone follows; null if malformed."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def feature_columns(tx: DataFrame) -> list[Column]:
    """d0 .. d13 as smallint from columns amount, installments, requested_at, avg_amount, tx_count_24h,
    known_merchants, merchant_id, mcc, merchant_avg, is_online, card_present, km_from_home, last_at, last_km."""
    c = F.col
    amount, average = c("amount").cast("float"), c("avg_amount").cast("float")
    guarded = F.when(average > 0, average).otherwise(single(1))  # SC-10
    no_last = c("last_at").isNull()
    seconds = to_single(F.unix_timestamp("requested_at") - F.unix_timestamp("last_at"))
    minutes = (seconds / single(60)).cast("float")
    known = F.coalesce(F.array_contains("known_merchants", c("merchant_id")), F.lit(False))  # SC-8
    flag = lambda x: F.when(F.coalesce(x, F.lit(False)), single(1)).otherwise(single(0))
    values = [
        clamp(_per(amount, MOST_AMOUNT)), clamp(_per(c("installments"), MOST_INSTALLMENTS)), clamp(_per((amount / guarded).cast("float"), MOST_RATIO)),
        _per(F.hour("requested_at"), MOST_HOUR), _per(F.weekday("requested_at"), MOST_WEEKDAY),
        F.when(no_last, single(-1)).otherwise(clamp(_per(minutes, MOST_MINUTES))), F.when(no_last, single(-1)).otherwise(clamp(_per(c("last_km"), MOST_KM))),
        clamp(_per(c("km_from_home"), MOST_KM)), clamp(_per(c("tx_count_24h"), MOST_TX)), flag(c("is_online")), flag(c("card_present")), flag(~known), mcc_risk(c("mcc")), clamp(_per(c("merchant_avg"), MOST_AMOUNT)),
    ]
    return [quantize(v).alias(f"d{i}") for i, v in enumerate(values)]


def features(tx: DataFrame, *keys: str) -> DataFrame:
    """The key columns and d0 .. d13."""
    return tx.select(*keys, *feature_columns(tx))


def with_vector(tx: DataFrame, *keys: str) -> DataFrame:
    """The key columns and `v`, the features as one array.  Spark reads types, times and texts; what follows is the arithmetic of
    feature_columns() over blocks of rows, as one expression of all of it is too large for the compiler and some ten times slower."""
    rows = _inputs(tx, *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    return rows.mapInArrow(lambda batches: _vectors(batches, len(keys)), f"{schema}, v array<smallint>")


def vector_blocks(tx: DataFrame, *keys: str) -> DataFrame:
    """The same (whole numbers as keys, no nulls) with some BLOCK_ROWS of them in a row, each column as the bytes of its numbers: passes over all vectors
    read them so in a fraction of the time that rows with arrays take.  opened() makes rows of them in a task."""
    schema = ", ".join(f"`{name}` binary" for name in (*keys, "v"))
    return _inputs(tx, *keys).mapInArrow(lambda batches: _closed(_vectors(batches, len(keys))), schema)


def _inputs(tx: DataFrame, *keys: str) -> DataFrame:
    c = F.col
    average, flag = c("avg_amount").cast("float"), lambda x: F.coalesce(x, F.lit(False))
    inputs = [
        c("amount").cast("float"), to_single(c("installments")), F.when(average > 0, average).otherwise(single(1)), to_single(F.hour("requested_at")), to_single(F.weekday("requested_at")),
        to_single(F.unix_timestamp("requested_at") - F.unix_timestamp("last_at")), to_single(c("last_km")), to_single(c("km_from_home")), to_single(c("tx_count_24h")), flag(c("is_online")), flag(c("card_present")),
        flag(F.array_contains("known_merchants", c("merchant_id"))), mcc_risk(c("mcc")), to_single(c("merchant_avg")), c("last_at").isNull(),
    ]
    # as one array: Spark asks every column for its size at every row that it hands over
    return tx.select(*keys, F.array(*[x.cast("float") for x in inputs]).alias("_x"))


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        if any(rows.column(c).null_count for c in rows.column_names):
            raise ValueError("nulls among keys of vectors")
        columns = [rows.column(c).combine_chunks() for c in rows.column_names]
        held.clear()
        numbers = [(x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False) for x in columns]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], type=pa.binary()) for x in numbers], names=rows.column_names)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield block()
    if held:
        yield block()


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ref_id, label, v) of blocks of them."""
    for batch in batches:
        for ids, label, v in zip(*(batch.column(c) for c in ("ref_id", "label", "v")), strict=True):
            n = len(ids.as_buffer()) // 8
            offsets = pa.array(np.arange(0, DIMS * (n + 1), DIMS, dtype=np.int32))
            values = pa.Array.from_buffers(pa.int16(), DIMS * n, [None, v.as_buffer()])
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.int64(), n, [None, ids.as_buffer()]), pa.Array.from_buffers(pa.int32(), n, [None, label.as_buffer()]), pa.ListArray.from_arrays(offsets, values)], names=["ref_id", "label", "v"])


def _vectors(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    one = np.float32(1)
    per = lambda x, most: x * np.float32(1 / most)
    clamped = lambda x: np.fmax(np.float32(0), np.fmin(one, x))  # noqa: E731  nulls, here NaN, are 1 as greatest() and least() leave them out
    for batch in batches:
        amount, installments, guarded, hour, weekday, seconds, last_km, km, count, online, card, known, risk, merchant, no_last = batch.columns[keys].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, INPUTS).T
        with np.errstate(invalid="ignore", over="ignore"):
            values = [
                clamped(per(amount, MOST_AMOUNT)), clamped(per(installments, MOST_INSTALLMENTS)), clamped(per(amount / guarded, MOST_RATIO)), per(hour, MOST_HOUR), per(weekday, MOST_WEEKDAY),
                np.where(no_last == 1, -one, clamped(per(seconds / np.float32(60), MOST_MINUTES))), np.where(no_last == 1, -one, clamped(per(last_km, MOST_KM))),
                clamped(per(km, MOST_KM)), clamped(per(count, MOST_TX)), online, card, one - known, risk, clamped(per(merchant, MOST_AMOUNT)),
            ]
        v = np.empty((batch.num_rows, DIMS))
        for i, x in enumerate(values):
            v[:, i] = x
        whole = np.trunc(2 * np.fmax(-SCALE, np.fmin(SCALE, v * SCALE)))  # halves, as quantize() rounds them
        out = np.rint(whole * 0.50001).astype(np.int16)
        offsets = pa.array(np.arange(0, DIMS * (len(out) + 1), DIMS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=[*batch.schema.names[:keys], "v"])
