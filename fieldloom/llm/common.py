"""Small helpers of the corpus operators: labelled samples, and Arrow text as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
FILTER_BITS = 1 << 25


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True for rows whose labels must not be learned: crc32 of the id as text, modulo ``folds``, is 0. A null id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % folds == 0, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``rows`` learnable labels, the smallest by a hash of the id.

    Rows without id or label, or with a label other than 0 and 1, are left out; an id that is labelled twice takes the smaller label.
    """
    usable = labels.select(F.col(id_col), F.col(label).cast("int").alias("label")).where(
        F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & ~held_out(id_col))
    return usable.groupBy(id_col).agg(F.min("label").alias("label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)


def unused(name: str, taken) -> str:
    """``name``, with underscores added until it clashes with no column."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, so that temporary arrays stay small whatever the batch size."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (one more entry than texts). The array has no nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    begins = np.frombuffer(places, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[begins[0]:begins[-1]], begins - begins[0]


def pieces_of(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array that are not empty strings, and the list each belongs to."""
    values, owner = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(values), 0)
    return values.filter(full), owner[full.to_numpy(zero_copy_only=False)]


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of string values, and the dictionary."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (fixed odd multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: scattered (place, byte) pairs, summed per string."""
    data, at = bytes_of(values)
    size = np.diff(at)
    if len(data) == 0:
        return mix(np.ones(len(size), np.uint64))
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((place.astype(np.uint64) << np.uint64(8)) + data + np.uint64(1)))])
    return mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64) + np.uint64(1))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of an array, in order."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def bit_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def bit_table(keys: DataFrame) -> np.ndarray:
    """A table of constant size in which the bit of every key (the only column) is set."""
    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bit_of(batch.column(0).to_numpy()))], ["bit"])

    words = (keys.mapInArrow(mark, "bit long").groupBy(F.floor(F.col("bit") / 64).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("bits")).toArrow())
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint8)


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = bit_of(keys)
    return (table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
