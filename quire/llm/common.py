"""Words, worker caches and column helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed values of the word rule: a word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for null, empty or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES, -1))


def count_words(text: Column) -> Column:
    """Number of words of a text (long), without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def others(df: DataFrame, new: list[str], drop: tuple[str, ...] = ()) -> list[Column]:
    """Input columns that stay beside ``new`` ones; an input column of the same name (any case) gives way."""
    gone = {n.lower() for n in (*new, *drop)}
    return [col(c) for c in df.columns if c.lower() not in gone]


def schema_with(df: DataFrame, **new: str) -> T.StructType:
    """Schema of ``df`` with further columns (name to type)."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items())])


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """Value kept for the life of a Python worker, whichever task asks (functions travel by value, so their own caches do not last)."""
    store = sys.modules.setdefault("_worker_values", types.ModuleType("_worker_values")).__dict__.setdefault("values", {})
    if key not in store:
        store[key] = make()
    return store[key]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece holds about ``limit`` bytes of ``column``; a longer row is a piece of its own.

    The memory is given back at the end, as the worker waits for its next task with all that it once took.
    """
    for batch in batches:
        at, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)
    batch = lengths = None
    give_back()


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
