"""Helpers shared by the text operators: Arrow batches as bytes, bounded
slices, stable row keys, checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that a task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20


def keyed(df: DataFrame, **cols: str) -> DataFrame:
    """``_row`` (a key of each row of a stored table: partition number and
    place in it) plus ``new=old`` columns. Other columns are left behind, so
    clashing names cannot matter. Only scans that split the files alike give
    the same keys: what is joined to the rows again needs a stored key."""
    return df.select(F.monotonically_increasing_id().alias("_row"),
                     *[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def as_bytes(column) -> list:
    """A string column as a list of UTF-8 bytes (None for null)."""
    return column.cast(pa.binary()).to_pylist()


def cut(batches, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task turns a few MB of
    texts into Python objects at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of ``texts`` of about ``limit`` bytes;
    a longer text makes a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def packed(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end, each behind one space, as uint8; and the place
    of each text's first byte."""
    lens = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    first = np.cumsum(lens + 1) - lens
    return np.frombuffer(b" " + b" ".join(t or b"" for t in texts), np.uint8), first


def quoted(name: str) -> str:
    """A column name as it stands, dots and backquotes included."""
    return "`" + name.replace("`", "``") + "`"


def handed_through(docs: DataFrame, text_col: str, carry: list[str] | None, result: str):
    """For an operator over Arrow batches that adds the columns ``result``
    (DDL) to the columns ``carry`` of ``docs`` (all by default).

    Returns the table for the tasks (the carried columns as ``c0, c1, ...`` and
    the text as ``text``, so no name of ``docs`` can meet one of the operator),
    the names of the carried ones, the schema of what the tasks return, and a
    function that gives the columns their names back. Columns of ``docs`` with a
    result's name, in any case, are left out, as the result replaces them."""
    new = StructType.fromDDL(result)
    taken = {f.name.lower() for f in new}
    names = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in taken]
    private = [f"c{i}" for i in range(len(names))]
    table = docs.select(*[F.col(quoted(c)).alias(p) for c, p in zip(names, private)], F.col(quoted(text_col)).alias("text"))
    schema = StructType([*table.schema.fields[:-1], *new.fields])

    def named(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(p).alias(c) for c, p in zip(names, private)], *new.names)

    return table, dict(zip(names, private)), schema, named
