"""Rows that can be told apart, and column names that clash with nothing.

A document's id may be null or repeat, so operators that decide over rows number them: ``numbered`` writes the table once, each row
under a number of its own, and everything after reads that table.  Rows are ordered by id (nulls last), then by a hash of the
whole row, then by number, so that only rows equal in every column depend on the numbering.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.staging import materialize


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """wanted, each with a number behind it where the name is taken (letter case does not tell names apart)."""
    used, out = {t.lower() for t in taken}, []
    for base in wanted:
        name, k = base, 0
        while name.lower() in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def row_hash(docs: DataFrame) -> Column:
    """A hash over all columns that can be hashed (maps and variants cannot)."""
    able = [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in able]) if able else F.lit(0).cast("long")


def numbered(docs: DataFrame, row: str, tie: str, name: str = "rows") -> DataFrame:
    """docs as a table of its own, with ``row`` (a number no other row has) and ``tie`` (the hash of the row)."""
    return materialize(docs.select("*", F.monotonically_increasing_id().alias(row), row_hash(docs).alias(tie)), name)


def place(doc_id: str, tie: str, row: str, *more: str) -> Column:
    """What rows are ordered by."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(tie).alias("tie"), F.col(row).alias("row"), *more)
