"""The page record: one row a page, with its pixels, dots an inch and nested results."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BOX = "x0:double,y0:double,x1:double,y1:double"
_WORD = f"struct<text:string,conf:double,{_BOX}>"
_LINE = f"struct<block:int,baseline:double,{_BOX},words:array<{_WORD}>>"
_CELL = f"struct<row:long,col:long,rowspan:long,colspan:long,text:string,{_BOX}>"
_TABLE = f"struct<{_BOX},source:string,header_rows:long,cells:array<{_CELL}>>"
#: Fields that every page has; stages add columns of their own beside them.
SCHEMA = f"page string, height int, width int, dpi double, grey binary, ink binary, blocks array<struct<{_BOX}>>, lines array<{_LINE}>, tables array<{_TABLE}>, meta map<string,string>, error string"


def evolve(pages: DataFrame, **changes: Column | Any) -> DataFrame:
    """pages with some fields replaced, and the rest untouched; ``meta`` entries are added to those there are.

    A field that a page does not have is an error, so that a misspelt name does not pass for a new result.
    """
    unknown = sorted(set(changes) - set(pages.columns))
    if unknown:
        raise ValueError(f"a page has no {', '.join(unknown)}")
    new = {k: v if isinstance(v, Column) else F.lit(v) for k, v in changes.items() if k != "meta"}
    if "meta" in changes:
        more = F.create_map(*[x for k, v in changes["meta"].items() for x in (F.lit(k), (v if isinstance(v, Column) else F.lit(str(v))).cast("string"))])
        old = F.coalesce("meta", F.create_map().cast("map<string,string>"))
        new["meta"] = F.map_concat(F.map_filter(old, lambda k, v: ~k.isin(*changes["meta"])), more)
    return pages.withColumns(new)


def shape(pages: DataFrame) -> DataFrame:
    """pages with height and width as their pixels say: null where there are neither grey nor ink pixels."""
    some = F.coalesce("grey", "ink")
    return pages.withColumn("height", F.when(some.isNotNull(), F.col("height"))).withColumn("width", F.when(some.isNotNull(), F.col("width")))


def words(pages: DataFrame) -> DataFrame:
    """(page, block, line, word, text, conf, x0, y0, x1, y1) of the pages' lines."""
    line = pages.select("page", F.posexplode("lines").alias("line", "l"))
    word = line.select("page", F.col("l.block").alias("block"), "line", F.posexplode("l.words").alias("word", "w"))
    return word.select("page", "block", "line", "word", "w.text", "w.conf", "w.x0", "w.y0", "w.x1", "w.y1")
