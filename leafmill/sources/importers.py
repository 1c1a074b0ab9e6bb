"""Annotated sets of forms, receipts and tables read into words, boxes and table HTML: one shape whatever the set.

Words are (doc, item, word, text, x0, y0, x1, y1, label), boxes (doc, item, label, x0, y0, x1, y1); doc is the file's stem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources.files import stem

_DOUBLES = "array<double>"


def _doc() -> Column:
    return stem(F.input_file_name()).alias("doc")


def forms(spark: SparkSession, path: str) -> DataFrame:
    """Words of form files: JSON with ``form`` fields that have a label and ``words`` of text and box [x0, y0, x1, y1]."""
    schema = f"form array<struct<id:long,label:string,words:array<struct<box:{_DOUBLES},text:string>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(_doc(), F.posexplode("form").alias("item", "f"))
    w = f.select("doc", F.coalesce("f.id", "item").alias("item"), F.col("f.label").alias("label"), F.posexplode("f.words").alias("word", "w"))
    box = [F.get("w.box", F.lit(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]
    return w.filter("trim(w.text) <> ''").select("doc", "item", F.col("word").cast("long").alias("word"), F.col("w.text").alias("text"), *box, "label")


def receipts_lines(spark: SparkSession, path: str) -> DataFrame:
    """Words of receipt files: a line ``x1,y1,x2,y2,x3,y3,x4,y4,text`` for each line of print; the box is the corners' hull."""
    t = spark.read.text(path, wholetext=True).select(_doc(), F.posexplode(F.split("value", r"\r?\n")).alias("item", "line"))
    p = t.withColumn("p", F.split("line", ",", 9)).filter(F.size("p") == 9)
    at = [F.get("p", F.lit(k)).try_cast("double") for k in range(8)]
    x, y = at[0::2], at[1::2]
    out = p.select("doc", F.col("item").cast("long").alias("item"), F.lit(0).cast("long").alias("word"), F.get("p", F.lit(8)).alias("text"), F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"), F.lit(None).cast("string").alias("label"))
    return out.filter("x0 is not null and y0 is not null")


def receipts_groups(spark: SparkSession, path: str) -> DataFrame:
    """Words of receipt files in JSON: ``valid_line`` of a category with ``words`` that have corners (quad) and a row."""
    quad = ",".join(f"{c}{k}:double" for k in range(1, 5) for c in "xy")
    schema = f"valid_line array<struct<category:string,group_id:long,words:array<struct<quad:struct<{quad}>,text:string,row_id:long>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(_doc(), F.posexplode("valid_line").alias("item", "f"))
    w = f.select("doc", F.col("item").cast("long").alias("item"), F.col("f.category").alias("label"), F.posexplode("f.words").alias("word", "w"))
    xs, ys = ([F.col(f"w.quad.{c}{k}") for k in range(1, 5)] for c in "xy")
    return w.select("doc", "item", F.col("word").cast("long").alias("word"), F.col("w.text").alias("text"), F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"), "label")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of annotation files in XML: ``object`` elements with a name and a ``bndbox``."""
    box = "bndbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    schema = f"object array<struct<name:string,{box.replace('bndbox ', 'bndbox:')}>>"
    f = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).select(_doc(), F.posexplode("object").alias("item", "o"))
    b = F.col("o.bndbox")
    return f.select("doc", F.col("item").cast("long").alias("item"), F.col("o.name").alias("label"), b["xmin"].alias("x0"), b["ymin"].alias("y0"), b["xmax"].alias("x1"), b["ymax"].alias("y1"))


def table_records(spark: SparkSession, path: str) -> DataFrame:
    """(doc, split, html, n_cells, cells) of table sets: a JSON line a table with structure tokens and, for each cell, its own tokens.

    A cell's text goes behind its opening tag: ``<td>``, or the ``>`` that ends a tag with spans.  cells: (cell, text, x0, y0, x1, y1),
    boxes null where the set has none.
    """
    schema = f"filename string, split string, html struct<structure:struct<tokens:array<string>>,cells:array<struct<tokens:array<string>,bbox:{_DOUBLES}>>>"
    t = spark.read.schema(schema).json(path)
    tokens, cells = F.col("html.structure.tokens"), F.col("html.cells")
    opens = lambda x: x.isin("<td>", "<th>", ">")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        own = F.when(opens(x), F.coalesce(F.array_join(F.get(cells, s["n"])["tokens"], ""), F.lit(""))).otherwise("")
        return F.struct(F.concat(s["out"], x, own).alias("out"), (s["n"] + F.when(opens(x), 1).otherwise(0)).alias("n"))

    html = F.aggregate(tokens, start, step)["out"]
    text = lambda c: F.regexp_replace(F.array_join(c["tokens"], ""), "<[^>]*>", "")
    one = F.transform(cells, lambda c, i: F.struct(i.cast("long").alias("cell"), text(c).alias("text"), *[F.get(c["bbox"], F.lit(k)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]))
    return t.select(stem(F.col("filename")).alias("doc"), "split", F.concat(F.lit("<table>"), html, F.lit("</table>")).alias("html"), F.size(cells).alias("n_cells"), one.alias("cells"))
