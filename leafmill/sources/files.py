"""Files: scans into jobs, texts, truth pairs, zone files, release manifests, and files written from columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IMAGES = ["png", "tif", "tiff", "jpg", "jpeg", "bmp"]
#: Fixed patterns: what frames the body of a public-domain book.
BOOK_START, BOOK_END = r"(?s)\A.*?\*\*\* ?START OF[^\n]*\n", r"(?s)\*\*\* ?END OF.*\z"


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def stem(path: Column) -> Column:
    """A path's last part without its ending."""
    return F.regexp_replace(_name(path), r"[.][^.]*$", "")


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.]([^./]+)$", 1))


def listing(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files under paths; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return r.load(paths).select("path", "length", F.col("modificationTime").alias("modified"))


def jobs(files: DataFrame, pages: DataFrame | None = None, wanted: list[int] | None = None) -> DataFrame:
    """(place, path, page, name): a job for each image, and for each page of a PDF; other files drop out.

    pages (path, n_pages) counts the pages of PDFs (one if it does not know a file); ``wanted`` picks pages, from 0.  Names are the
    stems, with the page behind where a PDF gives more than one; jobs stand in the order of folder, file and page.
    """
    f = files.select("path").withColumn("kind", ending(F.col("path"))).filter(F.col("kind").isin(*IMAGES, "pdf"))
    f = f.join(pages, "path", "left") if pages is not None else f.withColumn("n_pages", F.lit(1))
    last = F.when(F.col("kind") == "pdf", F.coalesce("n_pages", F.lit(1))).otherwise(1)
    each = f.select("path", "kind", F.explode(F.sequence(F.lit(0), (last - 1).cast("int"))).alias("page"), last.alias("n"))
    if wanted is not None:
        each = each.filter((F.col("kind") != "pdf") | F.col("page").isin(*wanted))
    name = F.when((F.col("kind") == "pdf") & (F.col("n") > 1), F.format_string("%s_p%04d", stem(F.col("path")), F.col("page") + 1)).otherwise(stem(F.col("path")))
    place = F.struct(F.regexp_extract("path", "^(.*/)", 1).alias("folder"), _name(F.col("path")).alias("file"), "page")
    return each.select(place.alias("place"), "path", "page", name.alias("name"))


def corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole .txt files: what frames a book cut off, lower-cased, white space made even."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return t.select("path", book_text(F.col("text")).alias("text"))


def book_text(text: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(text, BOOK_START, ""), BOOK_END, "")
    return F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))


def truth_pairs(images: DataFrame, texts: DataFrame) -> DataFrame:
    """(stem, image, truth): images (path) with the texts (path, text) of the same folder and stem; those without one drop out."""
    key = lambda: F.regexp_replace("path", r"[.][^./]*$", "")
    i = images.filter(ending(F.col("path")).isin(*IMAGES)).select(key().alias("key"), F.col("path").alias("image"))
    return i.join(texts.select(key().alias("key"), F.col("text").alias("truth")), "key").select(stem(F.concat("key", F.lit(".x"))).alias("stem"), "image", "truth")


def zones(files: DataFrame) -> DataFrame:
    """(path, zone, x0, y0, x1, y1, kind) of zone files (path, text), a line ``x y w h [kind]`` a zone; other lines are left out."""
    line = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("zone", "line"))
    p = line.withColumn("p", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))
    x, y, w, h = (F.get("p", F.lit(k)).try_cast("double") for k in range(4))
    out = p.select("path", F.col("zone").cast("long").alias("zone"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), F.coalesce(F.get("p", F.lit(4)), F.lit("")).alias("kind"))
    return out.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def verify(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, sha256, found, state): manifest (name, sha256) against files (path, content): 'ok', 'differs' or 'missing'."""
    got = files.select(_name(F.col("path")).alias("name"), F.sha2("content", 256).alias("found"))
    j = manifest.select("name", F.lower("sha256").alias("sha256")).join(got, "name", "left")
    return j.select("*", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("differs").alias("state"))


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes a file a row under folder (any URI that Arrow's file systems know) and gives (name, bytes, sha256) of what was written.

    The result is lazy, as any table: the files are written when it is.  A task that runs again writes the same files again, whole
    ones under a passing name first, so that no reader meets half a file.  Rows of one name overwrite each other; null contents are
    left out; names must not lead out of the folder.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        made = set()
        for b in batches:
            names, sizes, digests = [], [], []
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n is None or c is None:
                    continue
                if n.startswith("/") or ".." in n.split("/"):
                    raise ValueError(f"file name {n!r} leads out of the folder")
                path = f"{root.rstrip('/')}/{n}"
                up = path.rpartition("/")[0]
                if up not in made:
                    system.create_dir(up, recursive=True)
                    made.add(up)
                passing = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(passing) as out:
                    out.write(c)
                system.move(passing, path)
                names.append(n)
                sizes.append(len(c))
                digests.append(hashlib.sha256(c).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["name", "bytes", "sha256"])

    return df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(put, "name string, bytes long, sha256 string")


def batch_summary(pages: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: pages, failed, pages a minute (of the batch's seconds), mean seconds and mean probability of the pages that did not fail.

    pages (error, seconds, p_correct): a page that failed has an error and stops nothing.
    """
    ok = F.col("error").isNull()
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    rate = F.count("*") * 60 / F.lit(seconds) if seconds else F.lit(None).cast("double")
    return pages.agg(F.count("*").alias("pages"), F.count("error").alias("failed"), rate.alias("pages_per_minute"), mean("seconds").alias("mean_seconds"), mean("p_correct").alias("mean_p_correct"))


def drawn(df: DataFrame, keys: list[str], item: str, n: int, seed: int) -> DataFrame:
    """n rows of each group in the order of a seeded digest of the item."""
    from leafmill.operators import ranks

    own = df.withColumn("_d", F.md5(F.concat(F.lit(f"{seed}-"), F.col(item).cast("string"))))
    return ranks.top_ranked(own, keys, [F.col("_d"), F.col(item)], n, [item]).drop("_d")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
