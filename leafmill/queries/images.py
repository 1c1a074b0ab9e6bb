"""Pixel operators over pages drawn from the benchmark's texts, every character a solid block, so that SQL knows what must come out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.operators import learning, pixels, vectors
from leafmill.queries.catalog import query
from leafmill.queries.standard import _DIST, _count, _r, _split, _t
from leafmill.sources import documents as D
from leafmill.sources import files

_PAGES = "select item_id, text, length(text) n, length(regexp_replace(text, '\\s', '', 'g')) letters from benchmark"


def pages(spark, sf_dir, change=None) -> DataFrame:
    """(page, height, width, grey): the drawn texts, black on white, after ``change`` (ink, page) -> grey values."""

    def draw(page: int, text: str):
        ink = pixels.block_page(text)
        grey = np.where(ink, 0.0, 1.0) if change is None else change(ink, page)
        return (*grey.shape, np.round(grey * 255).astype(np.uint8).tobytes())

    run = F.udf(draw, "struct<height:int,width:int,grey:binary>", useArrow=True)
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), run("item_id", "text").alias("p")).select("page", "p.*")


@query("page_components", f"select item_id page, letters::bigint n, (letters * 60)::bigint ink from ({_PAGES})")
def page_components(spark, sf_dir):
    """Connected components of each page and their ink, specks taken out first."""

    def specks(ink, page):
        out = ink.copy()
        out[3::7, 2] = True
        return np.where(out, 0.1, 0.9)

    def count(grey, dpi):
        clean = pixels.despeckled(pixels.binarized(grey, "otsu"), dpi)
        c = pixels.components(clean)[1]
        return [(len(c["area"]), int(c["area"].sum()))]

    return pixels.on_images(pages(spark, sf_dir, specks), count, "n long, ink long")


@query("page_threshold", f"select item_id page, (letters * 60)::bigint otsu_ink, (letters * 60)::bigint local_ink from ({_PAGES})")
def page_threshold(spark, sf_dir):
    """Ink by a threshold for the page, and by local ones under a light that falls off to one side."""

    def lit(ink, page):
        return np.where(ink, 0.1, 0.95)

    def count(grey, dpi):
        slope = grey * np.linspace(1.0, 0.5, grey.shape[1])[None, :]
        return [(int(pixels.binarized(grey, "otsu").sum()), int(pixels.binarized(slope, "sauvola", window=41).sum()))]

    return pixels.on_images(pages(spark, sf_dir, lit), count, "otsu_ink long, local_ink long")


@query("page_skew", f"select item_id page, (item_id % 5 - 2.0e0) projection, (item_id % 5 - 2.0e0) votes from ({_PAGES}) where n > 120")
def page_skew(spark, sf_dir):
    """Angle by which pages of three lines and more were sheared, to the nearest degree, by profile and by votes of components."""

    def shear(ink, page):
        y, x = np.nonzero(ink)
        t = np.tan(np.radians(page % 5 - 2))
        out = np.zeros((ink.shape[0] + 80, ink.shape[1]), bool)
        out[np.round(y + 40 - x * t).astype(int), x] = True
        return np.where(out, 0.0, 1.0)

    def angles(grey, dpi):
        ink = grey < 0.5
        return [(float(round(pixels.skew_by_projection(ink, step=1))) + 0.0, float(round(pixels.skew_by_votes(pixels.components(ink)[1]))) + 0.0)]

    long = _t(spark, sf_dir, "benchmark").filter(F.length("text") > 120).select(F.col("item_id").alias("page"))
    return pixels.on_images(pages(spark, sf_dir, shear).join(long, "page", "left_semi"), angles, "projection double, votes double")


@query("page_rules", f"select item_id page, 3::bigint n_rules, 1::bigint n_upright, 1::bigint n_pictures from ({_PAGES})")
def page_rules(spark, sf_dir):
    """Rules across the page, one of them dashed, and one down it; a solid picture is no rule."""

    def ruled(ink, page):
        out = np.pad(ink, ((120, 0), (0, 0)))
        out[5:8, 20:600] = True
        out[15:17, 20:600] = True
        out[15:17, 40:600:40] = False
        out[5:115, 620:622] = True
        out[30:100, 100:260] = True
        return np.where(out, 0.0, 1.0)

    def found(grey, dpi):
        ink = grey < 0.5
        rules = pixels.rulings(ink, dash=3)
        return [(len(rules), sum(not r[4] for r in rules), len(pixels.picture_zones(ink)))]

    return pixels.on_images(pages(spark, sf_dir, ruled), found, "n_rules long, n_upright long, n_pictures long")


@query("page_light", f"select item_id page, true is_flat, 1::bigint n_dark, true put_right from ({_PAGES})")
def page_light(spark, sf_dir):
    """Light made even over a page that darkens to one side, and a region of light type on dark ground found and inverted."""

    def shade(ink, page):
        return np.where(ink, 0.05, 1.0)

    def lift(grey, dpi):
        dark = grey * np.linspace(1.0, 0.6, grey.shape[1])[None, :]
        flat = pixels.flattened(dark)
        h, w = (n // 16 * 16 for n in grey.shape)
        board = np.ones((h + 64, w + 64))
        board[32 : 32 + h, 32 : 32 + w] = 1 - np.where(grey[:h, :w] < 0.5, 0.05, 0.95) if (grey[:h, :w] < 0.5).mean() < 0.3 else 0.05
        plain = board[32 : 32 + h, 32 : 32 + w].copy()
        plain[1::9, 1::9] = 0.9  # some light on every page
        board[32 : 32 + h, 32 : 32 + w] = plain
        regions = pixels.dark_regions(board)
        back = pixels.inverted(board, regions)
        return [(bool(flat[grey > 0.5].min() > 0.9), len(regions), bool(np.allclose(back[32 : 32 + h, 32 : 32 + w], 1 - plain)))]

    return pixels.on_images(pages(spark, sf_dir, shade), lift, "is_flat boolean, n_dark long, put_right boolean")


@query("spread_spines", f"select item_id page, item_id % 2 = 0 is_spread from ({_PAGES})")
def spread_spines(spark, sf_dir):
    """Two pages side by side have a spine in the middle; a single page has none."""

    def facing(ink, page):
        tall = np.pad(ink, ((0, max(0, ink.shape[1] - ink.shape[0])), (0, 0)))
        tall[40:-40:24, 20:-20] = True
        return np.where(np.hstack([tall, tall]) if page % 2 == 0 else tall, 0.0, 1.0)

    def spine(grey, dpi):
        at = pixels.spread_spine(grey < 0.5)
        return [(at is not None and abs(at - grey.shape[1] / 2) < 25,)]

    return pixels.on_images(pages(spark, sf_dir, facing), spine, "is_spread boolean")


@query("type_sizes", f"select item_id page, case when letters >= 30 then 10.0e0 end size, case when letters >= 30 then 3.0e0 else 1.0e0 end scale from ({_PAGES})")
def type_sizes(spark, sf_dir):
    """Height of each page's type, and the scale that it is made larger by; pages of few glyphs have none."""

    def size(grey, dpi):
        return [(pixels.type_size(grey), pixels.magnified(grey, dpi)[1])]

    return pixels.on_images(pages(spark, sf_dir), size, "size double, scale double")


@query("glyph_groups", f"select item_id page, letters::bigint n from ({_PAGES})")
def glyph_groups(spark, sf_dir):
    """Glyphs of each page: every block with a dot set over it is one."""

    def dotted(ink, page):
        out = np.zeros((2 * ink.shape[0], ink.shape[1]), bool)
        out[::2] |= ink
        out[1::2] |= ink
        _, c = pixels.components(out)
        for x, y in zip(c["x0"], c["y0"], strict=True):
            out[y - 4 : y - 2, x + 1 : x + 5] = True
        return np.where(out, 0.0, 1.0)

    def groups(grey, dpi):
        _, c = pixels.components(grey < 0.5)
        boxes = list(zip(*(c[k].tolist() for k in ("x0", "y0", "x1", "y1")), strict=True))
        # Lines apart: only components of one line can be a glyph.
        return [(sum(len(set(pixels.grouped_components([b for b in boxes if b[1] // 32 == row]))) for row in {b[1] // 32 for b in boxes}),)]

    return pixels.on_images(pages(spark, sf_dir, dotted), groups, "n long")



@query("hocr_pages", """with w as (select item_id, unnest(string_split(text, ' ')) w, unnest(range(0, len(string_split(text, ' ')))) i from benchmark), b as (select *, i // 8 line, 100 * (i % 8) x0, 20 * (i // 8) y0, 100 * (i % 8) + 10 * length(w) x1, 20 * (i // 8) + 16 y1 from w where w <> ''),
  s as (select *, '<span class=''ocrx_word'' title=''bbox ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y1 || '; x_wconf ' || (50 + i % 50) || '''>' || replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</span>' h from b),
  l as (select item_id, line, '<span class=''ocr_line'' title=''bbox ' || min(x0) || ' ' || min(y0) || ' ' || max(x1) || ' ' || max(y1) || '''>' || string_agg(h, ' ' order by i) || '</span>' h, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from s group by all),
  a as (select item_id, 'bbox ' || min(x0) || ' ' || min(y0) || ' ' || max(x1) || ' ' || max(y1) box, string_agg(h, '' order by line) h from l group by item_id)
  select item_id page, md5('<!DOCTYPE html><html xmlns=''http://www.w3.org/1999/xhtml''><head><title></title><meta charset=''utf-8''/></head><body><div class=''ocr_page'' title=''' || box || '''><div class=''ocr_carea'' title=''' || box || '''>' || h || '</div></div></body></html>') hocr_md5 from a""")
def hocr_pages(spark, sf_dir):
    """Texts as pages of eight words a line, written as hOCR."""
    w = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split("text", " ")).alias("word", "text")).filter("text <> ''")
    x, y = (100.0 * (F.col("word") % 8)), (20.0 * F.floor(F.col("word") / 8))
    words = w.select("page", F.lit(0).alias("block"), F.floor(F.col("word") / 8).alias("line"), "word", "text", ((50 + F.col("word") % 50) / 100).alias("conf"), x.alias("x0"), y.alias("y0"), (x + 10 * F.length("text")).alias("x1"), (y + 16).alias("y1"))
    return D.hocr(words).select("page", F.md5("hocr").alias("hocr_md5"))


@query("book_texts", "select doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) text_md5 from documents")
def book_texts(spark, sf_dir):
    """Documents framed like books, their bodies in lower case and single blanks."""
    framed = F.concat(F.lit("Preface\n*** START OF THE BOOK ***\n"), F.col("text"), F.lit("\n*** END OF THE BOOK ***\nsmall print"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(files.book_text(framed)).alias("text_md5"))


@query("zone_files", "select l_orderkey page, count(*)::bigint n, sum(l_quantity * l_linenumber)::bigint area from lineitem group by l_orderkey")
def zone_files(spark, sf_dir):
    """Zone files read into corner boxes, lines that are no zones left out."""
    l = _t(spark, sf_dir, "lineitem")
    line = F.concat_ws(" ", F.lit("10 20"), F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"), F.lit("Text"))
    f = l.groupBy(F.col("l_orderkey").alias("page")).agg(F.concat(F.array_join(F.collect_list(line), "\n"), F.lit("\n\nno zone\n1 2\n")).alias("text"))
    z = files.zones(f.withColumn("path", F.col("page").cast("string")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return z.groupBy(F.col("path").cast("long").alias("page")).agg(_count().alias("n"), F.sum(area).cast("long").alias("area"))


@query("verify_files", "select doc_id, case doc_id % 3 when 0 then 'ok' when 1 then 'differs' else 'missing' end state from documents where doc_id is not null")
def verify_files(spark, sf_dir):
    """A manifest of the documents' digests against files of which some changed and some are gone."""
    d = _t(spark, sf_dir, "documents").filter("doc_id is not null").groupBy("doc_id").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    manifest = d.select(name.alias("name"), F.sha2("text", 256).alias("sha256"))
    content = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")
    got = d.filter("doc_id % 3 < 2").select(F.concat(F.lit("/models/"), name).alias("path"), content.alias("content"))
    return files.verify(got, manifest).select(F.regexp_extract("name", "^([0-9]+)", 1).cast("long").alias("doc_id"), "state")


@query(
    "page_jobs",
    """with f as (select page_id, case page_id % 4 when 0 then 'png' when 1 then 'pdf' when 2 then 'JPG' else 'html' end e from pages), j as (select page_id, e, unnest(range(0, case when e = 'pdf' then 3 else 1 end)) p from f where e <> 'html')
  select page_id, p::bigint place, page_id || case when e = 'pdf' then '_p000' || (p + 1) else '' end job_name from j""",
)
def page_jobs(spark, sf_dir):
    """Reading jobs of files: images, pages of PDFs, and others that drop out."""
    kind = F.element_at(F.array(*map(F.lit, ["png", "pdf", "JPG", "html"])), (F.col("page_id") % 4 + 1).cast("int"))
    f = _t(spark, sf_dir, "pages").select(F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit("."), kind).alias("path"))
    counts = f.filter("path like '%.pdf'").select("path", F.lit(3).alias("n_pages"))
    j = files.jobs(f, counts)
    return j.select(F.regexp_extract("path", "/([0-9]+)[.]", 1).cast("long").alias("page_id"), F.col("page").cast("long").alias("place"), F.col("name").alias("job_name"))


@query(
    "prototype_classes",
    f"""with s as (select i, avg(v) m, stddev_pop(v) s from (select unnest(range(0, len(embedding))) i, unnest(embedding)::double v from embeddings where vec_id % 5 <> 0) group by i), f as (select i, m, greatest(s, 0.05e0 * avg(s) over (), 1e-12) s from s),
  z as (select vec_id, label, list((v - m) / s order by i) embedding from (select vec_id, label, unnest(range(0, len(embedding))) i, unnest(embedding)::double v from embeddings) e join f using (i) group by all),
  d as (select a.vec_id query, b.label, min({_DIST}) d from z a, z b where a.vec_id % 5 = 0 and b.vec_id % 5 <> 0 group by all)
  select query query_no, label, round(d, 6) dist, r::bigint rank_no from (select *, row_number() over (partition by query order by d, label) r from d) where r <= 3""",
)
def prototype_classes(spark, sf_dir):
    """Three best classes by the nearest prototype in dimensions scaled by their deviation, floored; every fifth vector is a query."""
    queries, protos = _split(spark, sf_dir)
    scales = vectors.floored_scales(protos)
    near = vectors.nearest_classes(vectors.z_scored(queries, scales), vectors.z_scored(protos, scales), k=3, q=1)
    return near.select(F.col("query").alias("query_no"), "label", _r("dist").alias("dist"), F.col("rank").alias("rank_no"))


@query("condensed_prototypes", "select label, least(count(*), 5)::bigint n from embeddings group by label")
def condensed_prototypes(spark, sf_dir):
    """Five k-means prototypes a class; tested against the classes' own spread."""
    e = _t(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vec"))
    return learning.condensed(e, 5).groupBy("label").agg(_count().alias("n"))
