"""Files, images, PDF pages, annotated sets, documents, the command line and the landing folder, on small files made here."""

import csv
import html.parser
import io
import json
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill import cli
from leafmill.plans import page, profile, runner, stages
from leafmill.sources import documents, files, images, importers, pdf
from leafmill.streaming import landing


def _png(path, px, dpi=None):
    path.write_bytes(images.encode(px, dpi))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    r = np.random.default_rng(1)
    _png(at / "a.png", r.integers(0, 256, (7, 11), dtype=np.uint8), 200)
    _png(at / "b.PNG", r.integers(0, 256, (5, 4, 3), dtype=np.uint8))
    (at / "c.png").write_bytes(b"no image")
    (at / "a.txt").write_text("truth of a")
    (at / "x.txt").write_text("no image of it")
    (at / "a.uzn").write_text("10 20 30 40 Text\nbad line\n1 2 3 4\n")
    return at


def test_images_round_trip(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, f"file://{folder}/*.[pP][nN][gG]").collect()}
    assert set(got) == {"a.png", "b.PNG"}
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (7, 11), dtype=np.uint8)
    b = r.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    assert (got["a.png"].height, got["a.png"].width, got["a.png"].dpi) == (7, 11, 200.0) and bytes(got["a.png"].grey) == a.tobytes()
    want = np.round(b.astype(float) @ np.array(images.LUMA))
    assert got["b.PNG"].dpi == 300 and np.abs(np.frombuffer(bytes(got["b.PNG"].grey), np.uint8).reshape(5, 4) - want).max() <= 1
    again = spark.createDataFrame([got["a.png"]], images.SCHEMA).select(images.png(F.col("height"), F.col("width"), F.col("grey"), F.col("dpi")).alias("p")).first().p
    assert bytes(again) == (folder / "a.png").read_bytes()
    ink = images.encode(np.array([[True, False]]))
    assert zlib.decompress(ink[ink.index(b"IDAT") + 4 : -16]) == b"\0\0\xff"
    assert images.jpeg_dpi(b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\1\0\x96\0\x96") == 150 and images.png_dpi(b"") == 300


def test_jobs_pairs_zones_and_manifest(spark, folder):
    listed = files.listing(spark, [f"file://{folder}"])
    more = listed.select("path").unionByName(spark.createDataFrame([("file:/z/doc.pdf",)], "path string"))
    pages = spark.createDataFrame([("file:/z/doc.pdf", 3)], "path string, n_pages int")
    j = files.jobs(more, pages, wanted=[0, 2]).orderBy("place").collect()
    assert [(r.name, r.page) for r in j] == [("a", 0), ("b", 0), ("c", 0), ("doc_p0001", 0), ("doc_p0003", 2)]
    texts = spark.read.text(f"file://{folder}/*.txt", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    assert [tuple(r)[0::2] for r in files.truth_pairs(listed.withColumn("path", plain), texts.withColumn("path", plain)).collect()] == [("a", "truth of a")]
    z = files.zones(spark.read.text(f"file://{folder}/*.uzn", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))
    assert [tuple(r)[1:] for r in z.orderBy("zone").collect()] == [(0, 10, 20, 40, 60, "Text"), (2, 1, 2, 4, 6, "")]
    import hashlib

    sha = hashlib.sha256((folder / "a.txt").read_bytes()).hexdigest()
    m = spark.createDataFrame([("a.txt", sha.upper()), ("x.txt", sha), ("gone.txt", sha)], "name string, sha256 string")
    got = files.verify(spark.read.format("binaryFile").load(f"file://{folder}/*.txt"), m)
    assert {r.name: r.state for r in got.collect()} == {"a.txt": "ok", "x.txt": "differs", "gone.txt": "missing"}


def test_corpus_text(spark, tmp_path):
    (tmp_path / "book.txt").write_text("Foreword\n*** START OF THIS BOOK ***\nOnce  Upon\n\na Time\n*** END OF THIS BOOK ***\nlicence")
    (tmp_path / "plain.txt").write_text(" All\tOf it ")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.corpus_text(spark, f"file://{tmp_path}").collect()}
    assert got == {"book.txt": "once upon a time", "plain.txt": "all of it"}


def test_written_files(spark, tmp_path):
    df = spark.createDataFrame([("p/one.txt", bytearray(b"1")), ("two.bin", bytearray(b"")), ("none", None)], "name string, content binary")
    got = files.write_files(df, f"file://{tmp_path}/out").collect()
    assert {(r.name, r.bytes) for r in got} == {("p/one.txt", 1), ("two.bin", 0)}
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["one.txt", "two.bin"] and (tmp_path / "out/p/one.txt").read_bytes() == b"1"
    with pytest.raises(Exception, match="leads out"):
        files.write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary"), f"file://{tmp_path}/out").collect()
    d = files.drawn(spark.range(50).withColumn("k", F.col("id") % 2), ["k"], "id", 3, 7)
    assert d.count() == 6 and [tuple(r) for r in d.orderBy("k", "rank").collect()] == [tuple(r) for r in files.drawn(spark.range(50).repartition(7).withColumn("k", F.col("id") % 2), ["k"], "id", 3, 7).orderBy("k", "rank").collect()]


def _pdf(parts, packed=False):
    """A file of pages that show rasters: (width of the page in points, [(pixels, kind)])."""
    objects, kids, n = [], [], 10
    for k, (points, rasters) in enumerate(parts):
        names = []
        for j, (px, kind) in enumerate(rasters):
            h, w = px.shape[:2]
            space = "DeviceRGB" if px.ndim == 3 else "DeviceGray"
            raw, how, bits = px.tobytes(), "", 8
            if kind == "bits":
                raw, bits = np.packbits(px > 0, axis=1).tobytes(), 1
            if kind != "raw":
                raw, how = zlib.compress(raw), "/Filter /FlateDecode"
            objects.append((n, f"<< /Type /XObject /Subtype /Image /Width {w} /Height {h} /BitsPerComponent {bits} /ColorSpace /{space} {how} /Length {len(raw)} >>", raw))
            names.append(f"/Im{j} {n} 0 R")
            n += 1
        objects.append((n, f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {points} 100] /Resources << /XObject << {' '.join(names)} >> >> >>", None))
        kids.append(f"{n} 0 R")
        n += 1
    plain = [(1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>")]
    out = b"%PDF-1.5\n"
    if packed:
        body, places = "", []
        for number, text in plain:
            places.append(f"{number} {len(body)}")
            body += text + " "
        head = " ".join(places) + " "
        raw = zlib.compress((head + body).encode())
        objects.append((5, f"<< /Type /ObjStm /N 2 /First {len(head)} /Filter /FlateDecode /Length {len(raw)} >>", raw))
    else:
        objects += [(number, text, None) for number, text in plain]
    for number, text, raw in objects:
        out += f"{number} 0 obj\n{text}\n".encode() + (b"stream\n" + raw + b"\nendstream\n" if raw is not None else b"") + b"endobj\n"
    return out + b"%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_pages(spark, tmp_path, packed):
    r = np.random.default_rng(3)
    big, small = r.integers(0, 256, (20, 30), dtype=np.uint8), r.integers(0, 256, (4, 5), dtype=np.uint8)
    colour, bits = r.integers(0, 256, (6, 9, 3), dtype=np.uint8), (r.integers(0, 2, (3, 13)) * 255).astype(np.uint8)
    (tmp_path / "s.pdf").write_bytes(_pdf([(72, [(small, "flate"), (big, "raw")]), (36, [(colour, "flate")]), (72, []), (144, [(bits, "bits")])], packed))
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    got = {(x.path.rsplit("/", 1)[1], x.page): x for x in pdf.read_pages(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {("s.pdf", 0), ("s.pdf", 1), ("s.pdf", 2), ("s.pdf", 3), ("broken.pdf", 0)}
    for k, px in ((0, big), (1, colour), (3, bits)):
        g = got["s.pdf", k]
        assert g.error is None and bytes(g.content) == images.encode(px, g.dpi)
    assert [got["s.pdf", k].dpi for k in (0, 1, 3)] == [30.0, 18.0, 6.5]
    assert "no image" in got["s.pdf", 2].error and "no PDF" in got["broken.pdf", 0].error


def test_annotated_sets(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"form": [{"id": 4, "label": "question", "words": [{"box": [1, 2, 3, 4], "text": "Name:"}, {"box": [5, 2, 6, 4], "text": " "}]}]}))
    assert [tuple(r) for r in importers.forms(spark, f"file://{tmp_path}/f.json").collect()] == [("f", 4, 0, "Name:", 1, 2, 3, 4, "question")]
    (tmp_path / "r.txt").write_text("1,2,9,2,9,5,1,5,TOTAL, 4.50\nbroken\n")
    assert [tuple(r) for r in importers.receipts_lines(spark, f"file://{tmp_path}/r.txt").collect()] == [("r", 0, 0, "TOTAL, 4.50", 1, 2, 9, 5, None)]
    quad = {f"{c}{k}": v for k, (x, y) in enumerate([(1, 1), (7, 2), (7, 6), (1, 5)], 1) for c, v in (("x", x), ("y", y))}
    (tmp_path / "c.json").write_text(json.dumps({"valid_line": [{"category": "menu.nm", "group_id": 3, "words": [{"quad": quad, "text": "Tea", "row_id": 1}]}]}))
    assert [tuple(r) for r in importers.receipts_groups(spark, f"file://{tmp_path}/c.json").collect()] == [("c", 0, 0, "Tea", 1, 1, 7, 6, "menu.nm")]
    (tmp_path / "v.xml").write_text("<annotation><object><name>table</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3.5</xmax><ymax>4</ymax></bndbox></object><object><name>row</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>1</xmax><ymax>1</ymax></bndbox></object></annotation>")
    assert [tuple(r) for r in importers.annotations(spark, f"file://{tmp_path}/v.xml").orderBy("item").collect()] == [("v", 0, "table", 1, 2, 3.5, 4), ("v", 1, "row", 0, 0, 1, 1)]
    t = {"filename": "p.png", "split": "val", "html": {"structure": {"tokens": ["<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "<tr>", "<td>", "</td>", "<td>", "</td>", "</tr>"]}, "cells": [{"tokens": ["<b>", "A", "</b>"], "bbox": [1, 2, 3, 4]}, {"tokens": []}, {"tokens": ["b", "c"], "bbox": [5, 6, 7, 8]}]}}
    (tmp_path / "t.jsonl").write_text(json.dumps(t) + "\n")
    g = importers.table_records(spark, f"file://{tmp_path}/t.jsonl").first()
    assert (g.doc, g.split, g.n_cells) == ("p", "val", 3) and g.html == '<table><tr><td colspan="2"><b>A</b></td></tr><tr><td></td><td>bc</td></tr></table>'
    assert [(c.text, c.x0) for c in g.cells] == [("A", 1), ("", None), ("bc", 5)]


class _Tags(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.seen = []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, dict(attrs)))

    def handle_data(self, data):
        self.seen.append(data)


CELLS = "table int, row long, col long, text string, rowspan long, colspan long, state string"


def test_tables_as_documents(spark):
    rows = [(1, 0, 0, "A<b>", 1, 2, None), (1, 1, 0, "x", 1, 1, None), (1, 1, 1, "5", 1, 1, "ok"), (2, 0, 0, "in", 1, 1, None), (2, 0, 1, "7", 1, 1, "fail"), (3, 0, 0, 'deep "q", r', 1, 1, None)]
    cells = spark.createDataFrame(rows, CELLS)
    nested = spark.createDataFrame([(2, 1, 1, 0), (3, 2, 0, 0)], "child int, table int, row long, col long")
    got = documents.table_html(cells, nested).collect()
    assert [r.table for r in got] == [1]
    p = _Tags()
    p.feed(got[0].html)
    assert [t if isinstance(t, str) else t[0] for t in p.seen] == ["table", "tr", "th", "A<b>", "tr", "td", "x", "table", "tr", "td", "in", "table", "tr", "td", 'deep "q", r', "td", "7", "td", "5"]
    assert ("th", {"scope": "col", "colspan": "2"}) in p.seen and ("td", {"class": "ok"}) in p.seen and ("td", {"class": "fail"}) in p.seen
    block = {r.table: r.csv for r in documents.table_csv(cells.filter("table <> 2")).collect()}
    assert block[1].startswith("# Table 1\n") and list(csv.reader(io.StringIO(block[1].split("\n", 1)[1]))) == [["A<b>", ""], ["x", "5"]]
    assert list(csv.reader(io.StringIO(block[3].split("\n", 1)[1]))) == [['deep "q", r']]
    j = json.loads({r.table: r.json for r in documents.table_json(cells).collect()}[1])
    assert (j["n_rows"], j["n_cols"], j["header_rows"], j["cells"][0]["colspan"]) == (2, 2, 1, 2)
    tops = spark.createDataFrame([(1, 1, 0.0, 9.0), (1, 4, 0.0, 2.0), (1, 2, 0.0, 9.0)], "page int, table int, x0 double, y0 double")
    assert {r.table: r.number for r in documents.numbered_tables(tops, nested.filter("child = 2")).collect()} == {4: "1", 1: "2", 2: "2.1"}


def test_hocr_and_bundle(spark):
    w = [("p", 0, 0, 0, "A&B", 0.934, 1.0, 2.0, 9.0, 8.0, None), ("p", 0, 0, 1, "c", 0.5, 10.0, 2.0, 12.0, 9.0, False), ("p", None, 1, 0, "last", 1.0, 0.0, 50.0, 5.0, 60.0, None), ("p", 0, 2, 0, "smudge", 0.1, 0.0, 0.0, 1.0, 1.0, True)]
    words = spark.createDataFrame(w, "page string, block int, line int, word int, text string, conf double, x0 double, y0 double, x1 double, y1 double, graphic boolean")
    extras = spark.createDataFrame([("p", 0, "<table><tr><td>t</td></tr></table>")], "page string, place int, html string")
    h = documents.hocr(words, extras).first().hocr
    p = _Tags()
    p.feed(h)
    assert [x for x in p.seen if isinstance(x, str) and x.strip()] == ["A&B", "c", "last", "t"]
    titles = [(t[1]["class"], t[1]["title"]) for t in p.seen if not isinstance(t, str) and "title" in t[1]]
    assert titles[0] == ("ocr_page", "bbox 0 2 12 60") and ("ocrx_word", "bbox 1 2 9 8; x_wconf 93") in titles and sum(c == "ocr_carea" for c, _ in titles) == 2
    df = spark.createDataFrame([("p", h, bytearray(b"png"))], "page string, h string, image binary")
    b = df.select(documents.bundle((F.concat("page", F.lit(".hocr")), documents.name_image(F.col("h"), F.lit("p.png"))), (F.lit("p.png"), F.col("image")), (F.lit("none"), F.lit(None))).alias("z")).first().z
    z = zipfile.ZipFile(io.BytesIO(bytes(b)))
    assert z.namelist() == ["p.hocr", "p.png"] and z.read("p.png") == b"png" and b'title=\'image "p.png"; bbox' in z.read("p.hocr")
    lines = spark.createDataFrame([(1, 1, 0, "c"), (1, 0, 1, "b"), (1, 0, 0, "a")], "page int, block int, line int, text string")
    assert documents.reading_text(lines).first().text == "a\nb\n\nc"


def test_boxes_back_to_the_source(spark):
    """Against turning and scaling the corner points by hand."""
    w, h, box = 400.0, 300.0, (30.0, 40.0, 90.0, 70.0)
    for turns in range(4):
        b = {k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)}
        got = spark.range(1).select(*images.to_source(b, F.lit(w), F.lit(h), F.lit(0.0), F.lit(turns), F.lit(2.0))).first()
        page = np.zeros((int(h), int(w)), bool)
        page[40:70, 30:90] = True
        source = np.rot90(page, -turns)  # the page was its source turned counter-clockwise so often
        ys, xs = np.nonzero(source)
        assert [2 * v for v in got] == [xs.min(), ys.min(), xs.max() + 1, ys.max() + 1]
    b = {k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), (199.0, 99.0, 201.0, 101.0), strict=True)}
    got = spark.range(1).select(*images.to_source(b, F.lit(400.0), F.lit(300.0), F.lit(90.0), F.lit(0), F.lit(1.0))).first()
    assert list(got) == pytest.approx([249, 149, 251, 151])
    assert images.merged_boxes([(0, 0, 10, 10), (12, 0, 20, 10), (50, 50, 60, 60), (0, 12, 5, 20)], 5) == [(0, 0, 20, 20), (50, 50, 60, 60)]
    px = np.arange(20, dtype=np.uint8).reshape(4, 5)
    imgs = spark.createDataFrame([("i", 4, 5, 300.0, bytearray(px.tobytes()))], images.SCHEMA)
    boxes = spark.createDataFrame([("i", 1, 1.0, 1.0, 3.0, 9.0), ("i", 2, 9.0, 9.0, 12.0, 12.0)], "path string, item int, x0 double, y0 double, x1 double, y1 double")
    cut = {r.item: r.content for r in images.crops(imgs, boxes).collect()}
    assert bytes(cut[1]) == images.encode(px[1:4, 1:3]) and cut[2] is None


def test_debug_pictures():
    c = images.plot_curve([0, 1, 0], 11, 21, 0.5)
    assert c.shape == (11, 21) and c[0, 10] == 0 and c[10, 0] == 0 and c[5, 10] in (0, 160)
    assert images.plot_curve([], 3, 4).min() == 255 and (images.plot_curve([2, 2], 5, 4)[2] == 0).all()
    g = np.full((4, 4), 100, np.uint8)
    assert images.overlay(g, g > 200).tolist() == np.repeat(g[..., None], 3, 2).tolist() and images.overlay(g, g == 100)[0, 0].tolist() == [160, 70, 70]
    o = images.outlines(g, [(-5, 1, 2, 9)])
    assert o[1, 0].tolist() == [40, 90, 220] and o[2, 1].tolist() == [100] * 3 and o[3, 2].tolist() == [40, 90, 220]


@stages.stage("pages", "brighten", by=1)
def _brighten(df, by):
    return df.withColumn("p_correct", F.lit(0.5)).withColumn("seconds", F.lit(float(by)))


def test_command_line(spark, folder, tmp_path, capsys):
    (tmp_path / "p.toml").write_text('[pipeline]\nstages = ["pages"]\n[stage.pages]\nimpl = "brighten"\n')
    assert cli.main(["batch", f"{tmp_path}/p.toml", f"file://{folder}", "--out", f"{tmp_path}/o", "--set", "pages.by=3"]) == 2
    s = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (s["pages"], s["failed"], s["mean_seconds"], s["mean_p_correct"]) == (3, 1, 3.0, 0.5) and s["pages_per_minute"] > 0
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert cli.main(["run", f"{tmp_path}/p.toml", f"{tmp_path}/t", "--out", f"{tmp_path}/kept"]) == 0
    assert cli.main(["inspect", f"{tmp_path}/kept"]) == 0 and "brighten" in capsys.readouterr().out
    assert cli.main(["stages"]) == 0 and "brighten" in capsys.readouterr().out


def test_page_record(spark):
    p = spark.createDataFrame([("a", 2, 3, 300.0, bytearray(6), None, None, [(0, 9.0, 0.0, 0.0, 9.0, 9.0, [("w", 0.5, 0.0, 0.0, 9.0, 9.0)])], None, {"k": "1"}, None), ("b", 2, 3, 300.0, None, None, None, None, None, None, "broken")], page.SCHEMA)
    q = page.evolve(p, dpi=150.0, meta={"k": 2, "turns": F.lit(1)})
    rows = {r.page: r for r in page.shape(q).collect()}
    assert rows["a"].dpi == 150 and rows["a"].meta == {"k": "2", "turns": "1"} and rows["b"].meta == {"k": "2", "turns": "1"}
    assert (rows["a"].height, rows["b"].height) == (2, None) and p.first().dpi == 300
    assert [tuple(r)[:6] for r in page.words(p).collect()] == [("a", 0, 0, 0, "w", 0.5)]
    with pytest.raises(ValueError, match="a page has no dip"):
        page.evolve(p, dip=1)


@stages.stage("slow", "add", n=1)
def _add(df, n):
    return df.withColumn("id", F.col("id") + n)


@stages.stage("slow", "fail")
def _fail(df):
    return df.withColumn("id", F.raise_error(F.lit("on purpose")))


def test_session_and_failed_steps(spark, tmp_path):
    steps = profile.parse('[pipeline]\nstages = ["slow", "slow"]\n[stage.slow]\nimpl = "add"\n')
    s = runner.Session(spark.range(3), steps, f"file://{tmp_path}/s")
    assert sorted(r.id for r in s.refresh().collect()) == [2, 3, 4]
    first = s.kept[0]
    s.change(1, n=10)
    assert s.fresh == 1 and sorted(r.id for r in s.refresh().collect()) == [11, 12, 13] and s.kept[0] == first
    t = runner.Session.load(spark.range(3), s.save())
    assert t.fresh == 2 and sorted(r.id for r in t.refresh().collect()) == [11, 12, 13]
    assert 'impl = "add"' in t.toml() and "n = 10" in t.toml()
    with pytest.raises(ValueError, match="no parameter"):
        s.change(0, m=1)
    bad = [steps[0], profile.Step("slow", "fail", {})]
    with pytest.raises(Exception, match="on purpose"):
        runner.run_kept(spark.range(3), bad, f"file://{tmp_path}/k", run_id="r")
    m = spark.read.schema(runner.METRICS).json(f"file://{tmp_path}/k/manifest").orderBy("step").collect()
    assert [(r.run, r.n_rows, r.error is None) for r in m] == [("r", 3, True), ("r", None, False)]
    report = runner.profile_report(spark, f"file://{tmp_path}/k").collect()
    assert {(r.impl, r.runs, r.failed) for r in report} == {("add", 1, 0), ("fail", 1, 1)}


def test_landing_folder(spark, folder, tmp_path):
    def read(df):
        n = F.length("content")
        return df.select("path", F.concat(F.lit("bytes "), n).alias("result"), F.when(n > 150, "too much for me").alias("error"))

    (tmp_path / "in").mkdir()
    for name in ("a.png", "b.PNG", "a.txt"):
        (tmp_path / "in" / name).write_bytes((folder / name).read_bytes())
    (tmp_path / "in" / "large.png").write_bytes((folder / "a.png").read_bytes() + bytes(1000))
    q = landing.serve(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", read, f"file://{tmp_path}/check", most=500, once=True)
    q.awaitTermination(120)
    got = {r.path.rsplit("/", 1)[1]: r.state for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got["a.txt"] == 400 and got["large.png"] == 413 and {got["a.png"], got["b.PNG"]} <= {200, 500} and len(got) == 4
