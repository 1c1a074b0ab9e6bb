"""Pages of scanned PDF files: the largest embedded raster of each page and its dots an inch.

Only what scans need is read: objects in plain view or in object streams, pages by their tree, images that are raw, deflated or JPEG.
Encrypted files, and pages without an image, raise.
"""

from __future__ import annotations

import re
import zlib
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.sources import images

_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|/[^\s<>\[\]()/%{}]*|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|[^\s<>\[\]()/%{}]+", re.S)
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")


class Name(str):
    pass


class Ref(int):
    pass


def _value(tokens: list[bytes], at: int) -> tuple[Any, int]:
    """The value that begins at a token, and the token behind it."""
    t = tokens[at]
    if t == b"<<":
        out, at = {}, at + 1
        while tokens[at] != b">>":
            key = Name(tokens[at][1:].decode("latin-1"))
            out[key], at = _value(tokens, at + 1)
        return out, at + 1
    if t == b"[":
        items, at = [], at + 1
        while tokens[at] != b"]":
            v, at = _value(tokens, at)
            items.append(v)
        return items, at + 1
    if t[:1] == b"/":
        return Name(t[1:].decode("latin-1")), at + 1
    if at + 2 < len(tokens) and tokens[at + 2] == b"R" and t.isdigit() and tokens[at + 1].isdigit():
        return Ref(t), at + 3
    try:
        return (int(t) if b"." not in t else float(t)), at + 1
    except ValueError:
        return t, at + 1


def _parse(data: bytes) -> Any:
    tokens = [t for t in _TOKEN.findall(data) if t[:1] != b"%"]
    return _value(tokens, 0)[0] if tokens else None


class Document:
    """The objects of one file."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\s", data):
            raise ValueError("encrypted PDF files cannot be read")
        self.objects: dict[int, tuple[Any, bytes | None]] = {}
        for m in _OBJECT.finditer(data):
            end = data.find(b"endobj", m.end())
            body = data[m.end() : end if end >= 0 else len(data)]
            cut = re.search(rb"\bstream\r?\n", body)
            value = _parse(body[: cut.start()] if cut else body)
            raw = None
            if cut:
                start = m.end() + cut.end()
                n = value.get("Length") if isinstance(value, dict) else None
                stop = start + n if isinstance(n, int) and not isinstance(n, Ref) else data.find(b"endstream", start)
                raw = data[start:stop]
            self.objects[int(m[1])] = (value, raw)
        for value, raw in list(self.objects.values()):
            if isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, self._inflated(value, raw))

    def _unpack(self, head: dict, data: bytes) -> None:
        numbers = [int(x) for x in data[: self.get(head["First"])].split()]
        places = list(zip(numbers[0::2], numbers[1::2], strict=False))
        for k, (number, at) in enumerate(places):
            stop = places[k + 1][1] if k + 1 < len(places) else len(data)
            first = self.get(head["First"])
            self.objects.setdefault(number, (_parse(data[first + at : first + stop]), None))

    def get(self, v: Any) -> Any:
        while isinstance(v, Ref):
            v = self.objects.get(int(v), (None, None))[0]
        return v

    def _inflated(self, head: dict, raw: bytes) -> bytes:
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"filter {f} is not supported")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        root = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), None)
        out: list[dict] = []
        open_ = [(self.get(root["Pages"]), {})] if root else [(v, {}) for v, _ in reversed(self.objects.values()) if isinstance(v, dict) and v.get("Type") == "Page"]
        seen = 0
        while open_ and seen < 1_000_000:
            node, above = open_.pop()
            seen += 1
            if not isinstance(node, dict):
                continue
            own = {**above, **{k: node[k] for k in ("MediaBox", "Resources") if k in node}}
            if "Kids" in node:
                open_ += [(self.get(k), own) for k in reversed(self.get(node["Kids"]))]
            else:
                out.append({**own, **node})
        return out

    def largest_image(self, page: dict) -> tuple[dict, bytes]:
        found = []
        pool = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
        for ref in pool.values():
            value, raw = self.objects.get(int(ref), (None, None)) if isinstance(ref, Ref) else (None, None)
            if isinstance(value, dict) and value.get("Subtype") == "Image" and raw is not None:
                found.append((self.get(value["Width"]) * self.get(value["Height"]), value, raw))
        if not found:
            raise ValueError("the page has no image")
        return max(found, key=lambda x: x[0])[1:]


def page_count(data: bytes) -> int:
    return len(Document(data).pages())


def page_image(data: bytes, page: int) -> tuple[bytes, float]:
    """(image file, dots an inch) of a page's largest raster: JPEG as it stands, others as PNG; dpi: its width over the page's inches."""
    doc = Document(data)
    p = doc.pages()[page]
    head, raw = doc.largest_image(p)
    x0, _, x1, _ = (float(doc.get(v)) for v in doc.get(p["MediaBox"]))
    w, h, bits = doc.get(head["Width"]), doc.get(head["Height"]), doc.get(head.get("BitsPerComponent", 8))
    dpi = w * 72.0 / (x1 - x0)
    filters = doc.get(head.get("Filter"))
    if filters in ("DCTDecode", ["DCTDecode"]):
        return raw, dpi
    px = doc._inflated(head, raw)
    space = doc.get(head.get("ColorSpace", Name("DeviceGray")))
    per = {"DeviceGray": 1, "DeviceRGB": 3}.get(space if isinstance(space, str) else "", 0)
    if not per or bits not in (1, 8):
        raise ValueError("only grey and colour images of 1 or 8 bits are supported")
    if bits == 1:
        rows = np.frombuffer(px, np.uint8)[: h * -(-w // 8)].reshape(h, -1)
        out = np.unpackbits(rows, axis=1)[:, :w] * np.uint8(255)
    else:
        out = np.frombuffer(px, np.uint8)[: h * w * per].reshape((h, w) if per == 1 else (h, w, per))
    return images.encode(out, dpi), dpi


def read_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, page, content, dpi, error): a row for each page of the files; a page that cannot be read has an error and no content."""

    def pages(data) -> list[tuple]:
        data = bytes(data)
        try:
            n = page_count(data)
        except Exception as e:  # one broken file must not stop the rest
            return [(0, None, None, str(e) or type(e).__name__)]
        out = []
        for k in range(n):
            try:
                out.append((k, *page_image(data, k), None))
            except Exception as e:
                out.append((k, None, None, str(e) or type(e).__name__))
        return out

    read = F.udf(pages, "array<struct<page:int,content:binary,dpi:double,error:string>>", useArrow=True)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(paths)
    return files.select("path", F.explode(read("content")).alias("p")).select("path", "p.*")
