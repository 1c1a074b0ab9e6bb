"""Fill-in-the-middle: texts cut in three at unit borders and put together anew.

A unit is a run of A-Z letters or one other character.  Per text, ``regex`` finds the units and their end offsets go into a
compact array; two draws from the SHA-256 of the seed and the id choose two borders, and two look-ups in the array give the
offsets at which the text is sliced.  Three forms: ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) and ``plain``
(the text as it is).  ``restore`` puts the text together from the output and the form.

Texts go to Python in Arrow batches and come back ``CHARS`` characters at a time, so what a worker holds beside one batch is
bounded by that and by the longest text.

Defined results: a null text is empty, has no units and is plain; so is a text that holds one of the three marks; a null id is
the empty string in the draw; equal rows give equal rows, none goes; an empty table gives an empty table; further columns stay
unless they bear an output's name (then the output takes it).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Characters that go back at a time.
CHARS = 1 << 22
#: In a hundred texts: those that are cut, and of the cut ones those with the suffix in front.
CUT, SUFFIX_FIRST = 90, 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str) -> array:
    return array("I", (m.end() for m in UNIT.finditer(text)))


def draws(seed: int, doc_id: str) -> list[int]:
    """Four numbers of 32 bits."""
    hexed = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(hexed[k : k + 8], 16) for k in range(0, 32, 8)]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rearranged(text: str, doc_id: str, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    ends = unit_ends(text)
    n, (a, b, c, d) = len(ends), draws(seed, doc_id)
    if not text or any(m in text for m in MARKS) or c % 100 >= CUT:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    start, stop = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    p, s, m = MARKS
    if d % 100 < SUFFIX_FIRST:
        return n, "spm", start, stop - start, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", start, stop - start, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restored(output: str, form: str) -> str:
    """The text: each mark occurs once, for texts with marks stay plain."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def _parts(texts: pd.Series) -> Iterator[slice]:
    """Slices of about CHARS characters."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= CHARS:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def fill_in_middle(docs: DataFrame, seed: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars (null if plain), output and output_sha256."""

    @F.pandas_udf(SCHEMA)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            for part in _parts(texts):
                rows = [rearranged(t or "", i or "", seed) for i, t in zip(ids.iloc[part], texts.iloc[part], strict=True)]
                out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                for c in ("prefix_chars", "middle_chars"):
                    out[c] = out[c].astype("Int64")
                yield out.assign(output_sha256=[digest(x) for x in out["output"]])

    names = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    held = docs.select(*own, cut(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")).alias("__fim"))
    return held.select(*own, *[F.col(f"__fim.{c}").alias(c) for c in names])


def restore(table: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """table with restored and restored_sha256: the text rebuilt from output and form (null outputs are empty)."""

    @F.pandas_udf("restored string, restored_sha256 string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            for part in _parts(outputs):
                texts = [restored(o or "", f or "plain") for o, f in zip(outputs.iloc[part], forms.iloc[part], strict=True)]
                yield pd.DataFrame({"restored": pd.Series(texts, dtype=object), "restored_sha256": pd.Series([digest(t) for t in texts], dtype=object)})

    names = ["restored", "restored_sha256"]
    own = [F.col(f"`{c}`") for c in table.columns if c.lower() not in names]
    held = table.select(*own, back(F.col(f"`{output}`"), F.col(f"`{form}`")).alias("__back"))
    return held.select(*own, *[F.col(f"__back.{c}").alias(c) for c in names])
