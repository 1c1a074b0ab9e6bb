"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed and rebuilt as a tokenizer: its normaliser (character map, doubled blanks, mark in front), the blank
mark, the scores (unigram: the pieces' scores; pair merging: the merges that the scores order) and bytes for what no piece
covers.  Batches are encoded by the library's threads.  ``parity`` compares with the SentencePiece library.

Where no piece crosses from another character to the mark, a text is cut before each run of marks first: merges cannot cross
the cut, so the ids stay the same, and the library remembers words.

Defined results: a null text is empty and gives no ids; ids of an empty text are empty; decoding gives back the text after
normalisation, which for the byte-fallback model without character map is the text itself.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from leafmill.llm import piecemodel as P

#: Texts given to the library at a time, by number and by characters.
BATCH, BATCH_CHARS = 64, 1 << 18


def _merges(m: P.PieceModel) -> list[tuple[str, str]]:
    """Every way to join two pieces into one, best score first (pieces of equal score: lower id first)."""
    place = {p: i for i, (p, k) in enumerate(zip(m.pieces, m.kinds, strict=True)) if k in (P.NORMAL, P.USER_DEFINED, P.UNUSED)}
    found = []
    for p, i in place.items():
        for cut in range(1, len(p)):
            a, b = place.get(p[:cut]), place.get(p[cut:])
            if a is not None and b is not None:
                found.append((-m.scores[i], i, a, b, p[:cut], p[cut:]))
    found.sort(key=lambda x: x[:4])
    return [(x[4], x[5]) for x in found]


def build(data: bytes) -> Tokenizer:
    """A tokenizer that encodes as the model file says."""
    m = P.parse(data)
    if m.whitespace_suffix or not m.escape_whitespaces:
        raise ValueError("models that mark blanks behind words, or not at all, are not supported")
    if m.model_type == P.BPE:
        vocab = {p: i for i, p in enumerate(m.pieces)}
        t = Tokenizer(models.BPE(vocab, _merges(m), unk_token=m.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback))
    elif m.model_type == P.UNIGRAM:
        t = Tokenizer(models.Unigram(list(zip(m.pieces, m.scores, strict=True)), m.unk_id, byte_fallback=m.byte_fallback))
    else:
        raise ValueError(f"model type {m.model_type} is not supported")
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(P.MARK))
    steps.append(normalizers.Replace(" ", P.MARK))
    t.normalizer = normalizers.Sequence(steps)
    if m.model_type == P.BPE and not any(re.search(f"[^{P.MARK}]{P.MARK}", p) for p in m.pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{P.MARK}+[^{P.MARK}]*|[^{P.MARK}]+"), "isolated")
    own = [p for p, k in zip(m.pieces, m.kinds, strict=True) if k == P.USER_DEFINED]
    if own:
        t.add_tokens([AddedToken(p, normalized=False) for p in own])
    tail = [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(P.MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return t


def batches_of(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if len(part) >= BATCH or chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


_BUILT: dict[str, Tokenizer] = {}


def _tokenizer(name: str, data: bytes, threads: int) -> Tokenizer:
    if name not in _BUILT:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _BUILT.clear()
        _BUILT[name] = build(data)
    return _BUILT[name]


def encode(docs: DataFrame, model: bytes, text: str = "text", doc_id: str = "doc_id", threads: int = 2, decoded: bool = False) -> DataFrame:
    """(doc_id, ids, n_tokens, exact): the ids of each whole text; exact: decoding them gives the text back.

    decoded: also the decoded text.  Rows stay as they are, repeated ones and null ids included.
    """
    name = uuid.uuid4().hex
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(name, bound.value, threads)
        for b in batches:
            at = 0
            texts = [x or "" for x in b.column(1).to_pylist()]
            for part in batches_of(texts):
                ids = [e.ids if s else [] for e, s in zip(t.encode_batch_fast(part, add_special_tokens=False), part, strict=True)]
                back = t.decode_batch(ids, skip_special_tokens=False)
                cols = [
                    b.column(0).slice(at, len(part)),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([x == s for x, s in zip(back, part, strict=True)]),
                ]
                names = ["doc_id", "ids", "n_tokens", "exact"]
                if decoded:
                    cols.append(pa.array(back))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names)
                at += len(part)

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, ids array<int>, n_tokens long, exact boolean" + ", decoded string" * decoded
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(table: DataFrame, model: bytes, ids: str = "ids", doc_id: str = "doc_id", threads: int = 2) -> DataFrame:
    """(doc_id, text): null ids give a null text; ids outside the vocabulary raise."""
    name, size = uuid.uuid4().hex, len(P.parse(model).pieces)
    bound = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(name, bound.value, threads)
        for b in batches:
            rows = b.column(1).to_pylist()
            if any(not 0 <= i < size for r in rows if r for i in r):
                raise ValueError("an id lies outside the vocabulary")
            back = t.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if r is None else s for r, s in zip(rows, back, strict=True)], pa.string())], ["doc_id", "text"])

    kind = dict(table.dtypes)[doc_id]
    return table.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def parity(model: bytes, texts: list[str], threads: int = 2) -> list[int]:
    """Places of the texts whose ids differ from those of the SentencePiece library."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    t = build(model)
    theirs = own.encode(texts, num_threads=threads)
    mine = [e.ids if s else [] for e, s in zip(t.encode_batch(texts, add_special_tokens=False), texts, strict=True)]
    return [i for i, (a, b) in enumerate(zip(mine, theirs, strict=True)) if a != b]
