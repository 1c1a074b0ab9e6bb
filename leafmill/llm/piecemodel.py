"""Reads a SentencePiece model file: a protobuf message, parsed field by field."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Kinds of piece as numbered in the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types as numbered in the format.
UNIGRAM, BPE = 1, 2
MARK = "▁"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            n = varint()
        if at + n > len(data):
            raise ValueError("the model file is cut off")
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_suffix: bool = False

    @property
    def unk_id(self) -> int:
        return self.kinds.index(UNKNOWN)


def parse(data: bytes) -> PieceModel:
    m = PieceModel()
    for no, value in fields(data):
        if no == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif no == 2:
            for k, v in fields(value):
                if k == 3:
                    m.model_type = v
                elif k == 24:
                    m.whitespace_suffix = bool(v)
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif no == 3:
            for k, v in fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m


def vocabulary(model: PieceModel) -> list[str]:
    """The ordinary pieces: what a text can be cut into without control symbols or bytes."""
    return [p for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED)]
