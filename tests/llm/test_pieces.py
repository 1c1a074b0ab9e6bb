import random
import struct
from pathlib import Path

import pytest

from leafmill.llm import piecemodel as P
from leafmill.llm import pieces as S
from leafmill.llm import queries as Q

MODEL = Path(Q.TOKENIZERS, "piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  two  blanks ", "Straße für été año", "日本語 🙂 \x00 tab\tline\n\n", "x" * 3000, "▁▁a ▁b", "<s> <unk> <0x41> </s>", "​ zero\xa0width", "1234567890 12.5%"]


@pytest.fixture(scope="module")
def model():
    if not MODEL.exists():
        pytest.skip("no public tokenizer files here")
    return MODEL.read_bytes()


def test_parity(model):
    r = random.Random(3)
    noise = ["".join(r.choice(" abcdeéß\n.,▁0<>日") for _ in range(r.randint(0, 200))) for _ in range(300)]
    assert S.parity(model, TEXTS + noise) == []


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | 128 * bool(n)])
        if not n:
            return out


def field(no, value):
    if isinstance(value, int):
        return varint(no << 3) + varint(value)
    if isinstance(value, float):
        return varint(no << 3 | 5) + struct.pack("<f", value)
    return varint(no << 3 | 2) + varint(len(value)) + value


def made(kind, pieces, fallback, squeeze):
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    return body + field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_parity(squeeze):
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.1, 1), ("b", -3.3, 1), ("ab", -3.9, 1), ("▁ab", -4.4, 1), ("ba", -5.2, 1), ("abba", -5.9, 1), ("c", -7.7, 1)]
    m = made(P.UNIGRAM, pieces, False, squeeze)
    r = random.Random(2)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 30))) for _ in range(200)]
    texts = [t for t in texts if t.strip()]
    assert S.parity(m, texts) == []


def test_broken_model(model):
    with pytest.raises(ValueError):
        P.parse(model[:1001])
    with pytest.raises(ValueError):
        S.build(made(3, [("<unk>", 0.0, 2)], False, False))


def test_tables(spark, model):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a", 1), (2, "a", 1), (50, None, 1), (51, "word " * 60000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = S.encode(docs, model, decoded=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert r.n_tokens == len(r.ids) and r.exact == (r.decoded == text)
        assert r.exact or "▁" in text
    back = S.decode(S.encode(docs.filter("text is null or text not like '%▁%'"), model), model)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, t or "") for i, t, _ in rows if "▁" not in (t or "")}
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert S.decode(nothing, model).first().text is None
    assert S.encode(docs.limit(0), model).count() == 0
