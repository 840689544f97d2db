"""A unigram model, built field by field: scores, byte fallback and unknowns as the other library has them."""

from __future__ import annotations

import struct

import numpy as np
import pytest
import sentencepiece

from meterline.llm import sentencepiece as sp


def varint(x: int) -> bytes:
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def number(field: int, x: int) -> bytes:
    return varint(field << 3) + varint(x)


def data(field: int, x: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(x)) + x


def piece(text: str, score: float, kind: int = 1) -> bytes:
    return data(1, data(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))


def model(byte_fallback: bool) -> bytes:
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if byte_fallback:
        out += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256))
    words = ["▁the", "▁cat", "▁ca", "at", "th", "▁", "he", "ing", "▁sing", "▁s", "in", "g", "▁▁", "é", "es"]
    out += b"".join(piece(w, -1.0 - 0.37 * k) for k, w in enumerate(words))
    out += b"".join(piece(c, -9.0 - 0.11 * k) for k, c in enumerate("abcdefhijklmnopqrstuvwxyz,.\n"))
    trainer = number(3, 1) + (number(35, 1) if byte_fallback else b"")
    return out + data(2, trainer) + data(3, number(3, 1) + number(4, 0) + number(5, 1))


TEXTS = [
    "", " ", "the cat sings", "thecat  singing the", "  two  blanks   three", "éa cafés, the.\nnext line",
    "UPPER Case 123", "中文 and \U0001f600", "a\x00b", "the " * 500, "▁ meta",
]


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models_have_parity(tmp_path, byte_fallback):
    path = tmp_path / "unigram.model"
    path.write_bytes(model(byte_fallback))
    codec = sp.Codec(str(path))  # holds itself against the other library on its probes
    assert codec.model.kind == 1 and codec.model.byte_fallback == byte_fallback
    other = sentencepiece.SentencePieceProcessor(model_file=str(path))
    found, back = codec.encode(TEXTS)
    for text, ids, ok in zip(TEXTS, found, back, strict=True):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == other.encode(text)
        # Without fallback, unknown characters are lost, and only they are.
        assert ok == (codec.model.pieces[0][0] not in other.encode(text, out_type=str) and 0 not in ids)
        if ok:
            assert codec.decode(ids) == text.replace("▁", " ")


def test_every_text_is_decoded(spark, sf):
    from meterline.llm.common import table

    docs = table(spark, sf, "documents").select("doc_id", "text").limit(40)
    rows = sp.decode_text(sp.encode_text(docs)).collect()
    for r in rows:
        assert r["round_trip"] and r["decoded"] == sp.codec(sp.MODEL).normal(r["text"] or "").replace("▁", " ").removeprefix(" ")
