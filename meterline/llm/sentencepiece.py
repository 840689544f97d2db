"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field; normaliser (character map, dummy prefix, space
folding), meta space, unigram scores or BPE merges, and byte fallback are rebuilt. No piece of
such a model crosses from a letter to a following meta space, and none holds a line feed, so
that a text is encoded unit by unit (leading spaces and a word; or a line feed): this gives the
ids of the whole text, and each unit is encoded once per task while it stays in a bounded
memo. The ids of every text are decoded again and held against its normalised form. Models for which that does not hold are encoded text by text.

Workers hold themselves against the sentencepiece library on probe texts before the first row
and raise on a difference. Decoding maps ids to pieces and bytes.

Defined cases: null text has null ids and no tokens, empty text has an empty list; very long
texts are encoded whole; repeated rows give the same ids; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType
from tokenizers import Tokenizer, models, normalizers

from meterline.llm.common import appended, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units that a worker remembers while it works on a partition, and that it encodes at a time.
MEMO = 200_000
BATCH = 2_000
#: Text against which both libraries are held in each worker.
PROBES = [
    "",
    " ",
    "one two  three   four",
    " lead and trail ",
    "Line\nfeed\n\n and\ttab\r\n",
    "über déjà ñu 3.14159 <s> ▁ \U0001f600 日本語 \u0000 x",
    "aaaaaaaaaaaaaaaaaaaaaaaa    bbbb",
]
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = 1  # 1 unigram, 2 BPE
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape_spaces: bool = True


def fields_of(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
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
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[wire]
            yield key >> 3, data[at : at + n]
            at += n


def parse_model(data: bytes) -> Model:
    """The field numbers of the public model format."""
    out = Model()
    for number, value in fields_of(data):
        if number == 1:
            piece = dict(fields_of(value))
            score = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields_of(value))
            out.kind = trainer.get(3, 1)
            out.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(fields_of(value))
            out.charsmap = spec.get(2, b"")
            out.dummy_prefix = bool(spec.get(3, 1))
            out.fold_spaces = bool(spec.get(4, 1))
            out.escape_spaces = bool(spec.get(5, 1))
    if out.kind not in (1, 2):
        raise ValueError(f"model type {out.kind}: only unigram (1) and BPE (2) are supported")
    return out


def merges_of(model: Model) -> list[tuple[str, str]]:
    """BPE merges by falling score of the merged piece."""
    rank = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    found = []
    for p, score, kind in model.pieces:
        if kind == NORMAL and len(p) > 1:
            splits = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
            found += [(-score, rank[p], rank[a], rank[b], a, b) for a, b in splits]
    return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            self.model = model = parse_model(f.read())
        self.path = path
        unk = next(k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN)
        # Control pieces are never made from text.
        names = [f"\x00{k}" if kind == CONTROL else p for k, (p, _, kind) in enumerate(model.pieces)]
        if model.kind == 1:
            vocab = [(n, s) for n, (_, s, _) in zip(names, model.pieces, strict=True)]
            core = models.Unigram(vocab, unk_id=unk, byte_fallback=model.byte_fallback)
        else:
            core = models.BPE(
                {n: k for k, n in enumerate(names)},
                merges_of(model),
                cache_capacity=0,  # units are remembered here already
                unk_token=names[unk],
                fuse_unk=True,
                byte_fallback=model.byte_fallback,
            )
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
        self.normalizer = normalizers.Sequence(steps) if steps else None
        plain = [p for p, _, kind in model.pieces if kind in (NORMAL, USER)]
        self.by_unit = not any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in plain)
        self.memo: dict[str, bytes] = {}
        self.bytes_of = [self._piece_bytes(p, kind) for p, _, kind in model.pieces]
        self.check()

    @staticmethod
    def _piece_bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return piece.replace(SPACE, " ").encode()

    def normal(self, text: str) -> str:
        m = self.model
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        if m.fold_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        if m.dummy_prefix:
            text = f" {text}"
        return text.replace(" ", SPACE) if m.escape_spaces else text

    def _learn(self, units: list[str]) -> None:
        # Encodings are much larger than their ids, so few of them live at a time.
        for at in range(0, len(units), BATCH):
            some = units[at : at + BATCH]
            encoded = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            for unit, e in zip(some, encoded, strict=True):
                self.memo[unit] = np.array(e.ids, "<i4").tobytes()

    def forget(self) -> None:
        self.memo.clear()

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids (int32, little endian) of each text; whether they decode to the normalised text."""
        normal = [self.normal(t) for t in texts]
        split = UNIT.findall if self.by_unit else lambda t: [t] if t else []
        units = [split(t) for t in normal]
        memo = self.memo
        if len(memo) > MEMO:
            self.forget()
        fresh = {u for us in units for u in us if u not in memo}
        if fresh:
            self._learn(list(fresh))
        ids = [b"".join([memo[u] for u in us]) for us in units]
        back = [self.bytes_from(np.frombuffer(i, "<i4").tolist()) == n.replace(SPACE, " ").encode() for i, n in zip(ids, normal, strict=True)]
        return ids, back

    def bytes_from(self, ids: Iterable[int]) -> bytes:
        bytes_of = self.bytes_of
        return b"".join([bytes_of[k] for k in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of these ids, without the dummy prefix."""
        text = self.bytes_from(ids).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text

    def check(self) -> None:
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_file=self.path)
        mine, _ = self.encode(PROBES)
        for probe, ids in zip(PROBES, mine, strict=True):
            if np.frombuffer(ids, "<i4").tolist() != other.encode(probe):
                raise ValueError(f"the rebuilt tokenizer differs on {probe!r}")


UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_text(
    docs: DataFrame, text: str = "text", ids: str = "token_ids", model: str = MODEL
) -> DataFrame:
    """All rows and columns, and `token_ids`, `n_tokens`, `round_trip` (decoding gives the text)."""
    schema = StructType([f for f in docs.schema.fields if f.name not in (ids, "n_tokens", "round_trip")])
    schema = schema.add(ids, ArrayType(IntegerType())).add("n_tokens", LongType()).add("round_trip", BooleanType())
    column = docs.columns.index(text)

    def encoded(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(column).to_pylist()
        packed, back = c.encode([t or "" for t in texts])
        sizes = np.array([len(p) // 4 for p in packed], np.int32)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        missing = np.array([t is None for t in texts])
        lists = pa.ListArray.from_arrays(
            pa.array(offsets, mask=np.append(missing, False)),
            pa.array(np.frombuffer(b"".join(packed), "<i4")),
        )
        return appended(
            batch, **{ids: lists, "n_tokens": pa.array(sizes.astype(np.int64)), "round_trip": pa.array(back)}
        )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        try:
            for batch in slices(batches):
                yield encoded(c, batch)
        finally:  # the worker goes on to other tasks
            c.forget()

    return docs.mapInArrow(add, schema)


def decode_text(docs: DataFrame, ids: str = "token_ids", name: str = "decoded", model: str = MODEL) -> DataFrame:
    """All rows and columns, and the text of the ids; null ids give null."""
    schema = StructType([f for f in docs.schema.fields if f.name != name]).add(name, StringType())

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in slices(batches):
            texts = [None if x is None else c.decode(x) for x in batch.column(ids).to_pylist()]
            yield appended(batch, **{name: pa.array(texts, pa.string())})

    return docs.mapInArrow(add, schema)


def op8_sentencepiece(docs: DataFrame, model: str = MODEL) -> DataFrame:
    return encode_text(docs.select("doc_id", "text"), model=model).select(
        "doc_id", "n_tokens", "token_ids", "round_trip"
    )
