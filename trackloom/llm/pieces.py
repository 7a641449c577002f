"""SentencePiece encoding and decoding with byte offsets into the original text.

A text is normalised by longest prefixes of the model's compiled character map; every normalised byte records
the original byte that it came from. The library encodes; the lengths of the pieces then tile the normalised
text, and the alignment projects each piece to a span of original UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁".encode()
REPLACEMENT = "�".encode()
_BYTE, _USER = 6, 4


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message, numbers and raw values."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(blob):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, blob[at : at + size]
        at += size


class Normalizer:
    """The normaliser that a model file describes, with the source of each normalised byte."""

    def __init__(self, model: bytes):
        fields = list(_fields(model))
        spec = dict(_fields(next((v for k, v in fields if k == 3), b"")))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.squeeze = bool(spec.get(4, 1))
        self.space = SPACE if spec.get(5, 1) else b" "
        chart = spec.get(2, b"")
        size = int.from_bytes(chart[:4], "little") if chart else 0
        self.units = np.frombuffer(chart[4 : 4 + size], "<u4").tolist()
        self.targets = chart[4 + size :]
        self.opens = self._openings()
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        self.lengths = np.array([1 if p.get(3, 1) == _BYTE else len(p[1]) for p in pieces], np.int64)
        self.plain = all(p.get(3, 1) != _USER for p in pieces)

    def _follow(self, node: int, byte: int) -> int | None:
        """The node below another for a byte, in the map's double array."""
        node ^= byte
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 512) >> 6) if unit & 0x800000FF == byte else None

    def _openings(self) -> np.ndarray:
        """By the number of its first two bytes (0 for a missing one): whether some mapped prefix may begin so."""
        opens = np.zeros((256, 256), bool)
        if self.units:
            unit = self.units[0]
            root = (unit >> 10) << ((unit & 512) >> 6)
            for first in range(1, 256):
                node = self._follow(root, first)
                if node is not None:
                    alone = self.units[root ^ first] >> 8 & 1  # the byte itself is mapped
                    opens[first] = [bool(alone) or (second > 0 and self._follow(node, second) is not None) for second in range(256)]
        return opens.ravel()

    def mapped_prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """Normal form of the longest mapped prefix at a place, and the bytes that it takes: none if nothing is mapped."""
        found, took = -1, 0
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found, took = self.units[node] & 0x7FFFFFFF, i + 1 - at
        return (self.targets[found : self.targets.index(b"\0", found)], took) if took else (b"", 0)

    def mapped(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The text through the character map, longest prefixes first: its bytes, the original byte that each comes
        from, where its unit (a character or what replaced a prefix) starts, and whether only spaces stand before it in
        its unit. Only places where a mapped prefix may begin are looked up, one after another."""
        raw = np.frombuffer(text, np.uint8)
        pair = raw.astype(np.int64) << 8
        pair[:-1] |= raw[1:]
        places = np.flatnonzero(self.opens[pair] & (raw & 0xC0 != 0x80)) if self.units else raw[:0]
        out, source, unit, leads, at, size = [], [], [], [], 0, 0
        for p in [*places.tolist(), len(raw)]:
            if p < at:
                continue
            normal, took = self.mapped_prefix(text, p) if p < len(raw) else (b"", 0)
            if took or p == len(raw):
                for part, where, start, lead in (
                    (raw[at:p], np.arange(at, p), np.arange(size, size + p - at), np.ones(p - at, bool)),
                    (np.frombuffer(normal, np.uint8), np.full(len(normal), p), np.full(len(normal), size + p - at), np.arange(len(normal)) < len(normal) - len(normal.lstrip(b" "))),
                ):
                    out.append(part)
                    source.append(where)
                    unit.append(start)
                    leads.append(lead)
                size += p - at + len(normal)
                at = p + took
        return tuple(map(np.concatenate, (out, source, unit, leads)))

    def align(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte where it starts."""
        out, source, unit, lead = self.mapped(text)
        begin, end = 0, len(text)
        if self.squeeze:
            space = out == 32
            alone = space & (unit == np.arange(len(out))) & np.r_[unit[1:] != unit[:-1], True][: len(out)]
            if alone.all():
                return b"", np.array([end])
            begin = int(source[np.argmin(alone)])
            # spaces at the start of a unit go if a space, or nothing, stands before the unit
            stays = ~(space & lead & np.r_[True, space][unit])
            out, source = out[stays], source[stays]
            tail = len(out) - len(out.tobytes().rstrip(b" "))
            if tail:
                end = int(source[len(out) - tail])
                out, source = out[: len(out) - tail], source[: len(out) - tail]
        if not len(text):
            return b"", np.array([end])
        if self.dummy_prefix and (len(out) or not self.squeeze):
            out, source = np.r_[np.uint8(32), out], np.r_[begin, source]
        source = np.repeat(source, np.where(out == 32, len(self.space), 1))
        return out.tobytes().replace(b" ", self.space), np.append(source, end)

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each piece in the original bytes. Pieces must tile the normalised text."""
        normal, source = self.align(text)
        ends = np.cumsum(self.lengths[ids])
        if (int(ends[-1]) if len(ends) else 0) != len(normal):
            raise ValueError("the pieces don't tile the normalised text")
        return source[ends - self.lengths[ids]], source[ends]


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered_bytes long, spans_sha256 string"
PIECES = "ids array<int>, span_start array<int>, span_end array<int>, decoded string"


def _hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode(docs: DataFrame, model: bytes, *keys: str, digests: bool = False) -> DataFrame:
    """Encode whole texts with an end id, decode them again, and give each piece's span of original bytes.

    Returns the key columns with ``ids``, ``span_start``, ``span_end`` (int arrays; the end id has the empty span
    at the end) and ``decoded``; with ``digests`` their counts and SHA-256 digests in place of the arrays, that of
    the spans over pairs of start and end as 64-bit numbers, little end first.
    Null and empty texts give the end id alone. Repeated rows and null keys give one row each. Any other columns
    are left out, so their names can't clash. Rows stay where they are: no shuffle.
    """
    import sentencepiece

    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary file: its size doesn't depend on the data
    if not Normalizer(model).plain or not sentencepiece.SentencePieceProcessor(model_proto=model).is_byte(3):
        raise ValueError("spans need a model with byte fallback and without user-defined symbols")

    def start() -> Callable:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=shipped.value)
        normalizer, end = Normalizer(shipped.value), library.eos_id()

        def one(text: str, ids: list[int]) -> tuple:
            raw = text.encode()
            begin, stop = normalizer.spans(raw, np.array(ids, np.int64))
            begin, stop = np.append(begin, len(raw)), np.append(stop, len(raw))
            ids.append(end)
            decoded = library.decode(ids)
            if digests:
                spans = np.stack([begin, stop], axis=1).astype("<i8").tobytes()
                return len(ids), _hex(" ".join(map(str, ids)).encode()), _hex(decoded.encode()), len(raw), int((stop - begin).sum()), _hex(spans)
            return ids, begin, stop, decoded

        def work(batch) -> zip:
            found = batch.column("text").to_pylist()
            return zip(*map(one, found, library.encode(found, num_threads=1)), strict=True)

        return work

    return common.map_columns(common.texts(docs, *keys), DIGESTS if digests else PIECES, start, list(keys))


def model_bytes(name: str = "piece_bpe_32k.model") -> bytes:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded; one row per document."""
    return encode(common.table(spark, sf_dir, "documents"), model_bytes(), "doc_id", digests=True)
