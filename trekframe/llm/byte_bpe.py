"""Byte-level BPE by a sentencepiece model built from the vocabulary.

The model is serialised directly, without training: every vocabulary entry
becomes a piece whose bytes are mapped to the characters U+0100 to U+01FF, its
score is its negative rank (so the lowest rank merges first), normalisation is
the identity, and nothing is added, trimmed or escaped. Pieces stand in the
order of their ranks, so a piece's id is its rank. Texts are split by the
vocabulary's pattern, each pre-token is encoded apart, and ids are decoded by
the inverse mapping.

A pre-token that is itself an entry is that entry. Others merge as above.

Texts are encoded in the map task that reads them, nothing is shuffled. A task
remembers the pre-tokens that it has met lately (twice ``REMEMBERED`` at most);
this changes the time, not the result.

Defined cases: null text counts as empty and has no ids; very long texts are
encoded whole; repeated rows give repeated results; an empty table gives an
empty result; extra columns are unread.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import kept, map_arrow

#: Pre-tokens of a generation: a worker remembers the current one and the one before.
REMEMBERED = 150_000
#: Characters of a pre-token beyond which it isn't remembered.
LONGEST_REMEMBERED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields: tuple[int, object]) -> bytes:
    """Protocol buffer fields: bytes and str by length, int and bool as varint, float in 32 bits."""
    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


_MAPPED = {b: 256 + b for b in range(256)}


def mapped(data: bytes) -> str:
    """Bytes as the characters U+0100 to U+01FF."""
    return data.decode("latin-1").translate(_MAPPED)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks 0 to n-1; the unknown piece follows as n."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0 to n-1")
    pieces = [_message((1, _message((1, mapped(piece)), (2, -float(rank)), (3, 1)))) for piece, rank in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_message((1, _message((1, "<unk>"), (2, 0.0), (3, 2)))))
    trainer = _message((3, 2), (4, len(pieces)), (24, 0), (26, 0), (40, len(ranks)), (41, 2**64 - 1), (42, 2**64 - 1), (43, 2**64 - 1))
    normalizer = _message((1, "identity"), (3, 0), (4, 0), (5, 0))
    return b"".join(pieces) + _message((2, trainer), (3, normalizer))


class PreTokens(dict):
    """Pre-token to its ids' form; encodes what it hasn't met lately."""

    def __init__(self, encode, size: int = REMEMBERED):
        super().__init__()
        self.encode, self.size, self.before = encode, size, {}

    def __missing__(self, piece: str):
        form = self.before.get(piece)
        if form is None:
            form = self.encode(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.size:
                self.before = dict(self)
                self.clear()
            self[piece] = form
        return form


class ByteBPE:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.bytes_of = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model or sentencepiece_model(ranks))
        self.met = PreTokens(self._ids)

    def _ids(self, piece: str) -> list[int]:
        data = piece.encode()
        rank = self.ranks.get(data)
        return [rank] if rank is not None else self.pieces.encode(mapped(data))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.met.__getitem__, self.split(text or ""))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _per_text(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, schema: str, types: list[tuple[str, pa.DataType]], row) -> DataFrame:
    ranks = read_ranks(path)
    model = sentencepiece_model(ranks)
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, model))  # a vocabulary: its size doesn't depend on the data

    def run(batches):
        bpe = kept(key, lambda: ByteBPE(shared.value[0], pattern, shared.value[1]))
        for batch in batches:
            rows = [(i, *row(bpe, text)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*rows)) or [[]] * len(types), types)], names=[n for n, _ in types])

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run, schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    types = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]
    return _per_text(docs, id_col, text_col, path, pattern, "doc_id long, ids array<int>", types, lambda bpe, text: (bpe.encode(text.as_py()),))


def bpe_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the bytes decoded from them; with_ids: the ids too."""

    def row(bpe: ByteBPE, text: pa.Scalar) -> tuple:
        ids = bpe.encode(text.as_py())
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), *[ids] * with_ids

    types = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))][: 4 + with_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _per_text(docs, id_col, text_col, path, pattern, schema, types, row)
