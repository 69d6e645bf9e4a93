"""Token ids in directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level k holds the k-th
chunk of all ids that have one, a continuation bitmap tells which of them go
on, and a rank directory counts the bitmap's ones before each block of 512
bits. So any token is read with one lookup a level: its place on the next level
is the rank of its bit, and no block has to be decoded.

Documents are encoded where they are read. The ids, not the texts, are dealt
into ranges of ascending doc_id; each range is sorted by Spark and written as
segments of about ``SEGMENT`` tokens, rows of a Parquet table in a shared
folder (so tasks commit or leave nothing, wherever the folder is). A segment
has the range it belongs to, the tokens of the range before it, its documents
and their lengths, and the code. At most ``RANGES`` range totals give every
range's start.

A task remembers the pre-tokens that it has met, up to a bound; pre-tokens are
encoded apart by the library anyway. Added tokens of the tokenizer file (such
as an end marker) are found in the text first and are one id each, as in the
library's ``encode(text, add_special_tokens=False)``.

Defined cases: null text counts as empty and has the end id alone; null
doc_ids come last; rows that share a doc_id follow each other in the order of
their ids' bytes; very long documents are whole in one segment; an empty table
writes no segment; extra columns are unread.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trekframe.llm.byte_bpe import PreTokens
from trekframe.llm.common import kept, map_arrow, shared_dir, small_batches

#: Tokens in a segment, about; documents in a range, about; ranges at most.
SEGMENT, RANGE_DOCS, RANGES = 1 << 20, 2048, 10_000
#: Bits of a bitmap that one entry of its rank directory covers.
BLOCK = 512
#: Pre-tokens of a generation that a worker remembers.
REMEMBERED = 370_000
MAGIC = b"DAC1"


def dac_encode(ids: np.ndarray) -> bytes:
    """The code of unsigned ids below 2**32: magic, levels; then for each level its length, chunks, bitmap and rank directory."""
    rest, levels = np.asarray(ids), []
    while True:
        chunks, rest_next = rest.astype(np.uint8), rest >> 8
        goes_on = rest_next > 0
        bits = np.zeros(-(-len(rest) // BLOCK) * BLOCK // 8, dtype=np.uint8)
        bits[: -(-len(rest) // 8)] = np.packbits(goes_on, bitorder="little")
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(np.array([len(rest)], "<u8").tobytes() + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest_next[goes_on]
        if not len(rest):
            return MAGIC + bytes([len(levels)]) + b"".join(levels)


class DirectCodes:
    """Reads a code: single tokens, slices or all."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        at, self.levels = 5, []
        for _ in range(code[4]):
            n = int(np.frombuffer(code, "<u8", 1, at)[0])
            blocks = -(-n // BLOCK)
            chunks = np.frombuffer(code, np.uint8, n, at + 8)
            bits = np.frombuffer(code, np.uint8, blocks * BLOCK // 8, at + 8 + n)
            ranks = np.frombuffer(code, "<u4", blocks + 1, at + 8 + n + blocks * BLOCK // 8)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + blocks * BLOCK // 8 + 4 * (blocks + 1)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def token(self, i: int) -> int:
        """The i-th id, from one chunk a level."""
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = int.from_bytes(bits[block * BLOCK // 8 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - block * BLOCK)) - 1)
            i = int(ranks[block]) + inside.bit_count()
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the slices of each level that they lead to."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        out = self.levels[0][0][start:stop].astype(np.uint32)
        where = None
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if k:
                out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            low = start // BLOCK * BLOCK
            flags = np.unpackbits(bits[low // 8 : -(-stop // 8)], bitorder="little").astype(bool)
            first = int(ranks[low // BLOCK]) + int(flags[: start - low].sum())
            goes_on = flags[start - low : stop - low]
            where = np.flatnonzero(goes_on) if where is None else where[goes_on]
            if not len(where):
                break
            start, stop = first, first + len(where)
        return out

    def all(self) -> np.ndarray:
        return self.slice(0, len(self))


def byte_letters() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on, in order."""
    others = iter(range(256, 512))
    return {b: b if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else next(others) for b in range(256)}


def _width(size: int) -> str:
    """Two bytes an id, or four."""
    return "H" if size <= 1 << 16 else "I"


def _quick(pattern: str) -> str:
    """The same alternatives, with the contractions' quotation mark tested once."""
    return pattern.replace("'s|'t|'re|'ve|'m|'ll|'d", "'(?:s|t|re|ve|m|ll|d)")


def _encoder(source: str, form: str) -> PreTokens:
    """Pre-token to its ids as little-endian bytes of struct's form, by the tokenizers library."""
    from tokenizers import Tokenizer

    model, letters = Tokenizer.from_str(source).model, byte_letters()

    def encode(piece: str) -> bytes:
        found = [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(letters))]
        return struct.pack(f"<{len(found)}{form}", *found)

    return PreTokens(encode, REMEMBERED)


class AddedTokens:
    """The tokens that a tokenizer file adds to its model: found before texts are split, those that aren't normalized first, the longest at each place."""

    def __init__(self, source: str):
        import regex
        from tokenizers import Tokenizer

        id_of = Tokenizer.from_str(source).token_to_id  # an entry of the model keeps the model's id
        entries = [t for t in json.loads(source).get("added_tokens") or [] if t["content"]]
        self.ids = {t["content"]: id_of(t["content"]) for t in entries}

        def form(t: dict) -> str:
            word = regex.escape(t["content"])
            word = rf"(?<!\w){word}(?!\w)" if t.get("single_word") else word
            return (r"\p{White_Space}*" if t.get("lstrip") else "") + f"({word})" + (r"\p{White_Space}*" if t.get("rstrip") else "")

        groups = [[t for t in entries if bool(t.get("normalized")) == late] for late in (False, True)]
        self.patterns = [regex.compile("(?|" + "|".join(map(form, sorted(g, key=lambda t: -len(t["content"])))) + ")") for g in groups if g]

    def within(self, text: str) -> bool:
        return any(map(text.__contains__, self.ids))

    def split(self, text: str) -> list[str | int]:
        """The text in pieces, with an id where an added token stands."""
        out: list[str | int] = [text]
        for pattern in self.patterns:
            pieces, out = out, []
            for piece in pieces:
                if isinstance(piece, int):
                    out.append(piece)
                    continue
                at = 0
                for m in pattern.finditer(piece):
                    out += [piece[at : m.start()], self.ids[m[1]]]
                    at = m.end()
                out.append(piece[at:])
        return out


def _ranges(docs: DataFrame, id_col: str, range_docs: int) -> list[int]:
    """Upper bounds of ranges of about equally many documents, RANGES at most; reads the ids only."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    wanted = min(RANGES, ids.count() // range_docs)
    if wanted < 1:
        return []
    found = ids.approxQuantile("doc_id", [i / (wanted + 1) for i in range(1, wanted + 1)], 0.2 / wanted)
    return sorted({int(x) for x in found})


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, range_docs: int = RANGE_DOCS) -> None:
    """Writes the ids of every text, each followed by end_id, in ascending doc_id order."""
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    key = hashlib.sha256(source.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(source)  # a tokenizer file: its size doesn't depend on the data
    bounds = np.array(_ranges(docs, id_col, range_docs), dtype=np.int64)
    from tokenizers import Tokenizer

    form = _width(max(Tokenizer.from_str(source).get_vocab_size(), end_id + 1, *(i + 1 for i in AddedTokens(source).ids.values())))
    end, width = struct.pack(f"<{form}", end_id), struct.calcsize(f"<{form}")

    def encode(batches):
        import regex

        split, (met, added) = regex.compile(_quick(pattern)).findall, kept(key, lambda: (_encoder(shared.value, form), AddedTokens(shared.value)))

        def code(text: str) -> bytes:
            if not added.within(text):
                return b"".join([*map(met.__getitem__, split(text)), end])
            return b"".join([*(struct.pack(f"<{form}", x) if isinstance(x, int) else b"".join(map(met.__getitem__, split(x))) for x in added.split(text)), end])

        for batch in batches:
            ids = batch.column(0)
            codes = [code(text or "") for text in batch.column(1).to_pylist()]
            known = np.array([np.iinfo(np.int64).max if x is None else x for x in ids.to_pylist()], dtype=np.int64)
            parts = np.searchsorted(bounds, known, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), ids, pa.array([len(x) // width for x in codes], pa.int64()), pa.array(codes, pa.binary())], names=["part", "doc_id", "n", "ids"])

    def pack(batches):
        part, before, held, size = None, 0, [], 0

        def full():
            tokens = np.frombuffer(b"".join([x for _, _, x in held]), f"<u{width}")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([[i for i, _, _ in held]], pa.list_(pa.int64())),
                    pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                    pa.array([dac_encode(tokens)], pa.binary()),
                ],
                names=["part", "before", "n_tokens", "doc_ids", "lengths", "code"],
            )

        for batch in batches:
            for p, i, n, x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size >= segment):
                    yield full()
                    before, held, size = before + size, [], 0
                if p != part:
                    part, before = p, 0
                held.append((i, n, x))
                size += n
        if held:
            yield full()

    rows = map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), encode, "part int, doc_id long, n long, ids binary")
    # A partition a range: dealt by hash, ranges would meet in some partitions and leave others empty.
    dealt = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "ids")
    packed = map_arrow(dealt, pack, "part int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, code binary")
    with small_batches(docs.sparkSession):
        packed.write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with their place in the whole: part, start, n_tokens, doc_ids, lengths, code."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base", "before")  # RANGES rows at most


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start, ids."""

    def unpack(batches):
        for batch in batches:
            for start, ids, lengths, code in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = DirectCodes(code).all()
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start + starts[:-1], pa.int64()), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens.astype(np.int64)))], names=["doc_id", "start", "ids"]
                )

    return map_arrow(segments(spark, path).select("start", "doc_ids", "lengths", "code"), unpack, "doc_id long, start long, ids array<long>")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start, ids, lengths, code in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = DirectCodes(code).all().astype("<u4")
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                sums = [zlib.crc32(tokens[a:b]) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + starts[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(segments(spark, path).select("start", "doc_ids", "lengths", "code"), digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
