"""Phrase collocations from position bitmaps.

A shard is about ``SHARD`` consecutive words of a task's documents. Each word of
it has a bitmap of its positions, kept as its non-empty blocks of ``BLOCK``
positions. The ends of a phrase are a bitmap too: shifted by one and ANDed with
the words' bitmaps it gives the ends of all longer phrases, and their popcounts
are the occurrences. The ends of pieces take a position that belongs to no word,
so no phrase reaches over them. Popcounts are summed over shards by Spark.

1. Words are counted; those below the support can't be in a candidate.
2. Neighbours among the others are counted by cells of their hashes, a few bytes
   each: pairs in cells below the support are below it too. There is about a cell
   for ``SPREAD`` words, 2 ** ``MOST_BITS`` at most.
3. Pairs in the other cells are counted.
4. From pairs that reach the support phrases grow depth-first, a class of pairs
   at a time up to the longest, wherever every two neighbours are such a pair.

Which words and pairs reach the support is known to tasks through bitmaps of
bounded size over their hashes; what these let through wrongly is counted like the
rest and fails at the support, so counts and results are exact.

Defined cases: null texts have no words; a null language counts as "und"; empty
pieces and texts give nothing; ties are ranked by count, then by phrase in byte
order; very long texts are whole; repeated rows count as often as they stand;
an empty table gives an empty result; other columns are unread.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.llm.bitmaps import bitmap_of, in_bitmap
from trekframe.llm.common import map_arrow, small_batches, written
from trekframe.llm.terms import chained

#: Least occurrences of a candidate; most words of a phrase; phrases that a language's report has.
SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Words of a shard; positions of a block, as a power of two; rows of bitmaps that are shifted and ANDed at once; rows of an Arrow batch.
SHARD, BLOCK, AT_ONCE, BATCH = 1 << 21, 4, 1 << 16, 1 << 17

#: Words for a cell; log2 of the fewest and the most cells; log2 of the cells of a slice.
SPREAD, LEAST_BITS, MOST_BITS, SLICE = 4, 20, 28, 16

#: Ends of pieces, A-Z aside, as a byte of their own.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in lower case, and b"." wherever a piece ends."""
    return (text or "").encode().lower().translate(_ENDS).replace(b".", b" . ").split()


class _Numbers(dict):
    """Numbers of a language's words in the lists of a shard; it refers to these, not to the shard, so that nothing that goes by refers to itself and all of it is freed at once."""

    def __init__(self, words: list[bytes], langs: list[str], lang: str):
        self.words, self.langs, self.lang = words, langs, lang
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        self.langs.append(self.lang)
        return n


class Shard:
    def __init__(self):
        self.words, self.langs = [b"."], [""]
        self.numbers: dict[str, _Numbers] = {}
        self.parts, self.size = [], 0

    def add(self, lang: str, text: str | None) -> None:
        found = tokens(text)
        if found:
            if lang not in self.numbers:
                self.numbers[lang] = _Numbers(self.words, self.langs, lang)
            self.parts += (np.fromiter(map(self.numbers[lang].__getitem__, found), np.int32, len(found)), np.zeros(1, np.int32))
            self.size += len(found)

    def positions(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.words, self.langs)


def word_hashes(words: list[bytes], langs: list[str]) -> np.ndarray:
    import xxhash

    seeds = {lang: xxhash.xxh64_intdigest(lang.encode()) for lang in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in zip(words, langs)), np.uint64, len(words))


def shard_cells(shard: Shard, frequent: np.ndarray, bits: int, support: int):
    """How often the pairs of neighbours among frequent words fall into each cell: a row a slice of cells, with the places of its cells and their counts."""
    hashes, ids = shard.hashes(), shard.positions()
    kept = in_bitmap(frequent, hashes)
    kept[0] = False
    both = np.flatnonzero(kept[ids[:-1]] & kept[ids[1:]])
    cells, n = np.unique((chained_pair(hashes[ids[both]], hashes[ids[both + 1]]) >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
    slices = cells >> SLICE
    start = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(cells) else np.zeros(0, np.int64)
    pack = zstandard.ZstdCompressor(level=1).compress
    n = np.minimum(n, support).astype(_count_type(support))  # no more matters, a sum reaches the support all the same
    frames = [pack(np.diff(cells[a:b] & 0xFFFF, prepend=0).astype(np.uint16).tobytes() + n[a:b].tobytes()) for a, b in zip(start, [*start[1:], len(cells)])]
    yield pa.RecordBatch.from_arrays([pa.array(slices[start].astype(np.int32)), pa.array(frames, pa.binary())], names=["slice", "cells"])


def _count_type(support: int) -> np.dtype:
    return np.dtype(np.uint8 if support < 256 else np.int64)


def merged_cells(batches, support: int):
    """A bit for each cell of a slice whose counts reach the support; rows come by slice."""
    unpack, held, key = zstandard.ZstdDecompressor().decompress, None, None

    def bits():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([np.packbits(held >= support, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    for batch in batches:
        for slice_, frame in zip(*(c.to_pylist() for c in batch.columns)):
            if slice_ != key:
                if key is not None:
                    yield bits()
                held, key = np.zeros(1 << SLICE, np.int64), slice_
            raw, kind = unpack(frame), _count_type(support)
            size = len(raw) // (2 + kind.itemsize)
            held[np.cumsum(np.frombuffer(raw[: 2 * size], np.uint16), dtype=np.int64)] += np.frombuffer(raw[2 * size :], kind)
    if key is not None:
        yield bits()


def _shards(batches, fn):
    """What fn yields for each shard of the batches (lang, text)."""
    shard = Shard()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            shard.add(lang, text.as_py())
            if shard.size >= SHARD:
                yield from fn(shard)
                shard = Shard()
    if shard.size:
        yield from fn(shard)


def _rows(lang: pa.Array, phrase: pa.Array, n: np.ndarray):
    for at in range(0, len(n), BATCH):
        yield pa.RecordBatch.from_arrays([lang[at : at + BATCH], phrase[at : at + BATCH], pa.array(n[at : at + BATCH], pa.int64())], names=["lang", "phrase", "n"])


def bitmaps(ids: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, word and mask of all non-empty blocks of the words' position bitmaps, by block; kept: which words count."""
    at = np.flatnonzero(kept[ids])
    keys = np.sort(((at >> BLOCK) * len(kept) + ids[at]) << BLOCK | (at & ((1 << BLOCK) - 1)))
    start = np.flatnonzero(np.r_[True, np.diff(keys >> BLOCK) != 0]) if len(keys) else np.zeros(0, np.int64)
    masks = np.left_shift(np.uint32(1), (keys & ((1 << BLOCK) - 1)).astype(np.uint32))
    masks = np.bitwise_or.reduceat(masks, start) if len(keys) else masks
    owner = keys[start] >> BLOCK
    return owner // len(kept), owner % len(kept), masks


def extended(rows, words, n_blocks: int):
    """The rows (block, phrase, mask) shifted by one and ANDed with the words' bitmaps: block, phrase, word and mask of what is left."""
    block, phrase, mask = rows
    w_block, w_word, w_mask = words
    full = np.uint32((1 << (1 << BLOCK)) - 1)
    inside, over = (mask << np.uint32(1)) & full, mask >> np.uint32((1 << BLOCK) - 1)
    a, b = np.flatnonzero(inside), np.flatnonzero(over)
    block, phrase, mask = np.r_[block[a], block[b] + 1], np.r_[phrase[a], phrase[b]], np.r_[inside[a], over[b]]
    start = np.searchsorted(w_block, np.arange(n_blocks + 2))
    out = [[], [], [], []]
    for low in range(0, len(block), AT_ONCE):
        part = slice(low, low + AT_ONCE)
        first, n = start[block[part]], start[block[part] + 1] - start[block[part]]
        left = np.repeat(np.arange(len(n)), n)
        right = np.arange(len(left)) + np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n)
        both = mask[part][left] & w_mask[right]
        hit = np.flatnonzero(both)
        for x, values in zip(out, (block[part][left[hit]], phrase[part][left[hit]], w_word[right[hit]], both[hit])):
            x.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _numbered(phrase: np.ndarray, word: np.ndarray, mask: np.ndarray, n_words: int):
    """Number of each row's longer phrase, and by number: its shorter phrase, its last word, its occurrences."""
    keys, number = np.unique(phrase.astype(np.int64) * n_words + word, return_inverse=True)
    n = np.bincount(number, np.bitwise_count(mask), len(keys)).astype(np.int64)
    return number, keys // n_words, keys % n_words, n


def shard_words(shard: Shard):
    n = np.bincount(shard.positions(), minlength=len(shard.words))[1:]
    yield from _rows(pa.array(shard.langs[1:], pa.string()), pa.array([w.decode() for w in shard.words[1:]], pa.string()), n)


@dataclass
class _Growth:
    """What all phrases of a shard grow by. Its own class, as a function that calls itself from within another would hold the shard until Python looks for such circles."""

    words: tuple[np.ndarray, np.ndarray, np.ndarray]
    n_blocks: int
    texts: pa.Array
    langs: pa.Array
    hashes: np.ndarray
    pairs: np.ndarray
    longest: int

    def longer(self, rows, phrases: pa.Array, lang_of: np.ndarray, last: np.ndarray, length: int):
        """Longer phrases of the phrases that rows hold, and then theirs."""
        block, phrase, word, mask = extended(rows, self.words, self.n_blocks)
        ok = in_bitmap(self.pairs, chained_pair(self.hashes[last[phrase]], self.hashes[word]))
        block, phrase, word, mask = block[ok], phrase[ok], word[ok], mask[ok]
        if not len(block):
            return
        number, shorter, word, n = _numbered(phrase, word, mask, len(self.hashes))
        del phrase, ok
        longer, lang_of = pc.binary_join_element_wise(phrases.take(pa.array(shorter)), self.texts.take(pa.array(word)), " "), lang_of[shorter]
        if self.longest == 2 or length > 1:
            yield from _rows(self.langs.take(pa.array(lang_of)), longer, n)
        if length + 1 < self.longest:
            yield from self.longer((block, number, mask), longer, lang_of, word, length + 1)


def shard_phrases(shard: Shard, frequent: np.ndarray, pairs: np.ndarray, longest: int):
    """Phrases of the shard with their occurrences, whose words, and whose neighbouring words as pairs, the bitmaps hold: pairs if they are the longest, else phrases of three words or more."""
    hashes, ids = shard.hashes(), shard.positions()
    kept = in_bitmap(frequent, hashes)
    kept[0] = False
    words = bitmaps(ids, kept)
    growth = _Growth(words, (len(ids) >> BLOCK) + 1, pa.array([w.decode() for w in shard.words], pa.string()), pa.array(shard.langs, pa.string()), hashes, pairs, longest)
    every = np.arange(len(shard.words))
    of_class = (every * 2654435761 >> 7) % max(1, len(words[0]) // (4 * AT_ONCE))
    for c in range(of_class.max() + 1):
        own = np.flatnonzero(of_class[words[1]] == c)
        yield from growth.longer(tuple(x[own] for x in words), growth.texts, every, every, 1)


def chained_pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of words from those of the words."""
    return chained(np.stack([first, second], 1).ravel(), 2)[::2] if len(first) else np.zeros(0, np.uint64)


def _hash_bitmap(phrases: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of words, or of pairs of words, of a table of frequent ones (lang, phrase)."""

    def run(batches):
        for batch in batches:
            langs, found = batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            hashes = word_hashes([p[0] for p in found], langs)
            if found and len(found[0]) == 2:
                hashes = chained_pair(hashes, word_hashes([p[1] for p in found], langs))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["token"])

    return bitmap_of(map_arrow(phrases.select("lang", "phrase"), run, "token long", batch_rows=10_000), "token")


def _cell_bitmap(slices: DataFrame, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 3), np.uint8)
    with small_batches(slices.sparkSession):
        for slice_, found in zip(*(c.to_pylist() for c in slices.toArrow().columns)):
            out[slice_ << (SLICE - 3) : (slice_ + 1) << (SLICE - 3)] = np.frombuffer(found, np.uint8)
    return out.view(np.uint64)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to ``longest`` words that occur ``support`` times in a language or more (lang, phrase, k words, f), and each language's words (lang, n)."""
    broadcast = docs.sparkSession.sparkContext.broadcast
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def summed(fn, tag: str) -> DataFrame:
        found = map_arrow(rows, lambda batches: _shards(batches, fn), "lang string, phrase string, n long")
        return found.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))

    every = written(summed(shard_words, "words"), "words")
    words = written(every.where(F.col("f") >= support), "frequent-words")
    frequent = broadcast(_hash_bitmap(words))  # 8 MB
    bits = min(MOST_BITS, max(LEAST_BITS, ((every.agg(F.sum("f")).first()[0] or 0) // SPREAD).bit_length()))
    cells = map_arrow(rows, lambda batches: _shards(batches, lambda shard: shard_cells(shard, frequent.value, bits, support)), "slice int, cells binary")
    cells = broadcast(_cell_bitmap(map_arrow(cells.repartition("slice").sortWithinPartitions("slice"), lambda batches: merged_cells(batches, support), "slice int, bits binary"), bits))  # 32 MB at most
    pairs = written(summed(lambda shard: shard_phrases(shard, frequent.value, cells.value, 2), "pairs").where(F.col("f") >= support), "frequent-pairs")
    paired = broadcast(_hash_bitmap(pairs))  # 8 MB
    longer = written(summed(lambda shard: shard_phrases(shard, frequent.value, paired.value, longest), "phrases").where(F.col("f") >= support), "frequent-phrases")
    found = words.unionByName(pairs).unionByName(longer)
    return found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "f"), every.groupBy("lang").agg(F.sum("f").alias("n"))


def exact_score() -> Column:
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    return F.expr("cast(cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(n as decimal(15,0)) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a (its occurrences), l and r (those of the parts of its worst cut), n (the language's words), score."""
    phrases, words = phrase_counts(docs, lang_col, text_col, support, longest)
    several = phrases.where("k > 1")
    # A longer candidate that holds a phrase and occurs as often has, one word at a time, others between that occur as often.
    parts = several.where("k > 2").select("lang", "f", F.explode(F.array(F.regexp_replace("phrase", r" [^ ]*$", ""), F.regexp_replace("phrase", r"^[^ ]* ", ""))).alias("phrase")).distinct()
    left = several.join(parts, ["lang", "phrase", "f"], "left_anti")
    split = F.split("phrase", " ")
    cuts = left.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select("lang", "phrase", F.col("f").alias("a"), "cut", F.array_join(F.slice(split, 1, F.col("cut")), " ").alias("first"), F.array_join(F.slice(split, F.col("cut") + 1, F.col("k")), " ").alias("rest"))
    of = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    rated = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(words, "lang")
    rated = rated.withColumn("score", exact_score())
    worst = rated.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "cut", "l", "r")).alias("cut"))
    worst = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return worst.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
