"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (all of them, if the item
has fewer), taken as the set of its shingles of ``SHINGLE`` words. A document
contains a window only if it has all of its shingles, so for whole containment
one of them is the necessary prefix: the rarest in the order of how often
shingles occur in all documents. A window with a shingle that no document has
can't occur at all.

1. Shingles of the items are counted in all documents: a bitmap of fixed size
   lets their hashes through, Spark adds up what tasks have counted.
2. Documents emit the places of prefix shingles, with the words around.
3. The join with the windows on the prefix shingle bounds the place: as many
   words must stand before it, and as many after, as in the window.
4. Containment is verified word for word in place; the words of all occurrences
   are united, so overlaps count once.

Documents are read twice; only places of rare shingles are shuffled, and one
short row a document.

Defined cases: null texts and texts without a word have no words and aren't hit;
items without a word have no window; a null item_id counts as the item ""; rows
of items with one item_id are one item; rows of documents stand for themselves,
whatever their doc_id; very long texts are whole; an empty table of documents
gives an empty result, one of items hits nothing; other columns are unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.bitmaps import bitmap_of, in_bitmap
from trekframe.llm.common import kept, map_arrow, written
from trekframe.llm.terms import WordHashes, chained, terms

#: Words of a window, of a shingle.
WINDOW, SHINGLE = 10, 3
#: Distinct shingles that a task counts before it hands the counts on.
COUNTED = 1 << 20


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(kept("decontamination words", WordHashes).__getitem__, words), np.uint64, len(words))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """words (of a distinct window, in order), n, size (of its shingles), shingles (their hashes by place), items (sorted ids as strings)."""

    def run(batches):
        for batch in batches:
            ids, words, sizes, hashes = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(text)
                n = min(window, len(found))
                size = min(shingle, n)
                places = chained(_hashes(found), size).view(np.int64) if n else []
                for i in range(len(found) - n + 1 if n else 0):
                    ids.append(item or "")
                    words.append([w.decode() for w in found[i : i + n]])
                    sizes.append(size)
                    hashes.append(places[i : i + n - size + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.list_(pa.string())), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))], names=["item", "words", "size", "shingles"])

    rows = map_arrow(items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")), run, "item string, words array<string>, size int, shingles array<long>", batch_rows=100)
    return written(rows.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.sort_array(F.collect_set("item")).alias("items")), "windows")


def shingle_counts(docs: DataFrame, windows: DataFrame, text_col: str, sizes: list[int]) -> DataFrame:
    """token and n: how often each shingle of the windows occurs in all documents; none for those that don't."""
    wanted = windows.select(F.explode("shingles").alias("token")).distinct()
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "token"))  # 8 MB

    def run(batches):
        parts, n = [], 0

        def counted():
            tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                hashes = _hashes(terms(text.as_py()))
                for size in sizes:
                    tokens = chained(hashes, size)
                    parts.append(tokens[in_bitmap(bitmap.value, tokens)].view(np.int64))
                    n += len(parts[-1])
            if n >= COUNTED:
                yield counted()
                parts, n = [], 0
        if n:
            yield counted()

    found = map_arrow(docs.select(F.col(text_col).cast("string")), run, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).join(wanted, "token", "left_semi")


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with token, their rarest shingle, and its place (offset) in them, where all of their shingles occur in documents."""
    places = windows.select("words", F.size("shingles").alias("n_shingles"), F.posexplode("shingles").alias("offset", "token")).join(counts, "token")
    rarest = places.groupBy("words").agg(F.min(F.struct("n", "token", "offset")).alias("first"), F.count("*").alias("there"), F.first("n_shingles").alias("n_shingles"))
    rarest = rarest.where("there = n_shingles").select("words", "first.token", "first.offset")
    return written(windows.select("words", "items").join(rarest, "words"), "prefixes")


def prefix_places(docs: DataFrame, prefix: DataFrame, id_col: str, text_col: str, sizes: list[int], window: int) -> DataFrame:
    """One row a document: doc_id, n_words, and the places of prefix shingles (token, at, and the words that a window over them can hold, from word ``start`` on)."""
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(prefix, "token"))  # 8 MB
    kind = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            n_words, places = [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                hashes, found = _hashes(words), []
                for size in sizes:
                    tokens = chained(hashes, size)
                    for at in np.flatnonzero(in_bitmap(bitmap.value, tokens)).tolist():
                        start = max(0, at + size - window)
                        around = [w.decode() for w in words[start : at + window]]
                        found.append({"token": int(tokens[at].astype(np.int64)), "at": at, "start": start, "words": around})
                n_words.append(len(words))
                places.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(places, kind)], names=["doc_id", "n_words", "places"])

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    found = map_arrow(rows, run, f"doc_id {kind_of_id}, n_words long, places array<struct<token:long,at:long,start:long,words:array<string>>>")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "prefix-places")


def occurrences(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """row, start, end (exclusive, in words) and items of every occurrence of a window."""
    asked = places.where(F.size("places") > 0).select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.token", "p.at", F.col("p.start").alias("around_from"), F.col("p.words").alias("around"))
    start, n = F.col("at") - F.col("offset"), F.size("words")
    bounded = asked.join(prefix, "token").where((start >= 0) & (start + n <= F.col("n_words")))
    same = F.slice("around", (start - F.col("around_from") + 1).cast("int"), n) == F.col("words")
    return bounded.where(same).select("row", start.alias("start"), (start + n).alias("end"), "items")


def _covered(spans):
    """Words in the union of spans (structs of start and end), sorted by start."""
    step = lambda seen, s: F.struct((seen["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], seen["upto"]))).alias("n"), F.greatest(seen["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), step, lambda seen: seen["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items (items with such windows), items_sha256 (of their ids, sorted, comma-joined), contaminated, items."""
    windows = item_windows(items, item_id, item_text, window, shingle)
    sizes = sorted(r[0] for r in windows.select("size").distinct().toLocalIterator())  # shingle of them at most
    prefix = prefixes(windows, shingle_counts(docs, windows, text_col, sizes))
    places = prefix_places(docs, prefix, id_col, text_col, sizes, window)
    hit = occurrences(places, prefix).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = places.select("row", "doc_id", "n_words").join(hit.select("row", _covered(F.col("spans")).alias("n_hit"), "items"), "row", "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", found), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), found.alias("items"))


def clean_documents(docs: DataFrame, items: DataFrame, most: float = 0.0, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the texts of whose words more than the share ``most`` lies inside windows of items; columns as they came."""
    key = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    texts = docs.select(key.alias("text_key"), F.col(text_col).cast("string").alias("text"))
    dirty = contamination(texts, items, "text_key", "text", item_id, item_text).where(F.col("n_hit") > most * F.col("n_words")).select(F.col("doc_id").alias("text_key")).distinct()
    return docs.select(F.struct("*").alias("doc"), key.alias("text_key")).join(dirty, "text_key", "left_anti").select("doc.*")
