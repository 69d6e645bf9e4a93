"""Ranked lexical search over hierarchical max trees.

Documents are taken in ranges of up to ``RANGE`` as tasks meet them. For every
term of a range the index has a row: the documents that hold it with the term's
impact in each, and above them a tree of nodes of ``FAN`` children with the
largest impact below each. The ranges' roots are the tree's upper level.

A search adds, for each item and range, the weighted roots of the item's terms:
no document of the range scores more. The ranges with the highest sums are
opened first; the k-th best score among them is the floor for all others, and
only ranges whose sum reaches it are opened too. In an opened range the search
goes best first: the node with the highest sum of bounds is opened next, until
the highest is below the k-th best score. Nodes whose bound equals it are still
opened, as ties go by document. Scores and bounds are whole numbers, so the
result is exact whatever the order in which documents came.

Defined cases: null texts and texts without a term are in no result and don't
count; rows with one doc_id are documents of their own; null ids rank last
among equal scores; an item without terms, or whose terms occur nowhere, has no
row; rows of items with one item_id are searched one by one; very long texts are
whole; no documents or no items give an empty result; other columns are unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekframe.llm.common import map_arrow, written
from trekframe.llm.terms import TERM, terms

#: Children of a node; documents of a range; words at which a range ends early.
FAN, RANGE, RANGE_WORDS = 16, 4096, 1 << 22
#: Rows of the index in an Arrow batch.
ROWS = 50_000
#: Nodes that are opened at once.
OPENED = 16
#: Ranges opened first for each item; log2 of the items that one task answers for a range.
FIRST, ITEM_BITS = 4, 8

_INDEX = "shard long, term string, n long, top long, tree binary, ids array<long>"


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(TERM)).cast("long")
    row = docs.select(n.alias("n")).where("n > 0").agg(F.count("*"), F.sum("n")).first()
    return row[0], row[1] or 0


class _Numbers(dict):
    """Numbers of terms in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _above(owner: np.ndarray, nodes: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, nodes and maxima one level higher in the owners' trees."""
    start = _starts(owner, nodes // FAN)
    return owner[start], nodes[start] // FAN, np.maximum.reduceat(most, start) if len(start) else most


def packed_trees(owner: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A binary for each term, and its number of documents and largest impact.

    The binary has 32-bit numbers: how many documents, low and high nodes there
    are, then documents and impacts, and nodes and maxima of either level. A term
    of at most FAN documents has no nodes of its own, its documents are as few.
    """
    n = np.bincount(owner, minlength=n_terms)
    top = np.maximum.reduceat(impacts, _starts(owner))
    large = n[owner] > FAN
    low = _above(owner[large], docs[large], impacts[large])
    high = _above(*low)
    counts = np.stack([n, *(np.bincount(level[0], minlength=n_terms) for level in (low, high))])
    offsets = np.r_[0, np.cumsum(3 + 2 * counts.sum(axis=0))]
    out = np.zeros(offsets[-1], np.int32)
    for i in range(3):
        out[offsets[:-1] + i] = counts[i]
    at = offsets[:-1] + 3
    for i, (who, nodes, most) in enumerate(((owner, docs, impacts), low, high)):
        place = at[who] + np.arange(len(who)) - (np.cumsum(counts[i]) - counts[i])[who]
        out[place], out[place + counts[i][who]] = nodes, most
        at = at + 2 * counts[i]
    return pa.Array.from_buffers(pa.binary(), n_terms, [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(out)]), n, top


def unpacked_trees(trees: pa.Array) -> dict[str, np.ndarray]:
    """Of each level, for all rows of trees together: keys row * nodes of the level + node in order, and their maxima."""
    values = np.frombuffer(b"".join(trees.to_pylist()), np.int32).astype(np.int64)
    at = (np.r_[0, np.cumsum(pc.binary_length(trees).to_numpy(zero_copy_only=False))[:-1]] // 4).astype(np.int64)
    counts, at = [values[at + i] for i in range(3)], at + 3
    levels = []
    for n in counts:
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + at[owner]
        levels.append((owner, values[place], values[place + n[owner]]))
        at = at + 2 * n
    small = counts[0][levels[0][0]] <= FAN
    derived = _above(*(x[small] for x in levels[0]))
    out = {}
    for name, per_row, parts in (("docs", RANGE, (levels[0],)), ("low", FAN * FAN, (levels[1], derived)), ("high", FAN, (levels[2], _above(*derived)))):
        keys = np.concatenate([p[0] * per_row + p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        out[name], out[f"{name}_max"] = keys[order], np.concatenate([p[2] for p in parts])[order]
    return out


class _Range:
    """Terms of the documents of one range, until its trees are made."""

    def __init__(self):
        self.numbers = _Numbers()
        self.ids, self.lengths, self.parts, self.words = [], [], [], 0

    def add(self, doc_id, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)) * RANGE + len(self.ids))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.words += len(words)

    def rows(self, shard: int, n_docs: int, n_terms: int):
        keys = np.sort(np.concatenate(self.parts))
        start = _starts(keys)
        tf, keys = np.diff(np.r_[start, len(keys)]), keys[start]
        damping = np.array([10 + 90 * n * n_docs // n_terms for n in self.lengths], np.int64)
        owner, docs = keys // RANGE, keys % RANGE
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * damping[docs])
        trees, n, top = packed_trees(owner, docs, impacts, len(self.numbers))
        terms = pa.array([t.decode() for t in self.numbers], pa.string())
        size = len(terms)
        columns = [pa.array(np.full(size, shard), pa.int64()), terms, pa.array(n, pa.int64()), pa.array(top, pa.int64()), trees, pa.nulls(size, pa.list_(pa.int64()))]
        names = ["shard", "term", "n", "top", "tree", "ids"]
        for at in range(0, size, ROWS):
            yield pa.RecordBatch.from_arrays([c[at : at + ROWS] for c in columns], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(pa.nulls(1, c.type) for c in columns[1:5]), pa.array([self.ids], pa.list_(pa.int64()))], names=names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index of all documents, a written table, and how many documents hold a term.

    A row a term and range: shard (the range), term, n (its documents there), top
    (its largest impact) and its tree. One row more a range, with a null term, has
    the ids of the range's documents.
    """
    n_docs, n_terms = corpus_size(docs, text_col)

    def run(batches):
        task = TaskContext.get().partitionId()
        part, made = _Range(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if words:
                    part.add(doc_id, words)
                if len(part.ids) == RANGE or part.words >= RANGE_WORDS:
                    yield from part.rows(task << 32 | made, n_docs, n_terms)
                    part, made = _Range(), made + 1
        if part.ids:
            yield from part.rows(task << 32 | made, n_docs, n_terms)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return written(map_arrow(rows, run, _INDEX), "search-index"), n_docs


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number for each row of items), item_id, term: a row for each distinct term of an item."""

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for i, text in enumerate(batch.column(2)):
                words = sorted(set(terms(text.as_py())))
                owner += [i] * len(words)
                found += words
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([w.decode() for w in found], pa.string())], names=["item", "item_id", "term"])

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col), F.col(text_col).cast("string"))
    return written(map_arrow(rows, run, f"item long, item_id {kind}, term string"), "search-items")


def best_first(trees: dict[str, np.ndarray], rows: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the documents of one range that score at least the k-th best of it and floor, ties and all.

    trees: for each level the sorted keys row * nodes of the level + node, and
    the maxima of the nodes; rows and weights: those of the query's terms. The
    ``OPENED`` nodes with the highest bounds are opened at once.
    """

    def opened(level: str, per_row: int, nodes: np.ndarray) -> np.ndarray:
        """Sums over the terms for each of the FAN children of nodes."""
        keys, most = trees[level], trees[f"{level}_max"]
        starts = rows[:, None] * per_row + nodes * FAN
        a, b = np.searchsorted(keys, starts), np.searchsorted(keys, starts + FAN)
        n = (b - a).ravel()
        at = np.repeat(a.ravel() - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        place = np.repeat(np.tile(np.arange(len(nodes)) * FAN, len(rows)), n) + keys[at] % FAN
        worth = np.repeat(np.repeat(weights, len(nodes)), n) * most[at]
        sums = np.zeros(len(nodes) * FAN, np.int64)
        np.add.at(sums, place, worth)
        return sums

    def children(nodes: np.ndarray) -> np.ndarray:
        return (nodes[:, None] * FAN + np.arange(FAN)).ravel()

    floor = max(floor, 1)
    high = opened("high", FAN, np.zeros(1, np.int64))
    # Waiting nodes of the two inner levels, and their bounds.
    waiting = {"high": (np.arange(FAN), high), "low": (np.zeros(0, np.int64), np.zeros(0, np.int64))}
    positions, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    while True:
        for level, (nodes, bounds) in waiting.items():
            ok = bounds >= floor
            waiting[level] = nodes[ok], bounds[ok]
        level = max(waiting, key=lambda x: waiting[x][1].max(initial=0))
        nodes, bounds = waiting[level]
        if not len(nodes):
            break
        order = np.argsort(-bounds, kind="stable")
        first, rest = order[:OPENED], order[OPENED:]
        waiting[level] = nodes[rest], bounds[rest]
        below = children(nodes[first])
        if level == "high":
            sums = opened("low", FAN * FAN, nodes[first])
            waiting["low"] = np.r_[waiting["low"][0], below], np.r_[waiting["low"][1], sums]
            continue
        sums = opened("docs", RANGE, nodes[first])
        positions, scores = np.r_[positions, below[sums >= floor]], np.r_[scores, sums[sums >= floor]]
        if len(scores) >= k:
            floor = max(floor, int(np.partition(scores, -k)[-k]))
            positions, scores = positions[scores >= floor], scores[scores >= floor]
    return positions, scores


def _search_range(k: int):
    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"item": [], "doc_id": [], "score": []}
        trees, queries = trees.combine_chunks(), queries.sort_by("item").combine_chunks()
        if trees.num_rows and queries.num_rows:
            own = pc.is_null(trees.column("term"))
            ids = trees.filter(own).column("ids")[0].as_py()
            trees = trees.filter(pc.invert(own)).combine_chunks()
            flat = unpacked_trees(trees.column("tree").combine_chunks())
            row_of = {t: i for i, t in enumerate(trees.column("term").to_pylist())}
            item = queries.column("item").to_numpy()
            term, weight, floor = queries.column("term").to_pylist(), queries.column("w").to_numpy(), queries.column("floor").to_numpy()
            starts = np.flatnonzero(np.r_[True, np.diff(item) != 0]).tolist()
            for a, b in zip(starts, [*starts[1:], len(item)]):
                there = [i for i in range(a, b) if term[i] in row_of]
                rows = np.array([row_of[term[i]] for i in there], np.int64)
                at, scores = best_first(flat, rows, weight[there], int(floor[a]), k)
                found = sorted(((-s, ids[p] is None, ids[p] or 0, p) for p, s in zip(at.tolist(), scores.tolist())))[:k]
                out["item"] += [int(item[a])] * len(found)
                out["doc_id"] += [ids[p] for *_, p in found]
                out["score"] += [-s for s, *_ in found]
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score; equal scores by doc_id."""
    asked = item_terms(items, id_col, text_col)
    wanted = asked.select("term").distinct()
    roots = written(index.where("term is not null").join(wanted, "term").select("term", "shard", "top", "n"), "search-roots")
    df = roots.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = written(asked.join(df.select("term", weight.alias("w")), "term").select("item", "item_id", "term", "w"), "search-weights")
    bounds = roots.join(weighted.select("item", "term", "w"), "term").groupBy("item", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound"))
    bounds = written(bounds.where("bound > 0"), "search-bounds")

    def answers(ranges: DataFrame, tag: str) -> DataFrame:
        """ranges: item, shard and floor. The ranges' best documents for the items."""
        queries = ranges.join(weighted.select("item", "term", "w"), "item").withColumn("block", F.shiftright("item", ITEM_BITS))
        opened = ranges.select("shard", F.shiftright("item", ITEM_BITS).alias("block")).distinct()
        trees = index.where("term is null").unionByName(index.join(wanted, "term", "left_semi")).select("shard", "term", "tree", "ids").join(opened, "shard")
        return written(trees.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(_search_range(k), "item long, doc_id long, score long"), tag)

    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "shard")
    first = written(bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= FIRST).select("item", "shard"), "search-first")
    best = answers(first.withColumn("floor", F.lit(1).cast("long")), "search-found")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    floors = best.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == k).select("item", F.col("score").alias("floor"))
    rest = bounds.join(first, ["item", "shard"], "left_anti").join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).where("bound >= floor")
    found = best.unionByName(answers(rest.select("item", "shard", "floor"), "search-more"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    names = asked.select("item", "item_id").distinct()
    return ranked.join(names, "item").select(F.col("item_id"), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    index, n_docs = build_index(docs)
    return search(index, n_docs, items, k)
