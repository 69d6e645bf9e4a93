"""N-gram Jaccard join by a token-group matrix.

Documents become sets of hashed word shingles; documents with one set are one
(``set_id``), so copies cost nothing further. The join is exact:

1. Candidate tokens. In any order of all tokens, two sets that reach the
   threshold share at least ``SHARED`` (fewer for tiny sets) of the first
   n - ceil(t n) + SHARED tokens of each. The order puts tokens that occur in
   ``HEAVY`` or more sets last (kept in a bitmap of fixed size: when it fills
   up the order is still one and the join exact), so shared passages and common
   phrases hardly bring documents together.
2. Groups. The smallest set of each shared token leads it; a set joins the group
   of the leader with which it shares most tokens.
3. Token-group matrix. One row for each token and group: the union of the
   group's candidate tokens, with the sizes of its sets. A query set's overlap
   with a group's union bounds its overlap with every member: groups with fewer
   common tokens than the members' bound, or no fitting size, stay closed.
4. Opened groups are compared in blocks of about ``BLOCK`` sets. First all
   members with the group's first set; what links to it is one component. Then
   blocks that hold more than one component, against each other: the union of a
   block's whole sets bounds the overlap again, and only sets that pass are
   intersected. A block reports the links that join components, so a group of
   copies never turns into all its pairs.
5. Components of the links, and the smallest doc_id in each.

All texts are shingled twice, to count and to order tokens, and those of sets in
opened groups once more; only candidate tokens, links and the texts of opened
groups are shuffled.

Hash values have 64 bits: that any two of n distinct sets or shingles collide
has a chance of about n^2 / 2^65.

Defined cases: null text, or text without a word, has the empty set and links
with nothing; a text of fewer words than a shingle is one shingle; null doc_ids
are ignored in the smallest (a component of nulls has null); ``keep_one`` tells
rows apart by id and text; very long texts are whole; an empty table gives an
empty result; extra columns are unread or kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import kept, map_arrow, small_batches, written
from trekframe.llm.components import connected

#: Candidate tokens that linked sets share at least.
SHARED = 5
#: Sets that make a token common; sets in a block.
HEAVY, BLOCK = 16, 128
#: log2 of the bits of a bitmap (8 MB).
BITS = 26
#: Words that a worker remembers with their hash.
REMEMBERED = 700_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of a text's word shingles, A-Z in lower case; words are runs of anything but ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    hashes = np.fromiter(map(kept("word hashes", _Words).__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        size = len(words)
        mixed = np.full(1, size, np.uint64)  # apart from longer texts' shingles
    else:
        mixed = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        mixed = (mixed ^ hashes[i : i + len(mixed)]) * _MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def set_id(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _least(n: int, num: int, den: int) -> int:
    """Tokens that a set of n has in common at least with any set that it links with."""
    return -(-num * n // den)


def _prefix(n: int, num: int, den: int) -> int:
    least = _least(n, num, den)
    return n - least + min(SHARED, least)


def _in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values.view(np.uint64) >> np.uint64(64 - BITS)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Which top BITS bits occur among values: 2 ** (BITS - 6) words at most reach the driver, whatever the size of the table."""
    at = F.shiftrightunsigned(F.col(column), 64 - BITS)
    with small_batches(values.sparkSession):
        words = values.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def common_tokens(docs: DataFrame, text_col: str, size: int, num: int, den: int) -> np.ndarray:
    """Bitmap of the tokens that HEAVY or more sets have among their first ones in hash order, a quarter more of them than are needed."""

    def first(batches):
        seen = set()
        for batch in batches:
            out = []
            for text in batch.column(0):
                tokens = shingle_set(text.as_py(), size)
                if len(tokens) and (key := set_id(tokens)) not in seen:
                    seen.add(key)
                    want = _prefix(len(tokens), num, den)
                    out.append(tokens[: want + want // 4])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["token"])

    tokens = map_arrow(docs.select(F.col(text_col).cast("string")), first, "token long")
    return _bitmap(tokens.groupBy("token").count().where(F.col("count") >= HEAVY), "token")


def token_sets(docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """One row a document: doc_id, n (shingles), set_id (null for the empty set), first: its candidate tokens, where a task meets a set for the first time."""
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, text_col, size, num, den))  # 8 MB

    def run(batches):
        bitmap, seen = common.value, set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            keys, sizes, firsts = [], [], []
            for text in batch.column(1):
                tokens = shingle_set(text.as_py(), size)
                key = set_id(tokens) if len(tokens) else None
                keys.append(key)
                sizes.append(len(tokens))
                if key is None or key in seen:
                    firsts.append(none)
                    continue
                seen.add(key)
                late = _in_bitmap(bitmap, tokens)
                firsts.append(np.concatenate([tokens[~late], tokens[late]])[: _prefix(len(tokens), num, den)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), _lists(firsts)], names=["doc_id", "n", "set_id", "first"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return written(map_arrow(rows, run, "doc_id long, n long, set_id long, first array<long>"), "sets")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """token, set_id, n and leader for the candidate tokens that two sets or more have."""
    tokens = sets.select("set_id", F.explode("first").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.min("set_id").alias("leader"), F.max("set_id").alias("last")).where("leader < last").drop("last"), "shared-tokens")
    bitmap = sets.sparkSession.sparkContext.broadcast(_bitmap(shared, "token"))  # 8 MB

    def survive(batches):
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            ok = np.flatnonzero(_in_bitmap(bitmap.value, values.astype(np.int64)))
            at = pa.array(owner[ok])
            yield pa.RecordBatch.from_arrays([pa.array(values[ok], pa.int64()), batch.column(0).take(at), batch.column(1).take(at)], names=["token", "set_id", "n"])

    left = map_arrow(sets.where(F.size("first") > 0).select("set_id", "n", "first"), survive, "token long, set_id long, n long")
    return written(left.join(shared, "token").groupBy("token", "set_id").agg(F.first("n").alias("n"), F.first("leader").alias("leader")), "hits")


def _bound(n: Column, num: int, den: int) -> Column:
    return F.least(F.lit(SHARED), F.ceil(num * n / den)).cast("long")


def similar_groups(hits: DataFrame, num: int, den: int) -> DataFrame:
    """set_id, n, grp: the leader with which a set shares most candidate tokens, itself if none shares enough."""
    by_leader = hits.groupBy("set_id", "leader").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    best = by_leader.groupBy("set_id").agg(F.max(F.struct("c", (-F.col("leader")).alias("order"), "leader")).alias("best"), F.first("n").alias("n"))
    return best.select("set_id", "n", F.when(F.col("best.c") >= _bound(F.col("n"), num, den), F.col("best.leader")).otherwise(F.col("set_id")).alias("grp"))


def qualifying(hits: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """set_id and grp where the matrix can't rule out that the set links with a member other than itself."""
    placed = hits.select("token", "set_id", "n").join(groups.select("set_id", "grp"), "set_id")
    matrix = placed.groupBy("token", "grp").agg(F.min(_bound(F.col("n"), num, den)).alias("bound"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("members"))
    query = placed.select("token", "set_id", F.col("n").alias("q"), F.col("grp").alias("own"))
    fits = (num * F.col("q") <= den * F.col("high")) & (num * F.col("low") <= den * F.col("q"))
    alone = (F.col("own") == F.col("grp")) & (F.col("members") == 1)
    overlap = query.join(matrix, "token").where(fits & ~alone).groupBy("set_id", "grp").agg(F.count("*").alias("c"), F.min("bound").alias("bound"), F.first("q").alias("q"))
    return overlap.where(F.col("c") >= F.least("bound", _bound(F.col("q"), num, den))).select("set_id", "grp")


def _row_key(id_: Column) -> Column:
    return F.xxhash64(F.coalesce(id_.cast("long"), F.lit(-(1 << 63))))


def opened_texts(docs: DataFrame, sets: DataFrame, opened: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """set_id and text of the sets in opened.

    The smallest doc_id of each such set marks the rows to read, in a bitmap of
    fixed size; only marked rows (and a few that fall on the same bits) are
    shingled again.
    """
    rows = sets.join(opened, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"))
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(rows.select(_row_key(F.col("doc_id")).alias("row")), "row"))  # 8 MB

    def run(batches):
        seen = set()
        for batch in batches:
            marked = pa.array(_in_bitmap(bitmap.value, batch.column(0).to_numpy()))
            keys, texts = [], []
            for text in batch.column(1).filter(marked).to_pylist():
                tokens = shingle_set(text, size)
                if len(tokens) and (key := set_id(tokens)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["set_id", "text"])

    rows = docs.select(_row_key(F.col(id_col)).alias("row"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = map_arrow(rows, run, "set_id long, text string")
    return written(found.join(opened, "set_id", "left_semi").dropDuplicates(["set_id"]), "opened-texts")


def _star_links(members: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of each group's members with its first set, a block of members at a time."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for first, text, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = shingle_set(text, size)
                for m in block:
                    y = shingle_set(m["text"], size)
                    if num * max(len(x), len(y)) <= den * min(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if den * both >= num * (len(x) + len(y) - both):
                            a.append(m["set_id"])
                            b.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    others = members.where("set_id <> first").withColumn("block", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("members") / BLOCK)))
    blocks = others.join(texts, "set_id").groupBy("first", "block").agg(F.collect_list(F.struct("set_id", "text")).alias("block_sets"))
    rows = blocks.join(texts.select(F.col("set_id").alias("first"), "text"), "first").select("first", "text", "block_sets")
    return written(map_arrow(rows, run, "a long, b long", batch_rows=8), "star-links")


def block_links(x: list[dict], y: list[dict], size: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links between two blocks of sets (set_id, comp, text) that join their components; between a block and itself too."""
    sets = {m["set_id"]: shingle_set(m["text"], size) for m in [*x, *y]}

    def union(block):
        return np.unique(np.concatenate([sets[m["set_id"]] for m in block]))

    both = np.intersect1d(union(x), union(y), assume_unique=True)

    def passing(block):
        """Members whose overlap with the other block's union is enough, and the columns of what they share with it."""
        out = []
        for m in block:
            tokens = sets[m["set_id"]]
            at = np.searchsorted(both, tokens)
            at = at[(at < len(both)) & (both[np.minimum(at, max(0, len(both) - 1))] == tokens)] if len(both) else at[:0]
            if len(at) >= _least(len(tokens), num, den):
                out.append((m, len(tokens), at))
        return out

    left, right = passing(x), passing(y)
    if not left or not right:
        return []
    common = np.zeros((len(left), len(right)))
    for low in range(0, len(both), 8192):
        dense = []
        for side in (left, right):
            part = np.zeros((len(side), min(8192, len(both) - low)), np.float32)
            for i, (_, _, at) in enumerate(side):
                part[i, at[(at >= low) & (at < low + 8192)] - low] = 1
            dense.append(part)
        common += dense[0] @ dense[1].T
    n, m = np.array([k for _, k, _ in left]), np.array([k for _, k, _ in right])
    linked = den * common >= num * (n[:, None] + m[None, :] - common)
    parent: dict[int, int] = {}

    def root(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    found = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = left[i][0], right[j][0]
        if (ra := root(a["comp"])) != (rb := root(b["comp"])):
            parent[max(ra, rb)] = min(ra, rb)
            found.append((a["set_id"], b["set_id"]))
    return found


def _open_blocks(candidates: DataFrame, members: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of different components, a block of sets against another."""
    comps = members.groupBy("grp", "comp").agg(F.count("*").alias("size"))
    whole = comps.groupBy("grp").agg(F.count("*").alias("comps"), F.sum(F.when(F.col("size") < BLOCK // 2, F.col("size")).otherwise(0)).alias("rest"))
    sized = members.join(comps, ["grp", "comp"]).join(whole, "grp")
    pure = (F.col("comps") == 1) | (F.col("size") >= BLOCK // 2)
    of = F.when(pure, F.col("comp"))
    salt = F.pmod(F.xxhash64("set_id"), F.ceil(F.when(pure, F.col("size")).otherwise(F.col("rest")) / BLOCK))
    placed = written(sized.select("set_id", "grp", "comp", of.alias("only"), F.concat_ws(":", "grp", F.coalesce(of.cast("string"), F.lit("mixed")), salt).alias("block")), "blocks")
    blocks = placed.select("grp", "block", "only").distinct()
    asking = candidates.join(placed.select("set_id", F.col("block").alias("a"), F.col("only").alias("a_only")), "set_id").select("a", "a_only", "grp").distinct()
    pairs = asking.join(blocks.withColumnsRenamed({"block": "b", "only": "b_only"}), "grp").where(~F.coalesce(F.col("a_only") == F.col("b_only"), F.lit(False)))
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "block-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("block")).distinct()
    sets = placed.join(needed, "block", "left_semi").join(texts, "set_id").groupBy("block").agg(F.collect_list(F.struct("set_id", "comp", "text")).alias("sets"))
    sets = written(sets, "block-sets")

    def run(batches):
        for batch in batches:
            found = [x for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in block_links(p, q, size, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    rows = pairs.join(sets.select(F.col("block").alias("a"), F.col("sets").alias("x")), "a").join(sets.select(F.col("block").alias("b"), F.col("sets").alias("y")), "b").select("x", "y")
    return written(map_arrow(rows, run, "a long, b long", batch_rows=4), "block-links")


def set_links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between set_ids, enough of them to connect all sets that are connected."""
    hits = shared_tokens(sets)
    groups = written(similar_groups(hits, num, den), "groups")
    candidates = written(qualifying(hits, groups, num, den), "qualifying")
    opened = groups.join(candidates.select("grp").distinct(), "grp", "left_semi").select("set_id").unionByName(candidates.select("set_id")).distinct()
    opened = written(opened, "opened")
    texts = opened_texts(docs, sets, opened, id_col, text_col, size)
    inside = groups.join(opened, "set_id", "left_semi")
    firsts = inside.groupBy("grp").agg(F.min("set_id").alias("first"), F.count("*").alias("members"))
    members = written(inside.join(firsts, "grp").select("set_id", "grp", "first", "members"), "members")
    star = _star_links(members, texts, size, num, den)
    comps = members.join(star.select(F.col("a").alias("set_id"), F.col("b").alias("to")), "set_id", "left").select("set_id", "grp", F.coalesce("to", "set_id").alias("comp"))
    return star.unionByName(_open_blocks(candidates, comps, texts, size, num, den))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable by links den * intersection >= num * union)."""
    sets = token_sets(docs, id_col, text_col, size, num, den)
    roots = connected(set_links(docs, sets, id_col, text_col, size, num, den))
    rows = sets.select("doc_id", "n", "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select("doc_id", "n", F.coalesce("root", "set_id").alias("component"))
    # Written, so that both sides of the join are shuffled for it, and Spark may split a large component's rows.
    smallest = written(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest")), "smallest")
    return rows.join(smallest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component, the one with the smallest id (null only where no other is); columns as they came.

    Rows are told apart by id and text together, so rows that share an id but not
    the text are decided each by itself, and of rows that share both one stays.
    """
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("row_id"), key.alias("row_key"))
    found = near_duplicates(docs.select(key.alias("row_key"), F.col(text_col).cast("string").alias("text")), "row_key", "text", size, num, den).where("n_shingles > 0")
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = written(found.join(several, "component_id").select("component_id", F.col("doc_id").alias("row_key")).distinct(), "near-members")
    ids = written(keyed.select("row_id", "row_key").join(members, "row_key"), "near-ids")
    first = F.min(F.struct(F.col("row_id").isNull().alias("none"), "row_id", "row_key"))
    stays = ids.groupBy("component_id").agg(first.alias("first")).select("first.row_key")
    dropped = written(members.join(stays, "row_key", "left_anti").select("row_key"), "near-dropped")
    kept_rows = keyed.join(dropped, "row_key", "left_anti")
    repeated = written(ids.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").join(dropped, "row_key", "left_anti").select("row_key"), "near-repeated")
    if not repeated.isEmpty():
        kept_rows = kept_rows.join(repeated, "row_key", "left_anti").unionByName(kept_rows.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return kept_rows.select("doc.*")
