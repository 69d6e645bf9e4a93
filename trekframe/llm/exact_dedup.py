"""Exact duplicates by Patricia tries.

Texts are equal when their UTF-8 bytes agree after lower-casing A-Z. Every
map task inserts the whole byte strings it reads into a compressed radix trie
(so a group of copies leaves a task as one row, however large it is), the
distinct strings are dealt out by length and content hash, and a trie for each
such partition merges them. A terminal node stores the identifier that owns
the text and the number of its copies. When a trie outgrows its budget, its
heaviest subtree moves to a file of the task, and is merged on its own later.

Where every member is wanted, members find their owner by joining on the content
hash (SHA-256): one row a distinct text on one side, so the join never
multiplies rows, and Spark may split a hot key. Where only owners stay, their
rows travel with the strings and nothing is joined.

Defined cases: null text counts as empty; a null identifier is smaller than
any other (and owns a text only if no copy has one); rows that repeat both
identifier and text count as copies, and ``exact_dedup`` leaves one of them;
an empty table gives an empty result; other columns, whatever their names,
are neither read nor changed.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trekframe.llm.common import fresh, map_arrow

#: Bytes of strings that a task's trie holds before a subtree is spilled.
TRIE_BYTES = 96 << 20
#: What a node costs besides its edge.
NODE_BYTES = 250


class _Node:
    __slots__ = ("edge", "kids", "n", "owner", "row", "spilled")

    def __init__(self, edge: bytes, owner: int | None = None, n: int = 0, row: tuple | None = None):
        self.edge, self.owner, self.n, self.row = edge, owner, n, row
        self.kids: dict[int, _Node] | None = None
        self.spilled = None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the longest prefix of a that b has from position at."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def _row_bytes(row: tuple | None) -> int:
    """About what a row costs in memory: its strings, and some for the rest."""
    return 200 + sum(len(x) for x in row if isinstance(x, str | bytes)) if row else 0


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal keeps the winning identifier, with its row where rows are given, and a count."""

    def __init__(self, budget: int = TRIE_BYTES, keep: str = "max"):
        self.root, self.budget, self.used = _Node(b""), budget, 0
        self.wins = max if keep == "max" else min

    def insert(self, key: bytes, owner: int | None, n: int = 1, row: tuple | None = None) -> None:
        node, at = self.root, 0
        while True:
            if node.spilled is not None:
                self._append(node.spilled, key[at:], owner, n, row)
                return
            if at == len(key):
                break
            kid = node.kids.get(key[at]) if node.kids else None
            if kid is None:
                leaf = _Node(key[at:], owner, n, row)
                node.kids = node.kids or {}
                node.kids[key[at]] = leaf
                self._grew(len(leaf.edge) + NODE_BYTES + _row_bytes(row))
                return
            if key.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            cut = _shared(kid.edge, key, at)
            fork = _Node(kid.edge[:cut])
            node.kids[key[at]] = fork
            kid.edge = kid.edge[cut:]
            fork.kids = {kid.edge[0]: kid}
            self.used += NODE_BYTES
            node, at = fork, at + cut
        grown = 0
        if not node.n or owner is not None and (node.owner is None or self.wins(node.owner, owner) != node.owner):
            grown = _row_bytes(row) - _row_bytes(node.row)
            node.owner, node.row = owner, row
        node.n += n
        self._grew(grown)

    def _grew(self, by: int) -> None:
        self.used += by
        if self.used > self.budget:
            self._spill()

    def _spill(self) -> None:
        """Moves the heaviest subtree to a file, descending while one child holds nearly all."""
        node = self.root
        while node.kids:
            weights = {k: self._weight(v) for k, v in node.kids.items() if v.spilled is None}
            if not weights:
                return
            heaviest = max(weights, key=weights.get)
            node = node.kids[heaviest]
            if weights[heaviest] < 0.9 * self.used or not node.kids:
                break
        if node is self.root:
            return
        out = tempfile.TemporaryFile()
        for key, owner, n, row in self._terminals(node, b"", skip_edge=True):
            self._append(out, key, owner, n, row)
        self.used -= self._weight(node) - len(node.edge)
        node.kids, node.owner, node.n, node.row, node.spilled = None, None, 0, None, out

    @staticmethod
    def _append(out, key: bytes, owner: int | None, n: int, row: tuple | None) -> None:
        pickle.dump((key, owner, n, row), out, pickle.HIGHEST_PROTOCOL)

    @staticmethod
    def _weight(node: _Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.edge) + NODE_BYTES + _row_bytes(x.row)
            todo.extend(x.kids.values() if x.kids else ())
        return total

    def _terminals(self, node: _Node, path: bytes, skip_edge: bool = False) -> Iterator[tuple[bytes, int | None, int, tuple | None]]:
        todo = [(node, path if skip_edge else path + node.edge)]
        while todo:
            x, path = todo.pop()
            if x.n:
                yield path, x.owner, x.n, x.row
            if x.spilled is not None:
                part = PatriciaTrie(self.budget, "max" if self.wins is max else "min")
                x.spilled.seek(0)
                while True:
                    try:
                        part.insert(*pickle.load(x.spilled))
                    except EOFError:
                        break
                x.spilled.close()
                for key, *rest in part.drain_rows():
                    yield path + key, *rest
            for kid in x.kids.values() if x.kids else ():
                todo.append((kid, path + kid.edge))

    def drain(self) -> Iterator[tuple[bytes, int | None, int]]:
        """All (string, owner, copies); the trie can't be used afterwards."""
        for key, owner, n, _ in self.drain_rows():
            yield key, owner, n

    def drain_rows(self) -> Iterator[tuple[bytes, int | None, int, tuple | None]]:
        """The same with each owner's row."""
        yield from self._terminals(self.root, b"")


def _normalised(texts: pa.Array) -> pa.Array:
    """Bytes compared: A-Z in lower case, null as empty."""
    return pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())


def _batches(rows: Iterator[tuple], schema: pa.Schema, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, bytes | str))
        if size > most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_DISTINCT = "n_bytes long, hash binary, bytes binary, owner long, n long"
_DISTINCT_ARROW = pa.schema([("n_bytes", pa.int64()), ("hash", pa.binary()), ("bytes", pa.large_binary()), ("owner", pa.int64()), ("n", pa.int64())])
_GROUP_ARROW = pa.schema([("hash", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])


def trie_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", budget: int = TRIE_BYTES) -> DataFrame:
    """One row a distinct text: hash binary (SHA-256 of the compared bytes), owner long, n long (its copies)."""

    def combine(batches):
        trie = PatriciaTrie(budget, keep)
        for batch in batches:
            for owner, key in zip(batch.column(0).to_pylist(), _normalised(batch.column(1)).to_pylist()):
                trie.insert(key, owner)
        rows = ((len(key), hashlib.sha256(key).digest(), key, owner, n) for key, owner, n in trie.drain())
        yield from _batches(rows, _DISTINCT_ARROW)

    def merge(batches):
        trie = PatriciaTrie(budget, keep)
        for batch in batches:
            for key, owner, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                trie.insert(key, owner, n)
        yield from _batches(((hashlib.sha256(key).digest(), owner, n) for key, owner, n in trie.drain()), _GROUP_ARROW)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    distinct = map_arrow(rows, combine, _DISTINCT).repartition("n_bytes", "hash")
    return map_arrow(distinct, merge, "hash binary, owner long, n long")


def _with_hash(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with one more column: SHA-256 of the compared bytes."""
    at = docs.columns.index(text_col)

    def add(batches):
        for batch in batches:
            keys = pa.array([hashlib.sha256(x).digest() for x in _normalised(batch.column(at)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return map_arrow(docs, add, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row a document: its id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    members = _with_hash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", "hash").select("doc_id", "hash")
    groups = trie_owners(docs, id_col, text_col, keep)
    return members.join(groups, "hash").select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"),
        F.lower(F.hex("hash")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", budget: int = TRIE_BYTES) -> DataFrame:
    """docs without the copies, columns as they came: of equal texts the row with the largest (or smallest) id stays.

    The owner's row travels with its string, which its own text gives back, so
    each distinct text of a map task is shuffled once and nothing is joined.
    """
    width = len(docs.columns)
    rows = docs.withColumns({fresh(docs, "owner_id"): F.col(id_col).cast("long"), fresh(docs, "owned_text"): F.col(text_col).cast("string")})
    n_bytes, hash_ = fresh(docs, "n_bytes"), fresh(docs, "content_hash")
    dealt_type = T.StructType([T.StructField(n_bytes, T.LongType()), T.StructField(hash_, T.BinaryType()), *docs.schema.fields, T.StructField(rows.columns[-2], T.LongType())])
    at = docs.columns.index(text_col)
    schemas: dict = {}

    def inserted(trie, batch, first: int, texts: pa.Array, owners: pa.Array) -> None:
        columns = [c.to_pylist() for c in batch.columns[first : first + width]]
        for key, owner, row in zip(_normalised(texts).to_pylist(), owners.to_pylist(), zip(*columns)):
            trie.insert(key, owner, 1, row)

    def combine(batches):
        trie = PatriciaTrie(budget, keep)
        for batch in batches:
            inserted(trie, batch, 0, batch.column(width + 1), batch.column(width))
            schemas["rows"] = list(batch.schema)[: width + 1]
        if "rows" in schemas:
            schema = pa.schema([(n_bytes, pa.int64()), (hash_, pa.binary()), *schemas["rows"]])
            yield from _batches(((len(key), hashlib.sha256(key).digest(), *row, owner) for key, owner, _, row in trie.drain_rows()), schema)

    def merge(batches):
        trie, schema = PatriciaTrie(budget, keep), None
        for batch in batches:
            inserted(trie, batch, 2, batch.column(2 + at).cast(pa.string()), batch.column(2 + width))
            schema = pa.schema(list(batch.schema)[2 : 2 + width])
        if schema:
            yield from _batches((row for *_, row in trie.drain_rows()), schema)

    dealt = map_arrow(rows, combine, dealt_type).repartition(n_bytes, hash_)
    return map_arrow(dealt, merge, docs.schema)
