import gc
import re
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.data import edge_docs, empty_docs
from trekframe.llm import collocations
from trekframe.llm.common import table


def plain(rows, support, longest=5, top=2000):
    """Every phrase counted by going through the pieces; whole-number arithmetic throughout."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if len(p) > 1 and n >= support}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rated = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and n >= a and inside(p, q) for q, n in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def rows_of(df):
    return [(r.lang, r.text) for r in df.collect()]


def test_given_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for support in (5, 20):
        got = found(collocations.collocations(docs, support=support))
        assert got == plain(rows_of(docs), support)
        assert {len(r[2].split()) for r in got} >= {2, 3}


def test_overlaps_pieces_and_shards(spark, monkeypatch):
    """Few words, so phrases overlap themselves and fill blocks; shards of a few words, so phrases are summed over many."""
    rng = np.random.default_rng(3)
    text = lambda: "".join(rng.choice(["a ", "b ", "A ", "c\t", "é ", ". ", "\n", "a-b ", "\x1c "], 40))
    rows = [(["en", None, "und"][i % 3], text()) for i in range(200)] + [("en", "a " * 300), ("en", None), ("fr", "")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for shard in (50, 1 << 21):
        monkeypatch.setattr(collocations, "SHARD", shard)
        assert found(collocations.collocations(docs, support=30, top=40)) == plain(rows, 30, top=40)


def test_bitmaps_shift_and_and():
    ids = np.array([1, 2, 1, 2, 0, 1, 2, 3] * 9, np.int32)
    words = collocations.bitmaps(ids, np.array([False, True, True, False]))
    assert sum(int(np.bitwise_count(m)) for m in words[2]) == (np.isin(ids, [1, 2])).sum()
    block, phrase, word, mask = collocations.extended(words, words, len(ids) // 16 + 1)
    got = Counter()
    for p, w, m in zip(phrase.tolist(), word.tolist(), mask.tolist()):
        got[p, w] += m.bit_count()
    assert got == Counter((a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist()) if a in (1, 2) and b in (1, 2))


def test_counts_beyond_64_bits(spark):
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big * 3, big + 1, big + 7)], "a long, n long, l long, r long")
    assert row.select(collocations.exact_score().alias("s")).first().s == 1000 * big * big * 3 // ((big + 1) * (big + 7))


def test_odd_and_no_rows(spark):
    docs = edge_docs(spark)
    assert found(collocations.collocations(docs, support=2)) == plain(rows_of(docs), 2)
    assert found(collocations.collocations(empty_docs(spark))) == []


def test_cells_never_lose_a_frequent_pair(spark, monkeypatch):
    """Counts in cells, summed over shards and cut at the support, let every frequent pair through, also where a count is larger than a byte."""
    rng = np.random.default_rng(8)
    rows = [("en", " ".join(rng.choice([f"w{i}" for i in range(60)], 80, p=np.r_[[0.3], np.full(59, 0.7 / 59)]))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    monkeypatch.setattr(collocations, "SHARD", 900)
    for least_bits, support in ((6, 20), (16, 20), (16, 400)):
        monkeypatch.setattr(collocations, "LEAST_BITS", max(least_bits, collocations.SLICE))
        assert found(collocations.collocations(docs, support=support)) == plain(rows, support)


def test_shards_are_freed_at_once(monkeypatch):
    """Nothing that a shard made refers to itself, so a worker holds one shard at a time, whenever Python looks for circles."""
    monkeypatch.setattr(collocations, "SHARD", 300)
    every = np.full(1 << 10, ~np.uint64(0))
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(["a b c a b c d e " * 5] * 40)], names=["lang", "text"])
    passes = [collocations.shard_words, lambda s: collocations.shard_cells(s, every, 16, 100), *(lambda s, k=k: collocations.shard_phrases(s, every, every, k) for k in (2, 5))]
    shards = []

    def watched(fn):
        def run(shard):
            assert not any(ref() for ref in shards)
            shards.append(weakref.ref(shard))
            yield from fn(shard)

        return run

    for _ in range(2):  # what the first round imports may refer to itself
        gc.collect()
        gc.disable()
        try:
            rows = [sum(b.num_rows for b in collocations._shards([batch], watched(fn))) for fn in passes]
            left = gc.collect()
        finally:
            gc.enable()
    assert min(rows) > 0 and len(shards) >= 40 and left == 0
