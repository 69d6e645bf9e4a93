import hashlib

import numpy as np

from tests.llm.data import edge_docs, empty_docs
from trekframe.llm import decontaminate
from trekframe.llm.common import table
from trekframe.llm.terms import terms


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = terms(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    rows = []
    for doc, text in docs:
        words, hit, who = terms(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    who |= found
        who = sorted(who)
        rows.append((doc, len(words), len(hit), len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), bool(hit), who))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def test_given_tables(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = found(decontaminate.contamination(docs, items))
    assert got == plain(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert any(r[5] for r in got) and not all(r[5] for r in got)


def test_few_words_short_items_and_overlaps(spark):
    """A tiny vocabulary: windows overlap, repeat, stand at either end, and shorter items stand inside longer ones."""
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(rng.choice(["a", "b", "c"], n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 9, 10, 11, 14, 30])] + [(4, "b b b"), (None, "c c c c"), (99, ""), (98, None)]
    docs = [(i, text(int(n))) for i, n in enumerate(rng.integers(0, 60, 120))] + [(5, items[7][1]), (5, f"x {items[8][1]} y")]
    for window in (10, 4):
        got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), window=window)
        assert found(got) == plain(docs, items, window)


def test_rare_shingles_decide_and_absent_ones_prune(spark):
    items = spark.createDataFrame([(1, "the of and to in zebra is it on at the of")], "item_id long, text string")
    docs = spark.createDataFrame([(i, "the of and to in is it on at") for i in range(50)] + [(90, "so the of and to in zebra is it on at end")], "doc_id long, text string")
    windows = decontaminate.item_windows(items, "item_id", "text", 10, 3)
    counts = decontaminate.shingle_counts(docs, windows, "text", [3])
    prefix = decontaminate.prefixes(windows, counts).collect()
    assert len(windows.collect()) == 3 and len(prefix) == 1  # two windows have a shingle that no document has
    by_token = {r.token: r.n for r in counts.collect()}
    assert by_token[prefix[0].token] == 1
    assert [(r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, items).where("contaminated").collect()] == [(90, 10)]


def test_clean_documents(spark):
    leak = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, leak, "x"), (1, "clean text", "y"), (None, f"{leak} {'more ' * 30}", "z"), (3, None, None)], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame([(7, leak)], "item_id long, text string")
    assert sorted(r.n_hit or "" for r in decontaminate.clean_documents(docs, items).collect()) == ["", "y"]
    assert sorted(r.n_hit or "" for r in decontaminate.clean_documents(docs, items, most=0.5).collect()) == ["", "y", "z"]
    assert decontaminate.clean_documents(docs, items).columns == docs.columns


def test_odd_and_no_rows(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "Hello World"), (2, "word1 and thing7 word2 and thing14 word3 and thing21 word4"), (3, "é")], "item_id long, text string")
    assert found(decontaminate.contamination(docs, items)) == plain(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert found(decontaminate.contamination(empty_docs(spark), items)) == []
    assert not any(r.contaminated or r.n_items for r in decontaminate.contamination(docs, items.limit(0)).collect())
