import math
import re
from collections import Counter

import numpy as np
import pytest
from tests.llm.data import edge_docs, empty_docs

from trekframe.llm import ranked_search
from trekframe.llm.common import table
from trekframe.llm.terms import TERM, terms

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items, k=10):
    """Every document's score for every item, by the formula."""
    found = [(i, Counter(PATTERN.findall(lowered(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    rows = []
    for item, text in items:
        scored = []
        for doc, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(PATTERN.findall(lowered(text))) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms_are_the_patterns_matches():
    for text in ("", None, "A-b_C9 x", "Ünï ÇODE x y", "\x00a\x7fb", "日本 語1"):
        assert [t.decode() for t in terms(text)] == PATTERN.findall(lowered(text))
    assert TERM.replace("\\", "") == PATTERN.pattern.replace("\\", "")


def test_given_tables_against_every_score(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = found(ranked_search.ranked_search(docs, items))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("size, first", [(16, 1), (64, 2)])
def test_many_small_ranges_with_ties(spark, monkeypatch, size, first):
    """Ranges that end early, so that floors prune; copies, so that equal scores are cut by id."""
    rng = np.random.default_rng(size)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(300)]
    docs = [(int(i), texts[int(rng.integers(0, 300))]) for i in rng.permutation(900)]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(300)]
    monkeypatch.setattr(ranked_search, "RANGE_WORDS", size * 4)
    monkeypatch.setattr(ranked_search, "FIRST", first)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(ranked_search.ranked_search(frame, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_packed_trees_come_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 5, 9000) ** 3 * ranked_search.RANGE + rng.integers(0, ranked_search.RANGE, 9000))
    owner, docs = np.unique(keys // ranked_search.RANGE, return_inverse=True)[1], keys % ranked_search.RANGE
    owner, docs = np.r_[owner, 5, 6], np.r_[docs, 7, 9]
    impacts = rng.integers(1, 1000, len(docs))
    trees, n, top = ranked_search.packed_trees(owner, docs, impacts, 7)
    flat = ranked_search.unpacked_trees(trees)
    assert flat["docs"].tolist() == (owner * ranked_search.RANGE + docs).tolist() and flat["docs_max"].tolist() == impacts.tolist()
    for level, per_row, width in (("low", 256, 16), ("high", 16, 256)):
        want = {}
        for o, d, v in zip(owner.tolist(), docs.tolist(), impacts.tolist()):
            want[o * per_row + d // width] = max(v, want.get(o * per_row + d // width, 0))
        assert dict(zip(flat[level].tolist(), flat[f"{level}_max"].tolist())) == want and (np.diff(flat[level]) > 0).all()
    assert n.sum() == len(docs) and top.tolist() == [impacts[owner == o].max() for o in range(7)]


def test_odd_rows(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(1, "hello world a"), (1, "hello world a"), (None, "word1 thing7"), (3, None), (4, " .,"), (5, "nowhere")], "item_id long, text string")
    got = found(ranked_search.ranked_search(docs, items))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {r[0] for r in got} == {1, None}


def test_no_rows(spark):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(ranked_search.ranked_search(empty_docs(spark), items)) == []
    assert found(ranked_search.ranked_search(edge_docs(spark), items.limit(0))) == []
