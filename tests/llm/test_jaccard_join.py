import random
import re
from itertools import combinations

import pytest

from trekframe.llm import jaccard_join as J
from trekframe.llm.common import table
from trekframe.llm.components import connected
from tests.llm.data import edge_docs, empty_docs


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for token in s:
            where.setdefault(token, []).append(i)
    seen = set()
    for ids in where.values():
        for a, b in combinations(ids, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(b)] = root(a)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    smallest = {k: min([x for x in v if x is not None], default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(smallest[root(i)])) for i in range(len(rows)))


def check(docs, size=4, num=85, den=100):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = J.near_duplicates(docs, size=size, num=num, den=den).collect()
    assert sorted((str(g.doc_id), g.n_shingles, str(g.component_id)) for g in got) == brute(rows, size, num, den)
    return got


def family(rng, n, words, edits, start):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append((start + i, " ".join(copy)))
    return out


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80)])
def test_documents(spark, sf_dir, size, num):
    got = check(table(spark, "/root/testdata/sf0.01", "documents"), size, num)
    assert any(g.component_id != g.doc_id for g in got)


def test_families_passages_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = family(rng, 60, 120, 6, 0) + family(rng, 40, 60, 3, 100) + family(rng, 5, 12, 1, 200) + family(rng, 30, 300, 20, 300)
    rows += [(400 + i, passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.choice((3, 8, 60))))) for i in range(60)]
    rows += [(500 + i, "same words in every row here " * 3) for i in range(50)] + [(600 + i, f"tiny {i % 3}") for i in range(9)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(docs)
    check(docs, 5, 80)


def test_edges(spark):
    check(edge_docs(spark))
    assert J.near_duplicates(empty_docs(spark)).count() == 0
    docs = edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    kept = J.keep_one(docs)
    comps = {r.component_id for r in J.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(comps)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 103: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_are_decided_by_their_texts(spark):
    """Null and repeated ids: of each group of near copies one row stays, unrelated texts stay."""
    words = lambda tag: [f"{tag}{i}" for i in range(60)]
    near = lambda tag, k: " ".join(w if i != k else "changed" for i, w in enumerate(words(tag)))
    a, b = " ".join(words("a")), " ".join(words("b"))
    docs = spark.createDataFrame([(1, a), (2, b), (2, near("a", 0)), (None, near("b", 0)), (None, near("a", 59)), (None, near("b", 59)), (7, "alone"), (None, None), (8, ""), (8, "")], "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, a), (2, b), (7, "alone"), (None, None), (8, ""), (8, "")], key=str)
    same = spark.createDataFrame([(3, a), (3, a), (3, a), (4, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in J.keep_one(same).collect()) == [(3, a), (4, b)]
