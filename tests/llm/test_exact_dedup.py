import hashlib
import random
from collections import defaultdict

import pytest

from trekframe.llm.exact_dedup import PatriciaTrie, exact_dedup, exact_groups
from tests.llm.data import edge_docs, empty_docs


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("budget", [1, 2000, 1 << 30])
def test_trie_equals_a_dictionary_also_when_it_spills(budget):
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    trie, truth = PatriciaTrie(budget), defaultdict(list)
    for i, key in enumerate(keys):
        trie.insert(key, i)
        truth[key].append(i)
    found = list(trie.drain())
    assert len(found) == len(truth)
    assert {k: (o, n) for k, o, n in found} == {k: (max(v), len(v)) for k, v in truth.items()}


def test_groups_match_brute_force(spark):
    docs = edge_docs(spark)
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r.text)].append(r.doc_id)
    want = sorted(
        (str(r.doc_id), str(max([x for x in groups[low(r.text)] if x is not None], default=None)), len(groups[low(r.text)]), hashlib.sha256(low(r.text).encode()).hexdigest()) for r in rows
    )
    got = exact_groups(docs).collect()
    assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.text_sha256) for g in got) == want
    assert all(g.kept == (g.doc_id == g.keep_id) for g in got)


def test_dedup_keeps_columns_and_one_row_a_text(spark):
    docs = edge_docs(spark)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({low(r.text) for r in docs.collect()})
    assert exact_dedup(empty_docs(spark)).count() == 0 == exact_groups(empty_docs(spark)).count()


def test_batches_of_many_rows_are_cut_without_harm(spark):
    docs = spark.range(3000).coalesce(1).selectExpr("id as doc_id", "concat('Text NUMBER ', id % 700) as text")
    got = exact_groups(docs).collect()
    assert {(g.doc_id, g.keep_id) for g in got} == {(i, max(range(i % 700, 3000, 700))) for i in range(3000)}


@pytest.mark.parametrize("budget", [1, 3000, 1 << 30])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_the_owners_row_comes_back_whole(spark, budget, keep):
    """Rows of every kind of column, through tries that spill: the owner's, and only once."""
    from pyspark.sql import functions as F

    docs = spark.range(400).repartition(3).selectExpr(
        "if(id % 13 = 0, null, id) as doc_id", "if(id % 50 = 7, null, concat(if(id % 2 = 0, 'TEXT ', 'text '), id % 40)) as text",
        "named_struct('a', id, 'b', array(id, null)) as owner_id", "timestamp_seconds(id) as n_bytes", "cast(id as decimal(12,2)) as content_hash", "map('k', id) as m", "id as row",
    )
    groups = defaultdict(list)
    for r in docs.collect():
        groups[low(r.text)].append(r)
    got = exact_dedup(docs, keep=keep, budget=budget)
    assert got.schema == docs.schema
    rows = {low(r.text): r for r in got.collect()}
    assert len(rows) == got.select(F.count("*")).first()[0] == len(groups)
    pick = max if keep == "max" else min
    for text, members in groups.items():
        known = [r.doc_id for r in members if r.doc_id is not None]
        assert rows[text].doc_id == (pick(known) if known else None)
        assert rows[text] in members
