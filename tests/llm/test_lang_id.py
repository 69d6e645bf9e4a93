import zlib

import numpy as np

from trekframe.llm import lang_id as L
from trekframe.llm.common import table
from tests.llm.data import edge_docs, empty_docs


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(truth)
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1
    held = [g for g in got if g.held_out and truth[g.doc_id]]
    assert sum(g.lang_pred == truth[g.doc_id] for g in held) >= 0.97 * len(held)


def test_prediction_ignores_labels(spark):
    from pyspark.sql import functions as F

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    wrong = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    same = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 12)) for r in L.identify(df).collect())
    assert same(docs) == same(wrong)


def test_edges(spark):
    docs = edge_docs(spark)
    got = L.identify(docs).collect()
    assert len(got) == docs.count()
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in docs.where("doc_id is not null").collect()}
    for g in got:
        if g.doc_id is not None:
            assert (g.lang_pred != "und") == letters[g.doc_id] and (g.score > 0) == letters[g.doc_id]
    assert L.identify(empty_docs(spark)).count() == 0


def test_slices_of_long_texts_add_up(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab c"), 500)), "", None, "x", "ab" * 300]
    matrix = rng.normal(size=(3, L.DIM + 1))
    whole = L.score_texts(texts, ["a", "b", "c"], matrix)
    monkeypatch.setattr(L, "SLICE", 64)
    cut = L.score_texts(texts, ["a", "b", "c"], matrix)
    assert [x[0] for x in whole] == [x[0] for x in cut] and np.allclose([x[2] for x in whole], [x[2] for x in cut])
    assert [x[0] for x in whole[1:3]] == ["und", "und"]


def test_equals_plain_naive_bayes(spark):
    """Counts in dictionaries, sums in Python, nothing shared with the operator but the hashed n-grams of one text."""
    import math
    from collections import Counter, defaultdict

    rows = table(spark, "/root/testdata/sf0.001", "documents").collect()
    grams = {r.doc_id: Counter(int(f) for _, hashed in L.features(np.append(L._codes(r.text or ""), [32, 32]).astype(np.uint32)) for f in hashed) for r in rows}
    counts, seen = defaultdict(Counter), Counter()
    for r in rows:
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts[r.lang] += grams[r.doc_id]
            seen[r.lang] += 1
    size = {k: sum(c.values()) for k, c in counts.items()}
    for g in L.identify(table(spark, "/root/testdata/sf0.001", "documents")).collect():
        logs = {k: math.log(seen[k] / sum(seen.values())) + sum(n * math.log((c[f] + 0.5) / (size[k] + 0.5 * L.DIM)) for f, n in grams[g.doc_id].items()) for k, c in counts.items()}
        best = min(logs, key=lambda k: (-logs[k], k))
        assert g.lang_pred == best and abs(g.score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6


def test_many_languages_in_blocks(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("ka", "lo", "mi")) + ("" if i % 3 else " 1"), f"l{i:03d}") for i in range(300)]
    docs = spark.createDataFrame(rows + [(900, "", "l001"), (901, None, None)], "doc_id long, text string, lang string")
    want = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in L.identify(docs, block=1000).collect())
    assert want == sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in L.identify(docs, block=64).collect())
    assert len(want) == 302 and all(x[3] == 0 for x in want if x[2] == "und")


def test_the_session_keeps_its_settings(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    L.identify(table(spark, "/root/testdata/sf0.001", "documents")).count()
    assert [spark.conf.get(k) for k in keys] == before
