import re
from collections import defaultdict

from trekframe.llm import mixing as M
from trekframe.llm.common import table
from tests.llm.data import edge_docs, empty_docs


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, weight = total - sum(capped.values()), sum(w[s] for s in free)
        goal = {s: left * w[s] / weight for s in free}
        over = [s for s in free if goal[s] > 2 * sizes[s]]
        if not over:
            return capped | goal
        capped |= {s: 2.0 * sizes[s] for s in over}


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(sizes)
    got = M.mix_taken(docs).collect()
    assert len(got) == len(rows)
    by = defaultdict(int)
    source_of = defaultdict(set)
    for r in rows:
        source_of[r.doc_id].add(r.source)
    for g in got:
        assert 0 <= g.taken <= 2 * g.size
        s = min(source_of[g.doc_id], key=lambda s: abs(want[s] - g.target) + abs(sizes[s] - g.source_size))
        assert abs(want[s] - g.target) < 1e-6 * max(1, want[s]) and g.source_size == sizes[s]
        by[s] += g.taken
    for s, goal in want.items():
        assert abs(by[s] - goal) <= 3
    assert sorted(map(str, got)) == sorted(map(str, M.mix_taken(docs.repartition(5)).collect()))


def test_targets_and_taken(spark, sf_dir):
    check(table(spark, sf_dir, "documents"))
    check(edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]))
    assert M.mix_taken(edge_docs(spark)).count() == edge_docs(spark).count()
    assert M.mix_taken(empty_docs(spark)).count() == 0


def test_mix_repeats_whole_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    taken = {r.doc_id: r for r in M.mix_taken(docs).collect()}
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    copies = defaultdict(int)
    for r in out.select("doc_id").collect():
        copies[r.doc_id] += 1
    off = [i for i, t in taken.items() if t.size and copies[i] != t.taken / t.size]
    assert len(off) <= 21 and all(abs(copies[i] - taken[i].taken / taken[i].size) < 1 for i in off)


def test_keys_favour_quality(spark):
    df = spark.range(20000).selectExpr("id as doc_id")
    from pyspark.sql import functions as F

    mean = df.select(F.avg(M.sample_key(F.col("doc_id"), F.lit(1.0))), F.avg(M.sample_key(F.col("doc_id"), F.lit(0.5)))).first()
    assert abs(mean[0] - 1) < 0.05 and abs(mean[1] - 2) < 0.1


def test_buckets_are_even_whatever_the_weights(spark):
    from pyspark.sql import functions as F

    for weights in (F.lit(1.0), F.lit(0.05), F.when(F.col("id") % 3 == 0, 0.05).otherwise(1.0)):
        keys = spark.range(200_000).select(M.sample_key(F.col("id"), weights).alias("key")).withColumn("bucket", M._bucket(F.col("key")))
        assert keys.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 200_000 / 1000
        ordered = keys.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bucket").collect()
        assert all(a.high < b.low for a, b in zip(ordered, ordered[1:]))
