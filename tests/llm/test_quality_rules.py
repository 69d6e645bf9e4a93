import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from trekframe.llm import quality_rules as Q
from trekframe.llm.common import table
from tests.llm.data import edge_docs, empty_docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(covered)


def check(docs):
    want = {(r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()}
    got = Q.quality_report(docs).collect()
    assert len(got) == docs.count()
    assert {(g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got} == want
    for g in got:
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)
    return got


def test_features_match_brute_force(spark, sf_dir):
    check(table(spark, sf_dir, "documents"))
    check(edge_docs(spark))
    assert Q.quality_report(empty_docs(spark)).count() == 0


def test_verdict_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.quality_report(table(spark, sf, "documents")).join(table(spark, sf, "labels"), "doc_id").where(~F.col("base_failed")).collect()
    good = [g.kept for g in got if g.quality == 1]
    bad = [g.kept for g in got if g.quality == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.5 * len(bad)


def test_filter_equals_report(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = {r.doc_id for r in Q.quality_report(docs).where("kept").collect()}
    out = Q.quality_filter(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept)
    assert Q.quality_filter(edge_docs(spark)).columns == edge_docs(spark).columns


def test_sketches_merge_exactly_and_keep_their_error(spark):
    df = spark.range(1, 2001).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("g"), F.lit(0).alias("all"))
    whole = Q.sketch(df, ["all"], {"v": F.col("v")})
    parts = Q.merge_sketches(Q.sketch(df, ["g", "all"], {"v": F.col("v")}), ["all"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    q = Q.sketch_quantiles(parts, ["all"], {"a": 0.25, "b": 0.75}).first()
    assert abs(math.exp(q.a) / 500 - 1) <= 1.1 * Q.ERROR and abs(math.exp(q.b) / 1500 - 1) <= 1.1 * Q.ERROR


def test_thresholds_differ_by_language_and_source(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    rows = docs.select("lang", "source", Q.base_features(F.col("text")).alias("f"))
    limits = Q.thresholds(rows, "lang", "source", "f").collect()
    assert len(limits) == docs.select("lang", "source").distinct().count()
    for column in ("q_high_word_len", "q_low_word_len", "q_high_mark_share", "q_high_upper_share"):
        values = {r[column] for r in limits}
        assert len(values) >= 0.9 * len(limits) and None not in values, column
    report = Q.quality_report(docs).join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where(~F.col("base_failed"))
    share = {r.quality: r.share for r in report.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.98 and share[0] <= 0.05


def test_a_source_with_a_third_of_junk_loses_it(spark):
    """Junk doesn't widen the fence of the source that it fills, however large or small the source is."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))

    def prose(marks):
        words = [word() + rng.choice(marks) for _ in range(rng.randint(60, 150))]
        return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in words)

    rows = []
    for k, (source, n) in enumerate((("clean", 300), ("dirty", 300), ("small", 12), (None, 40))):
        for i in range(n):
            junk = source != "clean" and i % 3 == 0
            rows.append((1000 * k + i, prose(["$#%", "&|", "***"] if junk else ["", "", "", "", "", ",", "."]), "en", source, junk))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, junk boolean")
    got = {r.doc_id: r.kept for r in Q.quality_report(docs).collect()}
    junk = [got[i] for i, *_, j in rows if j]
    good = [got[i] for i, *_, j in rows if not j]
    assert sum(junk) == 0 and sum(good) >= 0.98 * len(good)
    assert {r.doc_id for r in Q.quality_filter(docs).collect()} == {i for i, kept in got.items() if kept}
