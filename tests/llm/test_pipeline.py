import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_exact_dedup import low
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_mixing import brute_targets
from trekframe.llm import mixing as M
from trekframe.llm import quality_rules as Q
from trekframe.llm.byte_bpe import read_ranks
from trekframe.llm.common import table


def test_stages_against_brute_force(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    left = {r.doc_id for r in Q.quality_report(docs).where("kept").collect()}
    owner = {}
    for i in sorted(left):
        owner[low(rows[i].text)] = i
    left = sorted(owner.values())
    left = sorted(int(i) for i, _, c in near_brute([(i, rows[i].text) for i in left], 5, 80, 100) if i == c)
    sizes, by = defaultdict(int), defaultdict(list)
    keyed = docs.select("doc_id", M.sample_key(F.col("doc_id"), M.quality_weight(F.col("text"))).alias("key")).collect()
    key = {r.doc_id: r.key for r in keyed}
    words = {i: len(rows[i].text.split()) for i in left}
    for i in left:
        sizes[rows[i].source] += words[i]
        by[rows[i].source].append(i)
    copies = Counter()
    for s, goal in brute_targets(sizes).items():
        epochs = int(goal // sizes[s])
        budget = round(goal) - epochs * sizes[s]
        for i in sorted(by[s], key=lambda i: (key[i], i)):
            copies[i] += epochs + (2 * budget >= words[i] and budget > 0)
            budget -= min(budget, words[i])
    truth = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = C.run(spark, sf).collect()
    assert Counter(g.doc_id for g in got) == Counter({i: n for i, n in copies.items() if n})
    for g in got:
        assert list(g.ids) == truth.encode_ordinary(rows[g.doc_id].text) and g.n_tokens == len(g.ids)
        assert g.decoded_sha256 == hashlib.sha256(rows[g.doc_id].text.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    import corpus_pipeline as C

    docs = table(spark, sf_dir, "documents").limit(60)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_stands_nulls_repeats_and_clashing_columns(spark, tmp_path):
    import os

    import corpus_pipeline as C
    from tests.llm.data import edge_docs, empty_docs

    for name, docs in (("edges", edge_docs(spark)), ("none", empty_docs(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = C.run(spark, f"{tmp_path}/{name}").collect()
        passed = {r.doc_id for r in Q.quality_report(docs).where("kept").collect()}
        assert {g.doc_id for g in got} <= passed
        assert len({g.ids_sha256 for g in got}) == len({g.decoded_sha256 for g in got})
        assert name == "edges" or not got
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    left = [x for x in os.listdir(folder) if x.startswith(("quality-rows", "blocks", "links-small"))]
    before = set(left)
    C.run(spark, f"{tmp_path}/edges")
    assert {x for x in os.listdir(folder) if x.startswith(("quality-rows", "blocks", "links-small"))} == before  # a run leaves its result alone
