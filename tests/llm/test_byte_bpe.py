import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trekframe.llm.byte_bpe import ByteBPE, bpe_digest, bpe_encode, read_ranks
from trekframe.llm.common import table
from tests.llm.data import edge_docs, empty_docs

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = ByteBPE(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ids = BPE.encode(text)
    assert ids == TRUTH.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


def test_documents_and_edges(spark, sf_dir):
    for docs in (table(spark, sf_dir, "documents"), edge_docs(spark)):
        want = sorted((str(r.doc_id), TRUTH.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.select("doc_id", "text").collect())
        got = sorted((str(g.doc_id), g.n_tokens, g.ids_sha256, g.decoded_sha256) for g in bpe_digest(docs, PATH, P.PATTERN).collect())
        assert got == sorted((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b).hexdigest()) for i, ids, b in want)
    assert bpe_digest(empty_docs(spark), PATH, P.PATTERN).count() == 0
    assert sorted(str(r.ids) for r in bpe_encode(edge_docs(spark), PATH, P.PATTERN).collect()) == sorted(str(TRUTH.encode_ordinary(r.text or "")) for r in edge_docs(spark).collect())
