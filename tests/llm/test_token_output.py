import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trekframe.llm import token_output as O
from trekframe.llm.common import table
from tests.llm.data import edge_docs, empty_docs

PATH = P.path("byte_bpe_50k.json")
TRUTH = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_round_trip(ids, data):
    codes = O.DirectCodes(O.dac_encode(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids and len(codes) == len(ids)
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert codes.token(i) == ids[i] and codes.slice(i, j).tolist() == ids[i:j]


@pytest.mark.parametrize("range_docs,segment", [(16, 5000), (2048, 1 << 20)])
def test_documents_and_edges(spark, sf_dir, tmp_path, range_docs, segment):
    for k, docs in enumerate((table(spark, sf_dir, "documents"), edge_docs(spark).where("doc_id is not null").dropDuplicates(["doc_id"]))):
        rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        want, at = [], 0
        for i, text in rows:
            ids = TRUTH.encode(text or "", add_special_tokens=False).ids + [0]
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        path = f"{tmp_path}/{k}"
        O.write_tokens(docs, path, PATH, P.PATTERN, range_docs=range_docs, segment=segment)
        assert sorted(map(tuple, O.token_digest(spark, path).collect())) == want
        assert sorted((r.doc_id, r.start, len(r.ids)) for r in O.read_tokens(spark, path).collect()) == [w[:3] for w in want]


def test_null_ids_repeats_and_empty(spark, tmp_path):
    docs = edge_docs(spark)
    O.write_tokens(docs, f"{tmp_path}/a", PATH, P.PATTERN, range_docs=4)
    got = sorted(O.token_digest(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert len(got) == docs.count()
    assert [r.doc_id is None for r in got] == sorted(r.doc_id is None for r in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    O.write_tokens(empty_docs(spark), f"{tmp_path}/b", PATH, P.PATTERN)
    assert O.token_digest(spark, f"{tmp_path}/b").count() == 0


def test_added_tokens_are_one_id_as_in_the_library(spark, tmp_path):
    for k, extra in enumerate(([], [{"content": "<|end", "normalized": True}, {"content": "<pad>", "lstrip": True}, {"content": "<sep>", "rstrip": True}, {"content": "word", "single_word": True}])):
        source = json.loads(Path(PATH).read_text(encoding="utf-8"))
        flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        source["added_tokens"] += [{"id": 50257 + i, **flags, **t} for i, t in enumerate(extra)]
        file = tmp_path / f"{k}.json"
        file.write_text(json.dumps(source), encoding="utf-8")
        library = Tokenizer.from_file(str(file))
        texts = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|>\n\n<|endoftext|><|endoftext|> b", "<|endoftext", "<|end of", "x \t<pad> y  <sep> \n z<sep>", "a word, words sword word", None, "plain"]
        O.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{tmp_path}/added{k}", str(file), P.PATTERN)
        got = {r.doc_id: list(r.ids) for r in O.read_tokens(spark, f"{tmp_path}/added{k}").collect()}
        assert got == {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
