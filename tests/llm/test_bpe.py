"""The pair index against the library."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, SF, VOCABULARY, documents
from tickweave.llm import queries
from tickweave.llm.bpe import PairIndexCoder, bpe_decode, bpe_encode

LIBRARY, CODER = Tokenizer.from_file(VOCABULARY), PairIndexCoder(VOCABULARY)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'.,abAÉΣtheing<|endoftext|>")), max_size=60), max_size=5))
def test_encode_and_decode(texts):
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in CODER.encode(texts)]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == want
    assert [CODER.decode(np.array(x, dtype="<u4").tobytes()) for x in want] == [LIBRARY.decode(x, skip_special_tokens=False) for x in want]


def test_overlapping_pairs():
    words = [c * n for c in "aeh!0z" for n in range(1, 40)]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in CODER.words_to_ids([w.encode() for w in words])]
    for w, ids in zip(words, got, strict=True):
        if not w.isdigit():  # a digit is a word of its own
            assert ids == LIBRARY.encode(w, add_special_tokens=False).ids


def test_operator_odd_rows(spark):
    texts = [*ODD_TEXTS, "same", "same"]
    rows = bpe_decode(bpe_encode(documents(spark, texts, [*range(len(ODD_TEXTS)), None, 3]), VOCABULARY), VOCABULARY).collect()
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted((np.frombuffer(r.ids, dtype="<u4").tolist(), r.decoded) for r in rows) == sorted(
        (x, LIBRARY.decode(x, skip_special_tokens=False)) for x in want
    )
    assert bpe_encode(documents(spark, []), VOCABULARY).count() == 0


def test_query(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert got[d.doc_id] == (
            len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        )
