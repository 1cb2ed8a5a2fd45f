"""Token files and packing against the library itself."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import ODD_TEXTS, SF, VOCABULARY, crc, documents
from tickweave.llm import queries, tokens
from tickweave.llm.packing import pack
from tickweave.llm.tokenfiles import decode_ranks, encode_ranks, read_token_files, write_token_files
from tickweave.llm.tokens import Encoder

LIBRARY, ENCODER = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'.,abAÉΣ<|endoftext|>")), max_size=40), max_size=5))
def test_encoder_is_the_library(texts):
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in ENCODER.encode(texts)]
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=11), max_size=6))
def test_rank_bytes_round_trip(docs):
    counts = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    control, data, controls, sizes = encode_ranks(flat, counts)
    assert controls.sum() == len(control) and sizes.sum() == len(data)
    assert decode_ranks(control, data, counts).tolist() == flat.tolist()


def test_token_files_odd_rows(spark, library):
    texts = [*ODD_TEXTS, "same", "same"]
    keys = [*range(len(ODD_TEXTS) - 1, -1, -1), None, 3]
    docs = documents(spark, texts, keys).repartition(5)
    got = read_token_files(spark, write_token_files(docs, VOCABULARY, ids_per_file=4000)).orderBy("start").collect()
    want = sorted(((k is not None, k or 0), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for k, t in zip(keys, texts, strict=True))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_token_files_empty(spark):
    assert read_token_files(spark, write_token_files(documents(spark, []), VOCABULARY)).count() == 0


def test_pack_odd_rows(spark, library):
    texts = [*ODD_TEXTS, "same", "same"]
    keys = [*range(len(ODD_TEXTS)), None, 3]
    pieces = pack(documents(spark, texts, keys).repartition(4), VOCABULARY, window=64).collect()
    check_packing(pieces, 64)
    whole = sorted([*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts)
    runs, current = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        current += np.frombuffer(p.ids, dtype="<u4").tolist()
        if p.start + p.length == p.doc_tokens:
            runs.append(current)
            current = []
    assert sorted(runs) == whole and not current


def check_packing(pieces, window):
    by_sequence = {}
    for p in pieces:
        assert p.length > 0 and p.offset + p.length <= window
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, parts in by_sequence.items():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
        assert sum(n for _, n in parts) == window or s == len(by_sequence) - 1


def test_pack_empty(spark):
    assert pack(documents(spark, []), VOCABULARY).count() == 0


def test_queries_on_the_smallest_tables(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    ids = [library.encode(d.text or "", add_special_tokens=False).ids for d in docs]
    got = queries.op3_token_files(spark, SF).orderBy("doc_id").collect()
    starts = np.cumsum([0] + [len(x) + 1 for x in ids]).tolist()
    assert [tuple(r) for r in got] == [(d.doc_id, a, len(x) + 1, crc([*x, 2])) for d, a, x in zip(docs, starts, ids, strict=False)]
    pieces = queries.op4_packing(spark, SF).collect()
    check_packing(pieces, 2048)
    by_doc = {d.doc_id: [*x, 1] for d, x in zip(docs, ids, strict=True)}
    covered = dict.fromkeys(by_doc, 0)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == covered[p.doc_id] and p.doc_tokens == len(by_doc[p.doc_id])
        assert p.ids_crc32 == crc(by_doc[p.doc_id][p.start : p.start + p.length])
        covered[p.doc_id] += p.length
    assert covered == {k: len(v) for k, v in by_doc.items()}


def test_pieces_are_learned_once(monkeypatch):
    encoder = Encoder(VOCABULARY)
    texts = ["Heat*** heat, heat.&& été! été don't don't", "heat été, &&heat don't."]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode(texts)] == want
    # a word and the signs behind it have numbers of their own, so a word isn't learned again with other signs
    assert sorted(encoder.known.to_pylist()) == sorted(["", "heat", "***", ",", ".&&", "été", "!", "don't", "&&heat", "don't."])
    # what is forgotten is learned again
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    monkeypatch.setattr(tokens, "TOGETHER", 8)
    again = [t for t in texts for _ in range(3)]
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encoder.encode(again)] == [ids for ids in want for _ in range(3)]
    assert len(encoder.known) < 12
