"""Language: the filters against sets, and accuracy on held-out rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD_TEXTS, SF
from tickweave.llm import langid
from tickweave.llm.langid import LEAST_OF_LARGEST, LEAST_SHARE, ORDERS, languages_of, learn, n_grams
from tickweave.llm.queries import op13_language, third

LETTERS = {"xx": "abcdefg", "yy": "efghijk", "zz": "lmnopéü", "一": "漢字かな文"}


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LETTERS))
        words = ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(3, 40))]
        rows.append((i, " ".join(words).capitalize() + rng.choice([".", "!? 12", ""]), lang))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, "s", 1, 2, "q") for i, t, x in rows], "doc_id long, text string, lang string, score string, gram int, mask int, lang_pred string")


def grams(text):
    data = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()).encode()
    data = b" " + b" ".join(data.split(b" ")) + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return [data[i : i + n] for n in ORDERS for i in range(len(data) - n + 1)]


def learned(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


def test_n_grams():
    texts = ["Ab  c1d", "", "é!", None, "x"]
    got = [Counter() for _ in texts]
    for numbers, rows in n_grams(pa.array([t or "" for t in texts])):
        for number, row in zip(numbers.tolist(), rows.tolist(), strict=True):
            n = number >> 40
            got[row][(number & ((1 << 40) - 1)).to_bytes(5, "big")[5 - n :]] += 1
    assert got == [Counter(grams(t or "")) for t in texts]


def test_against_sets(spark):
    rows = corpus(300) + [(1000, "null lang", None), (1001, None, "xx")]
    filters = learn(table(spark, rows).repartition(3), third() != 1)
    counts = {x: Counter() for x in LETTERS}
    for i, t, x in rows:
        if x is not None and t is not None and learned(i):
            counts[x].update(grams(t))
    share = {x: {g: n / c.total() for g, n in c.items()} for x, c in counts.items()}
    largest = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    contains = {x: {g for g, s in share[x].items() if s >= LEAST_SHARE and s >= LEAST_OF_LARGEST * largest[g]} for x in LETTERS}
    assert filters.languages == sorted(LETTERS)
    texts = [t for _, t, _ in rows if t is not None][:80]
    found, total = filters.hits(pa.array(texts))
    for k, t in enumerate(texts):
        own = grams(t)
        assert total[k] == len(own)
        for j, x in enumerate(filters.languages):
            exact = sum(g in contains[x] for g in own)
            # a filter never misses; what it adds by chance is what the correction takes off
            assert exact <= found[k, j] <= exact + max(6, 3 * filters.chance[j] * len(own))
    best, scores = filters.decide(pa.array(texts))
    exact = np.array([[sum(g in contains[x] for g in grams(t)) for x in filters.languages] for t in texts])
    assert (best == exact.argmax(axis=1)).mean() > 0.98 and ((scores >= 0) & (scores <= 1)).all()


def test_false_positives_are_corrected(spark, monkeypatch):
    # so few slots that the filters answer yes by chance most of the time
    monkeypatch.setattr(langid, "BLOCK", 256)
    monkeypatch.setattr(langid, "SLOTS", 0.4)
    rows = corpus(400, seed=2)
    filters = learn(table(spark, rows))
    assert filters.chance.max() > 0.3
    best, _ = filters.decide(pa.array([t for _, t, _ in rows]))
    assert np.mean([filters.languages[b] == x for b, (_, _, x) in zip(best, rows, strict=True)]) > 0.95


@pytest.mark.parametrize("n", [3, 70])
def test_many_languages(spark, n):
    # more than one word of bits
    rows = [(100 * k + i, f"{chr(0x4E00 + 40 * k + i)}{chr(0x4E00 + 40 * k + 2 * i)} " * 5, f"l{k:02d}") for k in range(n) for i in range(4)]
    got = {r.doc_id: r.lang_pred for r in languages_of(table(spark, rows)).collect()}
    assert got == {i: x for i, _, x in rows}


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(200, seed=4)
    scores = lambda rows: {r.doc_id: (r.lang_pred, r.score) for r in languages_of(table(spark, rows), third() != 1).collect()}
    assert scores(rows) == scores([(i, t, x if learned(i) else "other") for i, t, x in rows])


def test_odd_rows(spark):
    rows = corpus(100) + [(500 + i, t, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "abc abc", "xx"), (3, "abc", "xx"), (3, "abc", "xx"), (600, "ẞΩ" * 9, None)]
    got = languages_of(table(spark, rows).repartition(2), third() != 1)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    said = {r.doc_id: r.lang_pred for r in got}
    for i, t in enumerate(ODD_TEXTS):
        assert (said[500 + i] == "und") == (not any(c.isalpha() for c in t or "")), t
    # a text that no language contains gets a learned one
    assert said[600] in LETTERS
    empty = table(spark, rows).limit(0)
    assert languages_of(empty).count() == 0
    assert {r.lang_pred for r in languages_of(table(spark, [(1, "abc", None), (2, None, "xx")])).collect()} == {"und"}


def test_long_text_is_cut(monkeypatch):
    text = "abc de " * 400
    whole = Counter(int(x) for n, _ in n_grams(pa.array([text])) for x in n)
    monkeypatch.setattr(langid, "TOGETHER", 128)
    cut = Counter(int(x) for n, _ in n_grams(pa.array([text])) for x in n)
    # but for n-grams over a cut
    assert not cut - whole and (whole - cut).total() < 0.05 * whole.total()


def test_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    rows = op13_language(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r.held_out == (not learned(r.doc_id)) for r in rows)
    judged = [r for r in rows if r.held_out and r.text and any(c.isalpha() for c in r.text)]
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.97 * len(judged)
