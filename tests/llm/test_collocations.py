"""Collocations against plain counting of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import ODD_TEXTS
from tickweave.llm import collocations as module
from tickweave.llm.collocations import collocations, lead_windows, phrase_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return f, n


def plain(rows, longest=3, least=10, most=2000):
    f, n = plain_counts(rows, longest)
    out = []
    for lang in f:
        found = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            score, _, left, right = min((1000000 * a * a // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 50 * a for b in longer):
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, 5, "w", 1, "p") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, w0 string, f int, phrase string")


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["ab", "Ba", "c", "dé", "É", "漢", "x-y", "ab", "ab"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ", " "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows


@pytest.mark.parametrize(("longest", "least"), [(3, 4), (2, 3), (5, 3)])
def test_against_counting(spark, monkeypatch, longest, least):
    # several segments and parts
    monkeypatch.setattr(module, "TOGETHER", 400)
    monkeypatch.setattr(module, "PART_BYTES", 1000)
    rows = made(longest) + [("en", t) for t in ODD_TEXTS] + [(None, None), ("fr", "")]
    got = collocations(table(spark, rows).repartition(4), longest, least, 50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest, least, 50)


def test_counts_of_all_lengths(spark):
    rows = made(9)
    f, n = plain_counts(rows, 3)
    got = {(r.lang, r.phrase): r.f for r in phrase_counts(table(spark, rows), 3, 2).collect()}
    want = {(x, " ".join(p)): c for x in f for p, c in f[x].items() if c >= 2} | {(x, ""): c for x, c in n.items()}
    assert got == want


def test_large_counts_are_exact(spark, monkeypatch):
    # a count whose square times a million passes 64 bits
    big = 5_000_000_000
    rows = [("en", m, p, c) for m, p, c in [(0, "", 9 * big), (1, "a", big), (1, "b", big + 1), (2, "a b", big - 7)]]
    monkeypatch.setattr(module, "phrase_counts", lambda *a: spark.createDataFrame(rows, "lang string, m int, phrase string, f long"))
    got = collocations(spark.range(0)).first()
    assert got.score == 1000000 * (big - 7) ** 2 // (big * (big + 1)) and (got.a, got.l, got.r) == (big - 7, big, big + 1)


def test_windows_end_with_their_piece():
    windows = lead_windows(np.array([1, 2, 3, 4]), np.array([False, True, False, True]), 3, 9)
    assert [w.tolist() for w in windows] == [[1, 2, 3, 4], [2, 9, 4, 9], [9, 9, 9, 9]]
    assert [w.tolist() for w in lead_windows(np.array([5]), np.array([True]), 3, 9)] == [[5], [9], [9]]


def test_empty(spark):
    assert collocations(table(spark, [("en", "a")]).limit(0)).count() == 0
    assert collocations(table(spark, [("en", None), (None, " ")])).count() == 0


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(module, "TOGETHER", 1 << 12)
    rows = [("en", "ab cd " * 20_000), ("en", ("ef " * 50 + ". ") * 500), ("en", "g" * 50_000 + " h")]
    assert sorted(tuple(r) for r in collocations(table(spark, rows)).collect()) == plain(rows)
