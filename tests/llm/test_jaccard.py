"""The size-aware join against all pairs."""

import random
import re

import pytest

from tests.llm.helpers import ODD_TEXTS, SF, documents
from tickweave.llm import jaccard, queries
from tickweave.llm.jaccard import jaccard_components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def by_brute_force(rows):
    """Rows of (key, text) to sorted (key, n, component), through an inverted list of every shingle."""
    sets = [shingles(t) if k is not None else frozenset() for k, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in lists[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted(((k is not None, k or 0), len(shingles(t)), None if k is None else least[root(i)]) for i, (k, t) in enumerate(rows))


def result(df):
    return sorted(((r.doc_id is not None, r.doc_id or 0), r.n_shingles, r.component_id) for r in df.collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, sizes=(3, 6, 9, 12, 14, 18, 25, 60, 200)):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    texts = list(ODD_TEXTS)
    for size in sizes:
        for _ in range(3):
            base = [f"b{rng.randrange(10**6)}" for _ in range(size)]
            texts += [edited(rng, base, rng.randrange(0, 1 + size // 12)) for _ in range(8)]
            texts += [" ".join(base + common), " ".join(common + base), " ".join(base)]
            texts += [" ".join(base[: rng.randrange(1, size + 1)]) for _ in range(3)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,boundary,block", [(1, None, 512), (2, 0, 4), (3, 14, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, boundary, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    if boundary is not None:
        monkeypatch.setattr(jaccard, "_boundary", lambda *_: boundary)
    texts = corpus(seed)
    keys = [None if i % 41 == 5 else i // 2 if i % 17 == 0 else i for i in range(len(texts))]
    assert result(jaccard_components(documents(spark, texts, keys).repartition(6))) == by_brute_force(list(zip(keys, texts, strict=True)))


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    texts = [edited(rng, base, rng.randrange(0, 7)) for _ in range(300)]
    assert result(jaccard_components(documents(spark, texts).repartition(8))) == by_brute_force(list(enumerate(texts)))


def test_empty(spark):
    assert jaccard_components(documents(spark, [])).count() == 0
    assert result(jaccard_components(documents(spark, ["", None, " "]))) == [((True, i), 0, i) for i in range(3)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(queries.op10_jaccard_join(spark, SF)) == by_brute_force(rows)
