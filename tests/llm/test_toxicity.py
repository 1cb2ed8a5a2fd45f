"""Toxicity: the models against dictionaries, and accuracy on held-out rows."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD_TEXTS, documents
from tickweave.llm import toxicity
from tickweave.llm.queries import fold
from tickweave.llm.toxicity import (
    LEAST_WEIGHT, SHRINK_PAIRS, SHRINK_WORDS, STRONG, WINDOWS, Discounts, drop_toxic, features, fit, likelihood, logistic, shrunk, tokens,
    toxicity_scores, word_gains,
)


def corpus(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty", "rotten"]))
        texts.append(" ".join(words).capitalize() + ".")
        toxic.append(int(bad))
    return texts, toxic


def labels(spark, toxic):
    rows = [(i, t, 1, "x") for i, t in enumerate(toxic)] + [(None, 1, 1, "x"), (10**9, None, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, toxic int, quality int, text string")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    texts, toxic = corpus(1200)
    docs = documents(spark, texts).repartition(5)
    got = {r.doc_id: r for r in toxicity_scores(docs, labels(spark, toxic), may_learn=fold() != 0).collect()}
    assert len(got) == 1200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert [got[i].predicted for i in range(1200) if held_out(i)] == [t for i, t in enumerate(toxic) if held_out(i)]
    kept = drop_toxic(docs, labels(spark, toxic), may_learn=fold() != 0)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if not r.predicted)
    # labels that may not be learned from make no difference
    turned = [1 - t if held_out(i) else t for i, t in enumerate(toxic)]
    again = {r.doc_id: r.score for r in toxicity_scores(docs, labels(spark, turned), may_learn=fold() != 0).collect()}
    assert again == {i: r.score for i, r in got.items()}


def plain_discounts(counts):
    """From counts of counts, as the textbook has them, kept between 0 and their count."""
    n = [sum(c == k for c in counts) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    raw = [(k - (k + 1) * y * n[k] / n[k - 1]) if n[k - 1] else k * y for k in (1, 2, 3)]
    out = [min(max(raw[0], 0.05), 0.95)]
    for d in raw[1:]:
        out.append(min(max(d, 0.05), out[-1] + 0.95))
    return lambda c: 0.0 if not c else out[min(int(c), 3) - 1]


class Plain:
    """The models as dictionaries over all contexts of the counted rows."""

    def __init__(self, rows):
        ahead = {"t": defaultdict(set), "o": defaultdict(set)}
        for text, toxic in rows:
            w, b, _ = tokens(pa.array([text]))
            for k in range(len(w)):
                ahead["t" if toxic else "o"][int(b[k]), int(w[k])].add(int(b[k - 1]) if k else 0)
        self.pairs = {c: {p: len(s) for p, s in ahead[c].items()} for c in "to"}
        self.contexts, self.everywhere = {c: defaultdict(int) for c in "to"}, defaultdict(int)
        for p in {*self.pairs["t"], *self.pairs["o"]}:
            self.everywhere[p[1]] += 1
            for c in "to":
                self.contexts[c][p[1]] += self.pairs[c].get(p, 0) > 0
        self.cut = {c: plain_discounts(self.contexts[c].values()) for c in "to"}
        self.pair_cut = {c: plain_discounts(self.pairs[c].values()) for c in "to"}
        self.total = {c: sum(self.contexts[c].values()) for c in "to"}
        self.lost = {c: sum(map(self.cut[c], self.contexts[c].values())) for c in "to"}
        self.share = max(self.lost[c] / self.total[c] for c in "to")

    def alone(self, c, w):
        n = self.contexts[c].get(w, 0)
        return (1 - self.share) * (n - self.cut[c](n)) / (self.total[c] - self.lost[c]) + self.share * self.everywhere[w] / sum(self.everywhere.values())

    def gain(self, b, w, words, pairs):
        n = self.everywhere.get(w, 0)
        if not n:
            return 0.0
        own = math.log(self.alone("t", w) / self.alone("o", w)) * n / (n + words)
        both = self.pairs["t"].get((b, w), 0) + self.pairs["o"].get((b, w), 0)
        if both / (both + SHRINK_PAIRS[0]) < LEAST_WEIGHT:
            return own
        after = {c: {x: n for x, n in self.pairs[c].items() if x[0] == b} for c in "to"}
        lost = {c: sum(map(self.pair_cut[c], after[c].values())) for c in "to"}
        weight = sum(lost.values()) / sum(sum(after[c].values()) for c in "to")
        p = {}
        for c in "to":
            n, whole = self.pairs[c].get((b, w), 0), sum(after[c].values())
            p[c] = weight * self.alone(c, w) + (1 - weight) * (n - self.pair_cut[c](n)) / (whole - lost[c]) if whole else self.alone(c, w)
        return own + (math.log(p["t"] / p["o"]) - own) * both / (both + pairs)


def counted(spark, texts, toxic):
    chosen, stands_for = toxicity._chosen(labels(spark, toxic), "doc_id", "toxic", None)
    rows = [(r.doc_id, r.toxic, r.tuning) for r in chosen.collect()]
    return Plain([(texts[i], t) for i, t, tuning in rows if not tuning]), [(texts[i], t) for i, t, tuning in rows if tuning], stands_for


@pytest.mark.parametrize("part_bytes", [1 << 20, 2000])
def test_model_against_dictionaries(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(toxicity, "PART_BYTES", part_bytes)  # one part, and many
    texts, toxic = corpus(600, seed=5)
    texts = [t.replace("w1 ", "vile w2 ") if x and i % 3 else t for i, (t, x) in enumerate(zip(texts, toxic, strict=True))]
    scorer = fit(documents(spark, texts), labels(spark, toxic))
    plain, _, _ = counted(spark, texts, toxic)
    model = scorer.model
    w, b, _ = tokens(pa.array(texts[:40] + ["vile w2 unknown"]))
    want = [plain.gain(int(x), int(y), model.shrink_words, model.shrink_pairs) for x, y in zip(b, w, strict=True)]
    assert np.allclose(model.gains(w, b), want, atol=1e-5) and len(model.pairs.keys)


def test_query_against_dictionaries(spark):
    """Every score: features of every text, the choice of shrinking and the curve, from dictionaries."""
    texts, toxic = corpus(260, seed=8)
    got = {r.doc_id: r.score for r in toxicity_scores(documents(spark, texts), labels(spark, toxic)).collect()}
    plain, tuning, stands_for = counted(spark, texts, toxic)

    def feature(text, words, pairs):
        w, b, _ = tokens(pa.array([text]))
        g = [plain.gain(int(x), int(y), words, pairs) for x, y in zip(b, w, strict=True)]
        best = [max(sum(g[i : i + n]) / n for i in range(max(1, len(g) - n + 1))) for n in WINDOWS]
        return [*best, sum(g) / len(g), math.log1p(sum(max(x - STRONG, 0.0) for x in g))]

    y = np.array([float(t) for _, t in tuning])
    weight = np.where(y > 0, 1.0, stands_for)
    fits = []
    for words in SHRINK_WORDS:
        for pairs in SHRINK_PAIRS:
            x = np.array([feature(t, words, pairs) for t, _ in tuning])
            beta = logistic(x, y, weight)
            fits.append((likelihood(x, y, weight, beta), words, pairs, beta))
    _, words, pairs, beta = max(fits, key=lambda f: f[0])
    for i in range(0, 260, 7):
        assert abs(got[i] - 1 / (1 + math.exp(-(np.array([*feature(texts[i], words, pairs), 1.0]) @ beta)))) < 1e-3


def test_gains_of_rare_words_are_finite_and_grow():
    cuts = Discounts.estimated({"t": [50.0, 20.0, 8.0, 3.0], "o": [500.0, 300.0, 200.0, 100.0]})
    assert all(0 < d < k for c in "to" for k, d in enumerate(cuts.of[c], 1))
    t = np.arange(1.0, 12.0)
    words = {"t": t, "o": np.zeros(11), "n": t}
    gains = word_gains(words, {"t": 500.0, "o": 5000.0, "n": 5300.0, "cut_t": 120.0, "cut_o": 900.0}, cuts)
    own = shrunk(gains, t, np.zeros(11), np.zeros(11), 4.0, 64.0)
    # seen once in toxic text: a small gain, not none; more contexts, more gain
    assert np.isfinite(own).all() and own[0] > 0 and (np.diff(own) > 0).all()
    # without counts of counts to go by
    for odd in ([0.0] * 4, [5.0, 0.0, 0.0, 0.0], [0.0, 5.0, 0.0, 1.0], [1.0, 50.0, 1.0, 1.0]):
        d = Discounts.estimated({"t": odd}).of["t"]
        assert all(0 < x < k for k, x in enumerate(d, 1)) and 1 - d[0] < 2 - d[1] < 3 - d[2]


def test_features():
    gains, counts = np.array([1.0, 3.0, -1.0, 5.0, 0.0]), np.array([3, 0, 2])
    assert np.allclose(features(gains, counts), [[3.0, 2.0, 0.75, 1.0, math.log(3)], [0.0] * 5, [5.0, 2.5, 1.25, 2.5, math.log(5)]])


def test_logistic():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    beta = logistic(x, np.array([0.0, 0.0, 1.0, 1.0]), np.ones(4))
    assert beta[0] > 0 and 1 < -beta[1] / beta[0] < 2


def test_odd_rows(spark):
    texts, toxic = corpus(200)
    docs = documents(spark, [*ODD_TEXTS, *texts, "same", "same"], [None, *range(1000, 1000 + len(ODD_TEXTS) - 1), *range(200), 5, 5])
    got = toxicity_scores(docs, labels(spark, toxic)).collect()
    assert len(got) == len(ODD_TEXTS) + 202 and all(0 <= r.score <= 1 for r in got)
    assert toxicity_scores(docs.limit(0), labels(spark, toxic)).count() == 0
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity_scores(docs, none).collect()} == {0.0}


def test_all_labelled_rows_are_counted(spark, monkeypatch):
    texts, toxic = corpus(400)
    chosen, stands_for = toxicity._chosen(labels(spark, toxic), "doc_id", "toxic", None)
    rows = chosen.collect()
    assert {(r.doc_id, r.toxic) for r in rows} == set(enumerate(toxic)) and len(rows) == 400
    # a quarter of the toxic rows, and as many ordinary ones, tune
    assert sorted((r.toxic for r in rows if r.tuning)) == [0] * 25 + [1] * 25 and stands_for == 3
    monkeypatch.setattr(toxicity, "TUNING_ROWS", 10)
    chosen, _ = toxicity._chosen(labels(spark, toxic), "doc_id", "toxic", None)
    assert sum(not r.tuning for r in chosen.collect()) == 380


def test_model_in_files(spark, monkeypatch):
    texts, toxic = corpus(400)
    docs = documents(spark, [*texts, "", "unseen words", None])
    held = {r.doc_id: r for r in toxicity_scores(docs, labels(spark, toxic)).collect()}
    monkeypatch.setattr(toxicity, "HELD", 0)
    monkeypatch.setattr(toxicity, "FILED", 50)
    model = fit(docs, labels(spark, toxic)).model
    assert len(model.words.files) > 1
    assert {r.doc_id: r for r in toxicity_scores(docs, labels(spark, toxic)).collect()} == held


def test_files_of_an_earlier_model_go(tmp_path):
    held = toxicity.Held.of(np.array([3, 1], dtype=np.uint64), np.ones(2), np.ones(2))
    uris = []
    for name in ("one/a", "one/b", "two/a"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(held.keys.tobytes() + held.gains.tobytes() + held.support.tobytes())
        uris.append((tmp_path / name).as_uri())
    toxicity._kept.clear()
    for uri, kept in zip(uris, (uris[:1], uris[:2], uris[2:]), strict=True):
        assert toxicity._file(uri).keys.tolist() == [1, 3] and sorted(toxicity._kept) == kept
    toxicity._kept.clear()


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes])})

    rows = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 60_000_000 and max(got) < 16_000_000
