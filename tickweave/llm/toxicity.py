"""Class-conditional Kneser-Ney models of toxic and ordinary text.

Two bigram models, one for each class, share their lowest order: the continuation counts of both together. What a class has seen
little of falls back on them, so rare words weigh the same for either class. A text's tokens get the difference of their
log-likelihoods, shrunk where few contexts support it; windows of tokens and the whole text give length-normalised differences, and
a logistic curve, fitted on rows that were not counted, turns them into a score. Discounts come from counts of counts, and how much
is shrunk is chosen by the likelihood of the same rows.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.collocations import distinct_rows
from tickweave.llm.common import keyed_text, shared_folder, slices, written
from tickweave.llm.files import attempt_name, reader, writer
from tickweave.llm.shingles import mix, word_numbers

#: labelled rows of each class that tune the score's curve: one in so many toxic ones, and so many rows at most. All others are counted
TUNING_PART, TUNING_ROWS = 4, 5_000
#: entries of the model up to which they are sent to each task, entries of a file of a larger one, and bytes of files that a worker keeps
HELD, FILED, KEPT = 1_000_000, 1_000_000, 128 << 20
#: contexts whose weight equals that of no evidence, to choose from: for words, and for a pair against its last word
SHRINK_WORDS, SHRINK_PAIRS = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), (16.0, 64.0, 256.0)
#: a pair that could weigh less than this against its last word is left to the word
LEAST_WEIGHT = 1 / 16
#: bytes of text whose contexts one task adds up, about; a word is common if it makes up more than this part of a sample
PART_BYTES, SAMPLED, COMMON = 4 << 20, 16, 256
#: tokens of a window: expressions of one or a few words
WINDOWS = (1, 2, 4)
#: log-likelihood difference of a token that says something by itself
STRONG = 1.0
#: bytes that aren't part of a word: all ASCII but letters and digits
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of words and of pairs (of a word and the one before it; 0 starts a text), and words per row."""
    words, counts = word_numbers(texts, GAPS)
    before = np.concatenate([[np.uint64(0)], words[:-1]]) if len(words) else words
    starts = (np.cumsum(counts) - counts)[counts > 0]
    before[starts] = 0
    return words, before, counts


def pair_numbers(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + words) | np.uint64(1)


@dataclass
class Held:
    """Keys in order, and of each a gain and the number of contexts behind it."""

    keys: np.ndarray
    gains: np.ndarray
    support: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, gains: np.ndarray, support: np.ndarray) -> Held:
        order = np.argsort(keys)
        return cls(keys[order], gains[order].astype(np.float32), support[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain and contexts of each key, both 0 for one that isn't there."""
        own, back = np.unique(keys, return_inverse=True)
        found = self.find_sorted(own)
        return found[0][back], found[1][back]

    def find_sorted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.gains[at], 0.0).astype(np.float64), np.where(hit, self.support[at], 0.0).astype(np.float64)


_kept: dict[str, Held] = {}
_kept_lock = threading.Lock()


def _file(uri: str) -> Held:
    """A file of the model; a worker keeps KEPT bytes of them for its later batches and tasks, and none of an earlier model."""
    if uri in _kept:
        return _kept[uri]
    with reader(uri) as source:
        data = source.read()
    n = len(data) // 16
    held = Held(np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n, 8 * n), np.frombuffer(data, "<f4", n, 12 * n))
    with _kept_lock:
        for old in [x for x in _kept if x.rpartition("/")[0] != uri.rpartition("/")[0]]:
            del _kept[old]
        if 16 * (n + sum(len(h.keys) for h in _kept.values())) <= KEPT:
            _kept[uri] = held
    return held


@dataclass
class Filed:
    """Keys and values in files of the shared folder, each sorted: a batch's different keys meet one file after the other."""

    files: list[str]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, back = np.unique(keys, return_inverse=True)
        gain, support = np.zeros(len(own)), np.zeros(len(own))
        for uri in self.files:
            g, s = _file(uri).find_sorted(own)
            gain, support = gain + g, support + s  # a key is in one file
        return gain[back], support[back]


@dataclass
class Model:
    """Log-likelihood differences, toxic less ordinary, of words alone and of words after a certain word."""

    words: Held | Filed
    pairs: Held | Filed
    shrink_words: float = SHRINK_WORDS[0]
    shrink_pairs: float = SHRINK_PAIRS[0]

    def found(self, words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Gain and contexts of each token's word and of its pair."""
        gain, support = self.words.find(words)
        known = np.flatnonzero(support)
        pair, pair_support = np.zeros(len(words)), np.zeros(len(words))
        pair[known], pair_support[known] = self.pairs.find(pair_numbers(before[known], words[known]))
        return gain, support, pair, pair_support

    def gains(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each token. A word that neither class knows falls back on the shared counts, which say the same for both: 0."""
        return shrunk(*self.found(words, before), self.shrink_words, self.shrink_pairs)


def shrunk(gain: np.ndarray, support: np.ndarray, pair: np.ndarray, pair_support: np.ndarray, words: float, pairs: float) -> np.ndarray:
    """Towards 0 for a word, and towards its last word for a pair, the more the fewer contexts there are."""
    alone = gain * support / (support + words)
    return alone + (pair - alone) * pair_support / (pair_support + pairs)


@dataclass
class Discounts:
    """What is taken off a count of 1, of 2, and of more, by class; from counts of counts."""

    of: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def estimated(cls, seen: dict[str, list[float]]) -> Discounts:
        """seen: for each class how many counts are 1, 2, 3 and 4. Discounts lie between 0 and their count, and grow by less than it,
        so a higher count always keeps more."""
        out = {}
        for c, (n1, n2, n3, n4) in seen.items():
            y = n1 / (n1 + 2 * n2) if n1 else 0.5
            raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
            own = [min(max(raw[0], 0.05), 0.95)]
            for k in (1, 2):
                own.append(min(max(raw[k], 0.05), own[-1] + 0.95))
            out[c] = own
        return cls(out)

    def cut(self, counts: np.ndarray, c: str) -> np.ndarray:
        return np.array([0.0, *self.of[c]])[np.minimum(counts, 3).astype(np.int64)]


def _alone(count: np.ndarray, n: np.ndarray, c: str, sums: dict[str, float], cuts: Discounts) -> np.ndarray:
    share = max(sums[f"cut_{x}"] / max(1.0, sums[x]) for x in "to")
    shared, above = n / max(1.0, sums["n"]), sums[c] - sums[f"cut_{c}"]
    return (1 - share) * (count - cuts.cut(count, c)) / above + share * shared if above > 0 else shared


def word_gains(words: dict[str, np.ndarray], sums: dict[str, float], cuts: Discounts) -> np.ndarray:
    """Gains of words alone, from numbers of contexts.

    words: `t` and `o` (different words before it in toxic and in ordinary text), `n` (in all). sums: `t`, `o`, `n` over all
    words, `cut_t`, `cut_o` (of the discounts).

    Numbers of contexts, not of occurrences, count at every order: a passage that many documents copy counts once. Both classes
    give the same share to the lower order, and the lowest is the number of contexts in both together.
    """
    return np.log(_alone(words["t"], words["n"], "t", sums, cuts) / _alone(words["o"], words["n"], "o", sums, cuts))


def pair_gains(pairs: dict[str, np.ndarray], sums: dict[str, float], cuts: Discounts, pair_cuts: Discounts) -> np.ndarray:
    """Gains of words after a certain word.

    pairs: `t`, `o` (different words ahead of the pair), `word_t`, `word_o`, `word_n` as for words, and over all pairs of `before`:
    `all_t`, `all_o` (sums), and how many counts are 1, 2 and more: `t1` to `t3`, `o1` to `o3`. sums: as for words.
    """
    cut = {c: sum(pairs[f"{c}{k + 1}"] * d for k, d in enumerate(pair_cuts.of[c])) for c in "to"}
    weight = (cut["t"] + cut["o"]) / np.maximum(pairs["all_t"] + pairs["all_o"], 1e-9)
    after = {}
    for c in "to":
        lower = _alone(pairs[f"word_{c}"], pairs["word_n"], c, sums, cuts)
        above = pairs[f"all_{c}"] - cut[c]
        own = (pairs[c] - pair_cuts.cut(pairs[c], c)) / np.maximum(above, 1e-9)
        after[c] = np.where(pairs[f"all_{c}"] > 0, weight * lower + (1 - weight) * own, lower)
    return np.log(after["t"] / after["o"])


def features(gains: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each text, length-normalised differences: the largest of its windows of each length, and that of the whole; and, on a log
    scale, how much its tokens go beyond STRONG together, so that several expressions say more than one."""
    ends = np.cumsum(counts)
    starts = ends - counts
    total = np.concatenate([[0.0], np.cumsum(gains)])
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(gains))
    out = []
    for length in WINDOWS:
        stop = np.minimum(place + length, ends[row])
        full = (stop - place == length) | (place == starts[row])
        best = np.full(len(counts), -np.inf)
        np.maximum.at(best, row[full], (total[stop[full]] - total[place[full]]) / length)
        out.append(np.where(counts > 0, best, 0.0))
    beyond = np.bincount(row, np.maximum(gains - STRONG, 0.0), minlength=len(counts))
    return np.stack([*out, (total[ends] - total[starts]) / np.maximum(counts, 1), np.log1p(beyond)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (the last is the constant) of a ridge logistic regression, by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    beta = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Scorer:
    model: Model
    beta: np.ndarray

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text, and its length-normalised difference as a whole."""
        f = text_features(self.model, texts)
        z = np.concatenate([f, np.ones((len(f), 1))], axis=1) @ self.beta
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), f[:, len(WINDOWS)]


def text_features(model: Model, texts: pa.Array) -> np.ndarray:
    words, before, counts = tokens(texts)
    return features(model.gains(words, before), counts)


def _chosen(labels: DataFrame, key: str, label: str, may_learn: Column | None) -> tuple[DataFrame, float] | None:
    """(doc_id, toxic, tuning) of all labelled rows to learn from, and how many ordinary rows each of those that tune stands for.

    The rows of smallest hash of each class tune the score; all others are counted.
    """
    spark = labels.sparkSession
    rows = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if may_learn is not None:
        rows = rows.filter(may_learn)
    rows = rows.groupBy("doc_id").agg(F.when(F.max("toxic") > 0, 1).otherwise(0).alias("toxic"))
    sizes = dict(rows.groupBy("toxic").agg(F.count("*")).collect())
    if not sizes.get(1) or not sizes.get(0):
        return None
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    wanted = {c: min(TUNING_ROWS, -(-min(sizes[1], sizes[c]) // TUNING_PART)) for c in (1, 0)}
    ids = []
    for toxic, n in wanted.items():
        top = rows.filter(F.col("toxic") == toxic).select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(n)
        ids += [(int(d), True) for d in top.toPandas()["doc_id"]]
    # bounded by the parameters above, so every executor may hold it
    tuning = F.broadcast(spark.createDataFrame(ids, "doc_id long, tuning boolean"))
    rows = rows.join(tuning, "doc_id", "left").select("doc_id", "toxic", F.coalesce("tuning", F.lit(False)).alias("tuning"))
    return written(rows, "chosen"), sizes[0] / wanted[0] * wanted[1] / sizes[1]


_BLOCKS = "part long, n long, size long, block binary"
_COUNTS = ["kind int", "key long", "other long", *(f"v{k} double" for k in range(8))]


def _triples(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of some texts in order, and the different rows of (word before, word, word ahead of both, class) as their numbers."""
    words, before, counts = tokens(texts)
    first = before == 0
    del before
    known, codes = np.unique(np.append(words, np.uint64(0)), return_inverse=True)  # 0 comes first
    del words
    codes = codes[:-1].astype(np.int32)
    none = np.zeros(1, dtype=np.int32)
    behind = np.concatenate([none, codes[:-1]]) if len(codes) else codes
    behind[first] = 0
    ahead = np.concatenate([none, behind[:-1]]) if len(codes) else codes
    ahead[first] = 0
    columns, _ = distinct_rows([behind, codes, ahead, np.repeat(toxic.astype(np.int8), counts)], [*[len(known)] * 3, 2])
    return known, columns


def _look(texts: pa.Array) -> pa.RecordBatch:
    """Words that make up more than a 64th of a sample of the tokens; as key 0 the bytes of all texts, as key 1 the tokens looked at."""
    words = tokens(texts.slice(0, -(-len(texts) // SAMPLED)))[0]
    own, n = np.unique(words, return_counts=True)
    many = n * 64 > n.sum()
    size = int(np.sum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    return pa.record_batch({"key": pa.array(np.concatenate([own[many], np.array([0, 1], dtype=np.uint64)]).view(np.int64)), "n": pa.array(np.concatenate([n[many], [size, len(words)]]))})


def _blocks(texts: pa.Array, toxic: np.ndarray, parts: int, common: np.ndarray) -> pa.RecordBatch:
    """The different contexts of some texts as packed blocks, each of one part: that of the word before, of the pair if that word is
    common. A block has words of its own, and small numbers for them, so that it shrinks."""
    known, columns = _triples(texts, toxic)
    behind, word = known[columns[0]], known[columns[1]]
    place = mix(behind)
    spread = np.isin(behind, common)
    place[spread] = pair_numbers(behind[spread], word[spread])
    part = (place % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    del behind, word, place, spread, order
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else part
    codec, packed, sizes = pa.Codec("zstd"), [], []
    last = np.append(first[1:], len(part))[: len(first)]
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        used, codes = np.unique(np.concatenate([c[i:j] for c in columns[:3]]), return_inverse=True)
        raw = b"".join([len(used).to_bytes(8, "little"), known[used].tobytes(), codes.astype("<u4").tobytes(), columns[3][i:j].astype(np.uint8).tobytes()])
        sizes.append(len(raw))
        packed.append(codec.compress(raw, asbytes=True))
    return pa.record_batch({"part": pa.array(part[first]), "n": pa.array(last - first, type=pa.int64()), "size": pa.array(sizes, type=pa.int64()), "block": pa.array(packed, type=pa.binary())})


def _unpacked(n: int, size: int, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(block, size)
    words = int.from_bytes(raw[:8], "little")
    known = np.frombuffer(raw, "<u8", words, 8)
    codes = np.frombuffer(raw, "<u4", 3 * n, 8 + 8 * words)
    return known[codes[:n]], known[codes[n : 2 * n]], known[codes[2 * n :]], np.frombuffer(raw, np.uint8, n, 8 + 8 * words + 12 * n)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of some keys, and where each begins in it."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))


def _counted(group: pa.Table) -> pa.Table:
    """Of one part: contexts of pairs (kind 2), of words (0), of the words before (1), and counts of counts (3). Pairs are complete."""
    behind, word, ahead, toxic = (np.concatenate(x) for x in zip(*(_unpacked(*x) for x in zip(*(group.column(c).to_pylist() for c in ("n", "size", "block")), strict=True)), strict=True))
    pair = pair_numbers(behind, word)
    order, first = _grouped(mix(pair + mix(ahead)))
    classes = np.bitwise_or.reduceat(np.where(toxic[order], 1, 2), first)
    at = order[first]
    behind, word, pair = behind[at], word[at], pair[at]
    order, first = _grouped(pair)
    counts = {"t": np.add.reduceat((classes & 1)[order], first), "o": np.add.reduceat((classes >> 1)[order], first)}
    behind, word = behind[order[first]], word[order[first]]
    t, o = counts["t"], counts["o"]
    rows = []

    def add(kind: int, key: np.ndarray, other: np.ndarray, *values: np.ndarray) -> None:
        values = [*values, *[np.zeros(len(key))] * (8 - len(values))]
        arrays = [pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), *(pa.array(x.astype(np.float64)) for x in values)]
        rows.append(pa.Table.from_arrays(arrays, names=[c.split()[0] for c in _COUNTS]))

    order, first = _grouped(word)
    sums = [np.add.reduceat(x[order].astype(np.int64), first) for x in (t > 0, o > 0, np.ones(len(t)))]
    add(0, word[order[first]], np.zeros(len(first), dtype=np.uint64), *sums)
    order, first = _grouped(behind)
    values = [t, o, *(f(x) for x in (t, o) for f in (lambda x: x == 1, lambda x: x == 2, lambda x: x > 2))]
    add(1, behind[order[first]], np.zeros(len(first), dtype=np.uint64), *(np.add.reduceat(x[order].astype(np.int64), first) for x in values))
    some = (t + o) / (t + o + SHRINK_PAIRS[0]) >= LEAST_WEIGHT
    add(2, behind[some], word[some], t[some], o[some])
    add(3, np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64), *(np.array([(x == k).sum()]) for x in (t, o) for k in range(1, 5)))
    return pa.concat_tables(rows)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", may_learn: Column | None = None) -> Scorer | None:
    """Models and score curve from all labelled rows (`may_learn`: a condition on doc_id). None without rows of both classes."""
    found = _chosen(labels, key, label, may_learn)
    if found is None:
        return None
    chosen, stands_for = found
    texts = keyed_text(docs, key, text)
    learned = texts.join(chosen.filter("NOT tuning"), "doc_id").select("text", "toxic")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            yield _look(batch.column("text"))

    # what decides about work alone, not about results: how many parts there are, and which words are common (at most COMMON)
    looked = learned.mapInArrow(look, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    of_all = looked.filter("key = 1").agg(F.sum("n")).scalar()
    seen = {r.key: r.n for r in looked.filter((F.col("key") == 0) | (F.col("n") * COMMON > of_all)).collect()}
    parts = max(1, -(-seen.get(0, 0) // PART_BYTES))
    common = np.array([k for k in seen if k not in (0, 1)], dtype=np.int64).view(np.uint64)
    # a text begins after no word, 0; as many texts begin with some words
    common = np.append(common, np.uint64(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 6 << 20):
            yield _blocks(batch.column("text"), batch.column("toxic").to_numpy(), parts, common)

    blocks = learned.mapInArrow(count, _BLOCKS).repartition(-(-parts // 4), "part")
    counted = blocks.groupBy("part").applyInArrow(_counted, ", ".join(_COUNTS))
    counts = written(counted.groupBy("kind", "key", "other").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(8))), "counts")

    def of_kind(kind: int, *names: str) -> DataFrame:
        return counts.filter(F.col("kind") == kind).select(*(F.col(c).alias(n) for c, n in zip(["key", "other", *(f"v{k}" for k in range(8))], names, strict=False) if n))

    words = of_kind(0, "word", "", "t", "o", "n")
    how_many = [F.sum((F.col(c) == k).cast("long")).alias(f"{c}{k}") for c in "to" for k in range(1, 5)]
    facts = words.agg(*(F.sum(c).alias(c) for c in ("t", "o", "n")), *how_many).first().asDict()
    facts = {k: float(v or 0) for k, v in facts.items()}
    cuts = Discounts.estimated({c: [facts[f"{c}{k}"] for k in range(1, 5)] for c in "to"})
    pairs_seen = counts.filter("kind = 3").first()
    pair_cuts = Discounts.estimated({c: [float(pairs_seen[f"v{4 * i + k}"]) if pairs_seen else 0.0 for k in range(4)] for i, c in enumerate("to")})
    # a count of more than 2 loses what one of 3 does
    sums = {c: facts[c] for c in ("t", "o", "n")}
    more = words.agg(*(F.sum((F.col(c) > 2).cast("long")).alias(c) for c in "to")).first()
    for c in "to":
        sums[f"cut_{c}"] = facts[f"{c}1"] * cuts.of[c][0] + facts[f"{c}2"] * cuts.of[c][1] + float(more[c] or 0) * cuts.of[c][2]

    lines = of_kind(1, "before", "", "all_t", "all_o", "t1", "t2", "t3", "o1", "o2", "o3")
    named = of_kind(0, "word", "", "word_t", "word_o", "word_n")
    kept = of_kind(2, "before", "word", "t", "o").join(lines, "before").join(named, "word")

    def word_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _arrays(batch)
            yield _entries(0, at["word"], word_gains(at, sums, cuts), at["n"])

    def pair_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _arrays(batch)
            yield _entries(1, pair_numbers(at["before"], at["word"]), pair_gains(at, sums, cuts, pair_cuts), at["t"] + at["o"])

    form = "kind int, key long, gain double, support double"
    model = _model(written(words.mapInArrow(word_entries, form).unionByName(kept.mapInArrow(pair_entries, form)), "model"))
    choices = [(w, p) for w in SHRINK_WORDS for p in SHRINK_PAIRS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            own, before, n = tokens(batch.column("text"))
            found = model.found(own, before)
            f = np.concatenate([features(shrunk(*found, w, p), n) for w, p in choices], axis=1)
            yield pa.record_batch({"f": pa.array(f.tolist(), type=pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    tuned = texts.join(F.broadcast(chosen.filter("tuning")), "doc_id").select("text", "toxic")
    tuning = tuned.mapInArrow(measure, "f array<double>, toxic int").toPandas()
    y = tuning["toxic"].to_numpy(dtype=float)
    if not 0 < y.sum() < len(y):
        return None
    x, weight = np.stack(tuning["f"].to_list()), np.where(y > 0, 1.0, stands_for)
    curves = [logistic(own, y, weight) for own in np.split(x, len(choices), axis=1)]
    fits = [likelihood(own, y, weight, beta) for own, beta in zip(np.split(x, len(choices), axis=1), curves, strict=True)]
    best = int(np.argmax(fits))
    model.shrink_words, model.shrink_pairs = choices[best]
    return Scorer(model, curves[best])


def likelihood(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> float:
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1) @ beta
    return float(-(weight * np.logaddexp(0.0, np.where(y > 0, -z, z))).sum())


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
    return {c: x.view(np.uint64) if c in ("word", "before") else x for c, x in columns.items()}


def _entries(kind: int, keys: np.ndarray, gains: np.ndarray, support: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"kind": pa.array(np.full(len(keys), kind, dtype=np.int32)), "key": pa.array(keys.view(np.int64)), "gain": pa.array(gains), "support": pa.array(support)})


def _model(entries: DataFrame) -> Model:
    """From kind (0: word, 1: pair), key, gain and contexts of each entry: in memory, or in files of the shared folder if there are many."""
    n = entries.count()
    if n <= HELD:
        rows = entries.toPandas()
        kinds, keys, gains, support = rows["kind"].to_numpy(), rows["key"].to_numpy(dtype=np.int64).view(np.uint64), rows["gain"].to_numpy(dtype=float), rows["support"].to_numpy(dtype=float)
        return Model(*(Held.of(keys[kinds == k], gains[kinds == k], support[kinds == k]) for k in (0, 1)))
    folder = shared_folder(entries.sparkSession, "model")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(c).to_numpy() for c in ("kind", "key", "gain", "support")] for b in batches if b.num_rows]
        if not got:
            return
        kinds, keys, gains, support = (np.concatenate(c) for c in zip(*got, strict=True))
        files = {}
        for kind in np.unique(kinds).tolist():
            own = Held.of(keys[kinds == kind].view(np.uint64), gains[kinds == kind], support[kinds == kind])
            files[kind] = attempt_name(folder, f"-{kind}.bin")
            with writer(files[kind]) as out:
                for x, form in ((own.keys, "<u8"), (own.gains, "<f4"), (own.support, "<f4")):
                    out.write(x.astype(form).tobytes())
        yield pa.record_batch({"kind": pa.array(list(files), type=pa.int32()), "path": pa.array(list(files.values()))})

    files = entries.repartition(-(-n // FILED), "key").mapInArrow(write, "kind int, path string").collect()
    return Model(*(Filed(sorted(f.path for f in files if f.kind == k)) for k in (0, 1)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", may_learn: Column | None = None) -> DataFrame:
    """doc_id, gain (length-normalised difference of the whole text), score (0 to 1), predicted (1 from 0.5 on): a row per document.

    Null, empty and wordless texts: the score of a text without evidence. Null and repeated keys: each row is scored. Rows of
    `labels` with null key or label don't count; a key with several labels counts as toxic if one says so. Without labelled rows
    of both classes every score is 0. Empty table: no rows. All labelled rows but the bounded tuning sample are counted. A model of
    up to HELD entries goes to the tasks; a larger one stays in the shared folder, and a worker keeps what it has read of its files.
    """
    scorer = fit(docs, labels, key, text, label, may_learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 2 << 20):
            score, gain = own.scores(batch.column("text")) if own else (np.zeros(batch.num_rows), np.zeros(batch.num_rows))
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "gain": pa.array(gain), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            )

    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return keyed_text(docs, key, text).mapInArrow(run, "doc_id long, gain double, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", may_learn: Column | None = None) -> DataFrame:
    """The rows of `docs`, all columns, that `toxicity_scores` doesn't predict toxic. Null, empty and wordless texts have the score of a
    text without evidence; each of repeated rows and of rows with a null key is judged. Empty table: no rows. Columns may have any name."""
    scorer = fit(docs, labels, key, text, label, may_learn)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 2 << 20):
            texts = pc.fill_null(batch.column(at).cast(pa.string()), "")
            yield batch.filter(pa.array(own.scores(texts)[0] < 0.5)) if own and batch.num_rows else batch

    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return docs.mapInArrow(run, docs.schema)
