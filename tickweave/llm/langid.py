"""Language of texts by bit-sliced Bloom filters of n-grams.

A slot of the filter holds a bit for each language, so the masks of an n-gram's slots, and-ed, name all languages that contain
it. A text's n-grams are counted per language by population counts; what a language's filter says yes to by chance is taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import keyed_text, slices, written
from tickweave.llm.shingles import mix

#: bytes of the n-grams; at most five fit beside their length and the language's number
ORDERS = (3, 4, 5)
#: an n-gram is in a language if it makes up so much of its n-grams at least, and so much of its largest share among all languages.
#: Both are shares, so the filter has at most 1 / LEAST_SHARE entries for a language however large the corpus is
LEAST_SHARE, LEAST_OF_LARGEST = 1e-5, 0.25
#: slots for each entry, hashes of an n-gram, slots of a block
SLOTS, HASHES, BLOCK = 8, 3, 1 << 16
#: bytes of text that are looked at together
TOGETHER = 2 << 20
UNKNOWN = "und"

#: bytes of letters stay, all other ASCII bytes part words
_LETTER = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint8)


def n_grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of each n-gram, its row) for each length: n bytes of the lower-case text, runs of other characters than letters as one blank.

    A number holds the length and the bytes, so different n-grams have different ones. A text of many times TOGETHER is cut at blanks.
    """
    import pyarrow.compute as pc

    if len(texts) == 1 and texts.nbytes > 4 * TOGETHER:
        whole, at = texts[0].as_py(), 0
        while at < len(whole):
            stop = at + TOGETHER
            if stop < len(whole):
                stop = max(whole.rfind(" ", at, stop), whole.rfind("\n", at, stop)) + 1 or stop
            yield from n_grams(pa.array([whole[at:stop]]))
            at = stop
        return
    text = pc.binary_join_element_wise(pc.utf8_lower(texts.cast(pa.large_string())), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = _LETTER[np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    data = np.concatenate([np.full(1, 32, dtype=np.uint8), data])
    blank = data == 32
    kept = np.concatenate([[True], ~(blank[1:] & blank[:-1])])
    # a text ends with a blank, and the blank before it belongs to the one before
    ends = np.cumsum(kept)[offsets[1:] - offsets[0]]
    data = data[kept]
    row = np.searchsorted(ends, np.arange(len(data)), side="right")
    wide = data.astype(np.uint64)
    value = wide.copy()
    for n in range(2, max(ORDERS) + 1):
        value = (value[:-1] << np.uint64(8)) | wide[n - 1 :] if len(value) > 1 else value[:0]
        if n in ORDERS and len(value):
            # from the blank before a text's first word to the blank after its last
            own = row[1 : len(value) + 1]
            inside = np.flatnonzero(own == row[n - 1 : n - 1 + len(value)])
            yield value[inside] | np.uint64(n << 40), own[inside]


def _slots(grams: np.ndarray, size: int) -> list[np.ndarray]:
    """Slots of each n-gram: from two halves of one hash."""
    h = mix(grams)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """`masks[w, s]`: languages 64 w to 64 w + 63 of slot s."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray
    common: int

    @classmethod
    def of(cls, languages: list[str], masks: np.ndarray, common: int) -> Filters:
        bits = masks.dtype.itemsize * 8
        filled = [np.count_nonzero(masks[k // bits] >> masks.dtype.type(k % bits) & masks.dtype.type(1)) for k in range(len(languages))]
        return cls(languages, masks, np.minimum((np.array(filled) / masks.shape[1]) ** HASHES, 1 - 1e-9), common)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text that each language contains, and all of them."""
        found, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        bits, one = self.masks.dtype.itemsize * 8, self.masks.dtype.type(1)
        for grams, row in n_grams(texts):
            if not len(row):
                continue
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            own = row[first]
            total[own] += np.diff(np.append(first, len(row)))
            slots = _slots(grams, self.masks.shape[1])
            for w, masks in enumerate(self.masks):
                containing = masks[slots[0]]
                for s in slots[1:]:
                    containing &= masks[s]
                for k in range(w * bits, min((w + 1) * bits, len(self.languages))):
                    sliced = (containing >> self.masks.dtype.type(k % bits)) & one
                    found[own, k] += np.add.reduceat(sliced, first, dtype=np.int64)
        return found, total

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of each text, and its share of what all languages contain."""
        found, total = self.hits(texts)
        sure = np.maximum(found - total[:, None] * self.chance, 0.0) / (1 - self.chance)
        sums = sure.sum(axis=1)
        best = np.where(sums > 0, sure.argmax(axis=1), self.common)
        share = np.where(sums > 0, sure[np.arange(len(best)), best] / np.maximum(sums, 1e-300), 1 / len(self.languages))
        return best, np.clip(share, 0.0, 1.0)


def learn(docs: DataFrame, may_learn: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters | None:
    """Filters from all rows with a text and a language (`may_learn`: a condition on doc_id). None if there are no such rows.

    What is collected: the languages, and the filter itself, whose size the shares bound; its blocks are made in tasks.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    if may_learn is not None:
        rows = rows.filter(may_learn)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            of = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for grams, row in n_grams(batch.column("text")):
                for k in np.unique(of[row]).tolist():
                    values, n = np.unique(grams[of[row] == k], return_counts=True)
                    yield pa.record_batch({"gram": pa.array(values.view(np.int64)), "lang": pa.array(np.full(len(n), k, dtype=np.int32)), "n": pa.array(n.astype(np.int64))})

    found = rows.select("text", "lang").mapInArrow(count, "gram long, lang int, n long")
    counts = written(found.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for k in totals for x in (k, float(totals[k])))), F.col("lang")) if totals else F.lit(0.0)
    shares = counts.select("gram", "lang", share.alias("share"))
    of_gram = shares.groupBy("gram").agg(F.max("share").alias("largest"), F.collect_list(F.struct("lang", "share")).alias("in"))
    kept = of_gram.select("gram", "largest", F.inline("in")).filter((F.col("share") >= LEAST_SHARE) & (F.col("share") >= LEAST_OF_LARGEST * F.col("largest")))
    bits = next(b for b in (8, 16, 32, 64) if b >= min(len(languages), 64))
    mask = F.expr(f"shiftleft(1L, lang % {bits})")
    entries = written(kept.groupBy("gram", F.floor(F.col("lang") / bits).cast("int").alias("word")).agg(F.bit_or(mask).alias("mask")), "entries")
    n = entries.count()
    size = max(BLOCK, 1 << max(0, int(SLOTS * n) - 1).bit_length())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.concatenate(_slots(batch.column("gram").to_numpy().view(np.uint64), size))
            yield pa.record_batch(
                {
                    "word": pa.array(np.tile(batch.column("word").to_numpy(), HASHES)), "block": pa.array(slots // BLOCK),
                    "slot": pa.array((slots % BLOCK).astype(np.int32)), "mask": pa.array(np.tile(batch.column("mask").to_numpy(), HASHES)),
                }
            )

    kind = np.dtype(f"u{bits // 8}")

    def fill(group: pa.Table) -> pa.Table:
        block = np.zeros(BLOCK, dtype=kind)
        np.bitwise_or.at(block, group.column("slot").to_numpy(), group.column("mask").to_numpy().astype(kind))
        return pa.table({"word": group.column("word")[:1], "block": group.column("block")[:1], "masks": pa.array([block.tobytes()], type=pa.binary())})

    placed = entries.mapInArrow(place, "word int, block long, slot int, mask long")
    masks = np.zeros((-(-len(languages) // bits), size), dtype=kind)
    for r in placed.groupBy("word", "block").applyInArrow(fill, "word int, block long, masks binary").collect():
        masks[r.word, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.masks, dtype=kind)
    return Filters.of(languages, masks, number[min(sizes, key=lambda x: (-sizes[x], x))])


def languages_of(docs: DataFrame, may_learn: Column | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score: a row per document, learned from those with a language that `may_learn` (a condition on doc_id) admits.

    lang_pred is a learned language; `und` (score 0) for null texts, texts without a letter, and all if there was nothing to learn from. A
    text whose n-grams no language contains gets the commonest one. Ties go to the first in order. score: the language's part of all
    languages' n-grams, 0 to 1. Null keys are never learned from if `may_learn` is given; each row, repeated ones too, is
    judged on its own. Empty table: no rows.
    """
    filters = learn(docs, may_learn, key, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, TOGETHER):
            known = batch.column("lettered").to_numpy(zero_copy_only=False)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if own is not None:
                best, share = own.decide(batch.column("text"))
                names = [own.languages[k] if x else UNKNOWN for k, x in zip(best.tolist(), known.tolist(), strict=True)]
                scores = np.where(known, share, 0.0)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, type=pa.string()), "score": pa.array(scores)})

    texts = keyed_text(docs, key, text).withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
