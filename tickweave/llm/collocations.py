"""Phrases whose words come together more often than apart, by marginalising counts of the longest windows.

Only windows of the longest length are counted: every word with the words that lead it, padded where its piece of text ends.
ROLLUP over the window's columns sums them to the counts of all shorter phrases, since a phrase begins one window wherever it
occurs. Phrases of each length are never expanded on their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import slices, written
from tickweave.llm.shingles import mix

#: bytes that end a piece of text, and bytes between its words
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: stands after the last word of a piece: no word holds it
PAD = "."
#: bytes of text that are counted together, and bytes of text whose windows one task adds up, about
TOGETHER, PART_BYTES = 4 << 20, 3 << 20
#: of the text a sixteenth is looked at to find beginnings that make up more than this part of all windows
SAMPLED, COMMON = 16, 256
#: parts of a language that are ranked on their own before their first rows meet
RANKED = 64

_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(BLANKS)], _CLASS[list(ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Runs of whole pieces of about `size` bytes: no phrase goes over the end of one. A longer piece comes alone."""
    at = 0
    while at < len(data):
        stop = at + size
        if stop < len(data):
            ends = np.flatnonzero(_CLASS[data[at:stop]] == 2)
            if len(ends):
                stop = at + int(ends[-1]) + 1
            else:
                while stop < len(data):
                    ends = np.flatnonzero(_CLASS[data[stop : stop + size]] == 2)
                    stop = stop + int(ends[0]) + 1 if len(ends) else stop + size
                    if len(ends):
                        break
        yield data[at:stop]
        at = min(stop, len(data))


def _words(data: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of some bytes, the place each begins at, and whether a piece ends between a word and the next."""
    kind = _CLASS[data]
    word = kind == 0
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    # not checked to be UTF-8 again: the bytes come from strings and are cut at ASCII bytes
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[word])))
    ends = np.flatnonzero(kind == 2)
    after = np.searchsorted(ends, stops)
    ended = np.ones(len(starts), dtype=bool)
    ended[:-1] = after[:-1] < np.searchsorted(ends, starts[1:])
    return words, starts, ended


def lead_windows(codes: np.ndarray, ended: np.ndarray, longest: int, pad: int) -> list[np.ndarray]:
    """Columns of the windows: each word, and the words that lead it by 1, 2, ... as long as its piece goes on, else `pad`."""
    columns, inside = [codes], np.ones(len(codes), dtype=bool)
    for k in range(1, longest):
        column = np.full(len(codes), pad, dtype=codes.dtype)
        inside[-k:] = False
        inside[:-k] &= ~ended[k - 1 : -1]
        column[:-k] = np.where(inside[:-k], codes[k:], pad)
        columns.append(column)
    return columns


def distinct_rows(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of some columns of codes, each below its size, in order, and how often each occurs."""
    key, most = columns[0].astype(np.int64), sizes[0]
    for column, size in zip(columns[1:], sizes[1:], strict=True):
        if most * size >= 1 << 62:  # number the rows so far anew, closely
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            most = len(key) + 1
        key, most = key * size + column, most * size
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def _segments(langs: list[str], texts: pa.Array, longest: int, step: int = 1) -> Iterator[tuple[list[str], list[str], list[np.ndarray], np.ndarray]]:
    """Of each segment of some texts its languages, its words in order with the pad at the end, and its different windows: columns of
    language and words as their numbers, and how often each occurs. With a `step`, of smaller segments only every so manieth."""
    import pyarrow.compute as pc

    lang_names = sorted(set(langs))
    number = {x: k for k, x in enumerate(lang_names)}
    lang_of = np.array([number[x] for x in langs], dtype=np.int64)
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = _LOWER[np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    begins, at = offsets[:-1] - offsets[0], 0
    for k, piece in enumerate(_pieces(data, TOGETHER // step)):
        start, at = at, at + len(piece)
        if k % step:
            continue
        words, starts, ended = _words(piece)
        if not len(words):
            continue
        row = np.searchsorted(begins, starts + start, side="right") - 1
        coded = words.dictionary_encode()
        # in the order of the words, so that equal beginnings lie side by side and shrink
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        names = coded.dictionary.take(pa.array(order)).to_pylist() + [PAD]
        codes = rank[coded.indices.to_numpy()]
        del words, coded, starts
        columns = [lang_of[row].astype(np.int32), *lead_windows(codes, ended, longest, len(names) - 1)]
        yield lang_names, names, *distinct_rows(columns, [len(lang_names), *[len(names)] * longest])


def _hashes(names: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(x.encode()) for x in names], dtype=np.uint64))


def _prefix_hash(lang: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    out = lang
    for column in columns:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def _common(langs: list[str], texts: pa.Array, longest: int) -> Iterator[pa.RecordBatch]:
    """Hashes of beginnings that make up more than a 64th of a sample of the windows, and, as hash 0, how many were looked at."""
    for lang_names, names, columns, n in _segments(langs, texts, longest, SAMPLED):
        lang, hashes = _hashes(lang_names), _hashes(names)
        key = _prefix_hash(lang[columns[0]], [hashes[c] for c in columns[1:-1]])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(n, first)
        many = np.flatnonzero(sums * 64 > n.sum())
        yield pa.record_batch({"key": pa.array(np.append(key[first[many]], np.uint64(0)).view(np.int64)), "n": pa.array(np.append(sums[many], n.sum()))})


def _blocks(langs: list[str], texts: pa.Array, longest: int, parts: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted windows of some texts as packed blocks, each of one part. Windows lie where their beginning does, common beginnings
    in further parts by the whole window."""
    for lang_names, names, columns, n in _segments(langs, texts, longest):
        lang, hashes = _hashes(lang_names), _hashes(names)
        key = _prefix_hash(lang[columns[0]], [hashes[c] for c in columns[1:-1]])
        part = (key % np.uint64(parts)).astype(np.int64)
        spread = np.flatnonzero(np.isin(key, common))
        part[spread] = parts + (mix(key[spread] + hashes[columns[-1][spread]]) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, n, columns = part[order], n[order].astype("<u4"), [c[order] for c in columns]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        last = np.append(first[1:], len(part))
        lines = pa.array([x + "\n" for x in names], type=pa.large_string())
        lang, taken = columns[0].astype("<u4"), [lines.take(pa.array(c)) for c in columns[1:]]
        ends = [np.frombuffer(t.buffers()[1], dtype=np.int64) for t in taken]
        values = [memoryview(t.buffers()[2]) for t in taken]
        codec = pa.Codec("zstd")
        packed, sizes = [], []
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            raw = b"".join([n[i:j].tobytes(), lang[i:j].tobytes(), *(v[e[i] : e[j]] for v, e in zip(values, ends, strict=True))])
            sizes.append(len(raw))
            packed.append(codec.compress(raw, asbytes=True))
        yield pa.record_batch(
            {
                "part": pa.array(part[first]), "langs": pa.array([lang_names] * len(first), type=pa.list_(pa.string())),
                "n": pa.array(last - first), "size": pa.array(sizes, type=pa.int64()), "block": pa.array(packed, type=pa.binary()),
            }
        )


def _unpacked(langs: list[str], n: int, size: int, block: bytes, names: list[str]) -> pa.Table:
    raw = np.frombuffer(pa.Codec("zstd").decompress(block, size), dtype=np.uint8)
    counts, lang, text = raw[: 4 * n].view("<u4"), raw[4 * n : 8 * n].view("<u4"), raw[8 * n :]
    ends = np.flatnonzero(text == 10)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    words = pa.StringArray.from_buffers(n * len(names), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text[text != 10])))
    columns = {c: words.slice(k * n, n) for k, c in enumerate(names)}
    return pa.table({"lang": pa.array(langs, type=pa.string()).take(pa.array(lang)), **columns, "n": pa.array(counts.astype(np.int64))})


def _added(rows: pa.Table) -> pa.Table:
    names = rows.column_names[:-1]
    return rows.group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"]).select([*names, "n"])


def _padded(rows: pa.Table, name: str) -> pa.Table:
    """Counted with a pad for the word of some column."""
    order = rows.column_names
    rows = _added(rows.drop([name]))
    return rows.append_column(name, pa.array([PAD]).take(pa.array(np.zeros(len(rows), dtype=np.int64)))).select(order)


def window_counts(docs: DataFrame, longest: int, least: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, w0, w1, ... and n: how often each padded window of `longest` words occurs.

    A window that occurs less than `least` times is counted with a pad for its last word, and one whose beginning does, if
    all of that lies in one part, with two: the sums over beginnings that occur `least` times are as they were, and so is the sum of all.
    Windows are counted where texts are read; what travels are packed blocks of sorted windows, dealt by their beginning. A
    sample finds beginnings that many windows share; those are dealt by the whole window (which moves work, not results).
    """
    import pyarrow.compute as pc

    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    names = [f"w{k}" for k in range(longest)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            yield from _common(batch.column("lang").to_pylist(), batch.column("text"), longest)

    # at most COMMON rows, by the condition
    looked = texts.mapInArrow(look, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    of_all = looked.filter("key = 0").agg(F.sum("n")).scalar()
    common = np.array([r.key for r in looked.filter((F.col("key") != 0) & (F.col("n") * COMMON > of_all)).collect()], dtype=np.int64).view(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TOGETHER):
            yield from _blocks(batch.column("lang").to_pylist(), batch.column("text"), longest, parts, common)

    def add(group: pa.Table) -> pa.Table:
        columns = zip(*(group.column(c).to_pylist() for c in ("langs", "n", "size", "block")), strict=True)
        table = _added(pa.concat_tables([_unpacked(*x, names) for x in columns]))
        rare = pc.less(table.column("n"), least)
        frequent, table = table.filter(pc.invert(rare)), _padded(table.filter(rare), names[-1])
        if longest > 2 and group.column("part")[0].as_py() < parts:
            # all windows with one of these beginnings are here
            rare = pc.less(table.column("n"), least)
            keys = ["lang", *names[:-1]]
            rest = table.filter(rare).join(frequent.select(keys), keys=keys, join_type="left anti", use_threads=False).select(table.column_names)
            some = table.filter(rare).join(frequent.select(keys), keys=keys, join_type="left semi", use_threads=False).select(table.column_names)
            table = pa.concat_tables([table.filter(pc.invert(rare)), some, _padded(rest, names[-2])])
        return pa.concat_tables([frequent, table])

    blocks = texts.mapInArrow(count, "part long, langs array<string>, n long, size long, block binary")
    # a few parts for each task, however many tasks a shuffle has by default
    return blocks.repartition(-(-parts // 4), "part").groupBy("part").applyInArrow(add, f"lang string, {', '.join(f'{c} string' for c in names)}, n long")


def phrase_counts(docs: DataFrame, longest: int, least: int, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, m, phrase, f: occurrences of every phrase of up to `longest` words with at least `least`, and, as m = 0, of all words."""
    names = [f"w{k}" for k in range(longest)]
    sums = window_counts(docs, longest, least, lang, text).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    # the columns summed over are the lowest bits: m words are left
    m = sum(F.when(F.col("g").bitwiseAND(1 << k) == 0, 1).otherwise(0) for k in range(longest))
    sums = sums.filter(F.col("g") < 1 << longest).withColumn("m", m)
    last = F.get(F.array(*names), F.col("m") - 1)
    kept = sums.filter((F.col("m") == 0) | ((last != PAD) & (F.col("f") >= least)))
    return kept.select("lang", "m", F.concat_ws(" ", *(F.when(F.col("m") > k, F.col(c)) for k, c in enumerate(names))).alias("phrase"), "f")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, most: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best phrases of 2 to `longest` words of each language.

    Words are lower-cased (A-Z) and lie between blanks and tabs in pieces that end at `.,;:!?` or a line end. A phrase that occurs
    a >= `least` times gets floor(1000000 a a / (l r)) for its two parts, the lowest over all cuts (ties: the shortest first part).
    A phrase inside a longer one that has half of its occurrences or more is left out. Ties in score: more occurrences, then the phrase
    in byte order. Sums and products are exact to 38 digits.

    Null lang: `und`. Null, empty or blank texts have no words. Repeated rows count each. Empty table: no rows. Keys aren't read.
    """
    counts = written(phrase_counts(docs, longest, least, lang, text), "phrases")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    found = counts.filter("m >= 2").select("lang", "phrase", "m", F.col("f").alias("a"), words.alias("w"))
    known = counts.filter("m >= 1").select("lang", "phrase", "f")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.lit(longest)).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    ratio = F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(a2 AS DECIMAL(31,0)) div lr")
    cuts = cuts.withColumn("a2", exact("a") * exact("a")).withColumn("lr", exact("l") * exact("r")).withColumn("score", ratio)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
    # shorter phrases inside longer ones
    spans = [(i, j) for j in range(2, longest) for i in range(1, longest - j + 2)]
    if spans:
        parts = F.array(*(F.when(F.col("m") > j, F.when(F.col("m") >= i + j - 1, part(F.lit(i), F.lit(j)))) for i, j in spans))
        inside = found.filter("m > 2").select("lang", F.explode(parts).alias("phrase"), "a").filter("phrase IS NOT NULL")
        inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 50 * a")
    order = [F.desc("s.score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    total = counts.filter("m = 0").select("lang", F.col("f").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score")
