"""N-gram Jaccard join by set size: fixed-size subsets for small sets, inverted lists for large ones.

Texts with one set of shingles are one class; classes are joined, documents aren't. A boundary on the set size, chosen by
estimated cost, parts small sets from large.

* Small with small: sets of k and k' shingles link if they share at least c(k, k') of them. Each small set lists its subsets
  of c shingles for every k' that is near enough; a set of size k and one of size k' with a common subset are linked, and no
  others. The smallest of each side stands for it, so a group of n sets gives about 2n links, not n squared.
* Pairs with a large set: each set puts its rarest shingles into inverted lists, as many as needed to meet every partner there.
  Only lists with two sets or more are kept. Members are first compared with one of them, the one with fewest rare shingles.
  What is in one component by then needs no comparison; of the rest, each first meets its most likely partner and then all
  partners in the list that pass the bounds (sizes, position in the list, parity sketch). Each such pair is compared exactly.

Long lists are cut into blocks, and blocks meet in pairs; no list is gathered as a whole.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import free_name, keyed_text, slices, written
from tickweave.llm.components import components
from tickweave.llm.shingles import mix, shingle_sets

#: two sets link if DEN * intersection >= NUM * union
NUM, DEN = 80, 100
#: entries of the table of shingle counts that orders shingles from rare to common; only the order depends on it
COUNT_BITS = 20
#: a shingle's count is noted if so many texts of a batch have it; only the order depends on it
NOTED = 3
#: largest set size that may be called small
SMALL_MOST = 14
#: entries of inverted lists that one group looks through for shingles met twice
LIST_ENTRIES = 250_000
#: members of a block of a long list
BLOCK = 512
#: bits of the table that picks texts, as a power of two
FILTER_BITS = 24


def shared_least(k: int | np.ndarray, m: int | np.ndarray):
    """Fewest shingles that sets of k and m must share to link: |x| * (DEN + NUM) >= NUM * (k + m)."""
    return -((-NUM * (k + m)) // (DEN + NUM))


def smallest_partner(k: int | np.ndarray):
    return -((-NUM * k) // DEN)


def prefix_length(k: np.ndarray) -> np.ndarray:
    return k - smallest_partner(k) + 1


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat).view(np.uint8))])


def _fingerprints(forms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each set: equal sets, equal numbers."""
    ends = np.cumsum(counts)
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(forms) + 1, dtype=np.uint64)
        np.cumsum(mix(forms ^ np.uint64(salt)), dtype=np.uint64, out=total[1:])
        sums.append(total[ends] - total[ends - counts])
    return mix(sums[0] + counts.astype(np.uint64)).view(np.int64), sums[1].view(np.int64)


def _sketches(forms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of the set's members in each of 2^j cells, about 4 to 8 times as many as members, at least 64."""
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(1, 4 * counts)))).astype(np.int64)
    first = np.cumsum(bits) - bits
    cell = np.repeat(first, counts) + (forms & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little"), bits // 8


def classes_of(texts: DataFrame) -> DataFrame:
    """One row per document: doc_id, h (a hash of the text), n, cid and check (fingerprints), sketch, small (the set itself, if it may be called small); and, now
    and then, lists of shingle cells with the number of texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms, counts = shingle_sets(batch.column(1))
            cid, check = _fingerprints(forms, counts)
            sketch, sizes = _sketches(forms, counts)
            tiny = np.repeat(counts <= SMALL_MOST, counts)
            seen, n = np.unique(forms, return_counts=True)
            often = n >= NOTED
            cells = (seen[often] >> np.uint64(64 - COUNT_BITS)).astype(np.int32)
            rows = batch.num_rows
            noted = [cells.tolist()] + [None] * (rows - 1)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0), "h": batch.column(2), "n": pa.array(counts), "cid": pa.array(cid), "check": pa.array(check),
                    "sketch": _binary(sketch, sizes),
                    "small": _binary(forms[tiny], np.where(counts <= SMALL_MOST, counts, 0) * 8),
                    "cells": pa.array(noted, type=pa.list_(pa.int32())),
                    "times": pa.array([n[often].tolist()] + [None] * (rows - 1), type=pa.list_(pa.int64())),
                }
            )

    return texts.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        run, "doc_id long, h long, n long, cid long, check long, sketch binary, small binary, cells array<int>, times array<long>"
    )


def _count_table(docs: DataFrame) -> np.ndarray:
    """For every cell, the logarithm of how often its shingles were noted: 2^COUNT_BITS bytes, whatever the corpus."""
    noted = docs.filter("cells IS NOT NULL").select(F.explode(F.arrays_zip("cells", "times")).alias("c"))
    sums = noted.groupBy(F.col("c.cells").alias("cell")).agg(F.sum("c.times").alias("n")).toPandas()
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint8)
    out[sums["cell"].to_numpy(dtype=np.int64)] = np.ceil(np.log2(1 + sums["n"].to_numpy(dtype=float))).astype(np.uint8)
    return out


def _boundary(docs: DataFrame, common: np.ndarray) -> int:
    """The size up to which listing subsets costs less than list entries, from the histogram of the small sizes."""
    sizes = dict(docs.filter(F.col("n").between(1, SMALL_MOST)).groupBy("n").agg(F.countDistinct("cid")).collect())
    entry = 2.0 + float(common.mean())  # one list entry: written, and met by others as common as shingles are
    best, least = 0, None
    for x in range(SMALL_MOST + 1):
        cost = sum(c * (sum(math.comb(k, shared_least(k, m)) for m in _partners(k, x)) if k <= x else entry * (k - smallest_partner(k) + 1)) for k, c in sizes.items())
        if least is None or cost < least:
            best, least = x, cost
    return best


def _partners(k: int, most: int) -> range:
    return range(smallest_partner(k), min(most, k * DEN // NUM) + 1)


def small_links(docs: DataFrame, boundary: int) -> DataFrame:
    """(a, b) links between small sets, through the smallest set on each side of every subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = {k: {c: np.array(list(itertools.combinations(range(k), c))) for c in {shared_least(k, m) for m in _partners(k, boundary)}} for k in range(1, boundary + 1)}
        for batch in batches:
            sizes = batch.column("n").to_numpy()
            cids = batch.column("cid").to_numpy()
            sets = batch.column("small").to_pylist()
            for k in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == k)
                members = mix(np.frombuffer(b"".join(sets[i] for i in rows), dtype="<u8").reshape(-1, k))
                for m in _partners(k, boundary):
                    chosen = picks[k][shared_least(k, m)]
                    low, high = min(k, m), max(k, m)
                    for at in range(0, len(rows), 4096):
                        keys = mix(members[at : at + 4096][:, chosen].sum(axis=2, dtype=np.uint64) + np.uint64(1009 * low + high))
                        yield pa.record_batch(
                            {
                                "key": pa.array(keys.reshape(-1).view(np.int64)),
                                "upper": pa.array(np.full(keys.size, k == high and k != low)),
                                "even": pa.array(np.full(keys.size, k == m)),
                                "cid": pa.array(np.repeat(cids[rows[at : at + 4096]], keys.shape[1])),
                            }
                        )

    small = docs.filter(F.col("n").between(1, boundary)).groupBy("cid").agg(F.first("n").alias("n"), F.first("small").alias("small"))
    subsets = written(small.mapInArrow(run, "key long, upper boolean, even boolean, cid long"), "subsets")
    sides = subsets.groupBy("key").agg(
        F.min(F.when(~F.col("upper"), F.col("cid"))).alias("low"), F.min(F.when(F.col("upper") | F.col("even"), F.col("cid"))).alias("high")
    )
    met = subsets.join(sides.filter("low IS NOT NULL AND high IS NOT NULL"), "key")
    return met.select(F.col("cid").alias("a"), F.when(F.col("upper"), F.col("low")).otherwise(F.col("high")).alias("b")).filter("a <> b").distinct()


_ENTRY = np.dtype([("token", "<u8"), ("cid", "<i8"), ("n", "<u4"), ("pos", "<u4")])
#: position of an entry that only says that a shingle is in two sets of its batch
_MET = np.uint32(0xFFFFFFFF)


def list_entries(texts: DataFrame, common: np.ndarray, boundary: int, groups: int) -> DataFrame:
    """(token, cid, n, pos): entries of the inverted lists of shingles that two sets or more have among their rarest.

    `pos` is the place of the shingle in its set, rarest first. Sets too small for a partner over the boundary have no entries.
    A batch decides alone on shingles that two of its sets have. All other entries travel packed, in `groups` groups of
    shingles; a shingle has one such entry per batch at most, however many sets have it.
    """
    least = int(smallest_partner(boundary + 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            out = _rarest(batch, common, least)
            same = out["token"][1:] == out["token"][:-1]
            met = (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(out)]
            marks = out[met][np.unique(out["token"][met], return_index=True)[1]]
            marks["pos"] = _MET
            single = np.concatenate([out[~met], marks])
            group = (single["token"] % np.uint64(groups)).astype(np.int64)
            single = single[np.argsort(group, kind="stable")]
            sizes = np.bincount(group, minlength=groups)
            ends = np.cumsum(sizes)
            have = np.flatnonzero(sizes)
            parts = [single[ends[g] - sizes[g] : ends[g]].tobytes() for g in have.tolist()]
            decided = [out[met][i : i + 100_000].tobytes() for i in range(0, int(met.sum()), 100_000)]
            keys = np.concatenate([have, -1 - serial - np.arange(len(decided))])  # what is decided is only unpacked: a group each
            serial += len(decided)
            yield pa.record_batch({"group": pa.array(keys.astype(np.int64)), "entries": pa.array(parts + decided, type=pa.binary())})

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        found = np.frombuffer(b"".join(group.column("entries").to_pylist()), dtype=_ENTRY)
        if key[0].as_py() >= 0 and len(found):
            found = found[np.lexsort((found["cid"], found["token"]))]
            start = np.flatnonzero(np.concatenate([[True], found["token"][1:] != found["token"][:-1]]))
            several = np.minimum.reduceat(found["cid"], start) != np.maximum.reduceat(found["cid"], start)
            several |= np.maximum.reduceat(found["pos"], start) == _MET
            found = found[np.repeat(several, np.diff(np.append(start, len(found)))) & (found["pos"] != _MET)]
        return pa.table({"token": found["token"].view(np.int64), **{c: found[c].astype(np.int64) for c in ("cid", "n", "pos")}})

    packed = texts.select("doc_id", "text").mapInArrow(pack, "group long, entries binary")
    return packed.groupBy("group").applyInArrow(meet, "token long, cid long, n long, pos long").distinct()


def _rarest(batch: pa.RecordBatch, common: np.ndarray, least: int) -> np.ndarray:
    """Entries of a batch's distinct sets, by shingle."""
    forms, counts = shingle_sets(batch.column(1))
    cid, _ = _fingerprints(forms, counts)
    first = np.zeros(len(cid), dtype=bool)
    first[np.unique(cid, return_index=True)[1]] = True
    used = np.repeat(first & (counts >= max(1, least)), counts)
    row = np.repeat(np.arange(len(counts)), counts)[used]
    forms = forms[used]
    order = np.lexsort((forms, common[(forms >> np.uint64(64 - COUNT_BITS)).astype(np.int64)], row))
    forms, row = forms[order], row[order]
    kept = np.bincount(row, minlength=len(counts))
    pos = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
    front = pos < prefix_length(counts)[row]
    out = np.zeros(int(front.sum()), dtype=_ENTRY)
    out["token"], out["cid"], out["n"], out["pos"] = forms[front], cid[row[front]], counts[row[front]], pos[front]
    return out[np.argsort(out["token"], kind="stable")]


def _kinds(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """(cid, n, sketch, doc_id) of the classes in inverted lists; doc_id: one document of each."""
    # copies shrink to their class where they are read, before anything is joined
    classes = facts.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
    return classes.join(entries.select("cid").distinct(), "cid", "left_semi")


def _maybe_in(keys: DataFrame, column: str) -> np.ndarray:
    """A table of 2^FILTER_BITS bits, whatever the corpus: the bits of all keys are set. What it lets through too much does no harm."""
    places = keys.select(F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)).alias("at"))
    bits = places.select(F.floor(F.col("at") / 63).alias("word"), F.expr("shiftleft(1L, CAST(at % 63 AS INT))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros((1 << FILTER_BITS) // 63 + 1, dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64)
    return out


def _sets_of(texts: DataFrame, kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cid, forms) of the classes in pairs, from one document of each. Texts are picked where they are read, not shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    chosen = _maybe_in(kinds.join(wanted, "cid", "left_semi"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((chosen[at // 63] >> (at % 63)) & 1 == 1))
            for part in slices(iter([batch])) if batch.num_rows else ():
                forms, counts = shingle_sets(part.column("text"))
                cid, _ = _fingerprints(forms, counts)
                yield pa.record_batch({"cid": pa.array(cid), "forms": _binary(forms, counts * 8)})

    placed = texts.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("at"))
    sets = placed.mapInArrow(run, "cid long, forms binary").join(wanted, "cid", "left_semi")
    return sets.groupBy("cid").agg(F.first("forms").alias("forms"))  # a key may be on several rows


def _near(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(a, b, gap) of the pairs that the parity sketches don't rule out; gap: how far apart they seem, 1 at the bound.

    Cells whose parity differs are at most as many as shingles that only one of the sets has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            most = n + m - 2 * shared_least(n, m)
            apart = np.fromiter(map(_differing, batch.column("s").to_pylist(), batch.column("t").to_pylist()), dtype=np.int64, count=batch.num_rows)
            keep = pa.array(apart <= most)
            gap = pa.array(apart / np.maximum(most, 1))
            yield pa.record_batch({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "gap": gap.filter(keep)})

    left = pairs.join(kinds.select(F.col("cid").alias("a"), "n", F.col("sketch").alias("s")), "a")
    both = left.join(kinds.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t")), "b")
    return both.select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a long, b long, gap double")


def _differing(s: bytes, t: bytes) -> int:
    if len(s) < len(t):
        s, t = t, s
    x, y, bits = int.from_bytes(s, "little"), int.from_bytes(t, "little"), 8 * len(s)
    while bits > 8 * len(t):  # cells of the finer sketch fall together
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def _verified(pairs: DataFrame, texts: DataFrame, kinds: DataFrame) -> DataFrame:
    """The (a, b) whose sets are similar enough, by counting what they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            n, m = (np.fromiter((len(x) // 8 for x in side), dtype=np.int64, count=len(side)) for side in (left, right))
            forms = np.frombuffer(b"".join(left) + b"".join(right), dtype="<u8")
            row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)])
            order = np.lexsort((forms, row))
            forms, row = forms[order], row[order]
            twice = (forms[1:] == forms[:-1]) & (row[1:] == row[:-1])
            linked = pa.array(np.bincount(row[1:][twice], minlength=len(n)) >= shared_least(n, m))
            yield pa.record_batch({c: batch.column(c).filter(linked) for c in ("a", "b")})

    sets = written(_sets_of(texts, kinds, pairs), "sets")
    with_left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("forms").alias("left")), "a")
    both = with_left.join(sets.select(F.col("cid").alias("b"), F.col("forms").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _first_pairs(entries: DataFrame) -> DataFrame:
    """Each member of a list with one other: the list's member with most entries for its size, of all its lists the one met most."""
    weight = entries.groupBy("cid").agg((F.count("*") / F.first(F.col("n"))).alias("w"))
    weighed = entries.join(weight, "cid")
    lead = weighed.groupBy("token").agg(F.max(F.struct("w", F.col("cid").alias("lead"), F.col("n").alias("m"))).alias("l"))
    met = weighed.join(lead.select("token", "l.lead", "l.m"), "token").filter(
        (F.col("cid") != F.col("lead")) & (F.least("n", "m") * DEN >= F.greatest("n", "m") * NUM)
    )
    counted = met.groupBy("cid", "lead").agg(F.count("*").alias("times"))
    return counted.groupBy("cid").agg(F.max_by("lead", F.struct("times", "lead")).alias("b")).select(F.col("cid").alias("a"), "b")


def _later_pairs(entries: DataFrame, labels: DataFrame, groups: int) -> DataFrame:
    """Pairs of different components that share a list and pass the bounds on sizes and places."""
    placed = entries.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    lists = placed.groupBy("token").agg(F.count("*").alias("size"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    lists = lists.filter("l0 <> l1").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    live = placed.join(lists, "token")
    dealt = live.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    dealt = dealt.select(
        "token", "cid", "n", "pos", "label", "own",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        # short lists share a group; a pair of blocks of a long one has a group of its own
        F.when(F.col("blocks") == 1, F.pmod("token", F.lit(groups))).otherwise(F.col("token")).alias("group"),
    )

    def run(key: tuple, group: pa.Table) -> pa.Table:
        a, b = _passing(group, key[1].as_py() != key[2].as_py())
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("group", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _passing(group: pa.Table, two_blocks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's lists that the bounds don't rule out."""
    order = np.argsort(group.column("token").to_numpy(), kind="stable")
    token, cid, n, pos, label, own = (group.column(c).to_numpy()[order] for c in ("token", "cid", "n", "pos", "label", "own"))
    stop = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
    last = np.repeat(stop, np.diff(np.concatenate([[0], stop])))  # where each entry's list ends
    found = [np.zeros((0, 2), dtype=np.int64)]
    step = 1
    while True:  # every entry with the one `step` places on in its list
        i = np.flatnonzero(np.arange(len(token)) + step < last)
        if not len(i):
            break
        j = i + step
        ok = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * DEN >= np.maximum(n[i], n[j]) * NUM)
        if two_blocks:
            ok &= own[i] != own[j]
        ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= shared_least(n[i], n[j])
        found.append(np.stack([np.minimum(cid[i[ok]], cid[j[ok]]), np.maximum(cid[i[ok]], cid[j[ok]])], axis=1))
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), one row per document.

    Null and empty texts, and texts without words: no shingles, linked with nothing. Rows of one key are documents of their own.
    Null key: shingles are counted, component_id is null, and the row links nothing. Empty table: no rows.
    """
    return _grouped(docs, key, text).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, key: str, text: str) -> DataFrame:
    """`jaccard_components` with h (a hash of the text) and group (what a component is called; null for a document without links)."""
    texts = keyed_text(docs, key, text)
    facts = written(classes_of(texts), "sets")
    known = facts.filter("doc_id IS NOT NULL AND n > 0")
    common = _count_table(facts)
    boundary = _boundary(known, common)
    total = known.agg(F.sum("n")).first()[0] or 0
    groups = max(64, math.ceil(total * (1 - NUM / DEN) / LIST_ENTRIES)) if total else 1

    links = written(small_links(known, boundary), "links")
    entries = written(list_entries(texts.filter("doc_id IS NOT NULL"), common, boundary, groups), "entries")
    kinds = written(_kinds(known, entries), "kinds")
    pairs = written(_near(_first_pairs(entries), kinds), "pairs")
    links = links.unionByName(written(_verified(pairs, texts, kinds), "links"))
    labels = written(components(links), "labels")
    pairs = written(_near(_later_pairs(entries, labels, groups), kinds), "pairs")
    # first the likeliest partner of each, then all that is left between components
    best = pairs.select("a", "b", "gap").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "gap"))
    best = written(best.groupBy("a").agg(F.min_by("b", F.struct("gap", "b")).alias("b")), "best")
    links = links.unionByName(written(_verified(best, texts, kinds), "links"))
    labels = written(components(links), "labels")
    ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab"]
    apart = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b"))
    apart = written(apart.select("a", "b").join(best, ["a", "b"], "left_anti"), "apart")
    links = links.unionByName(written(_verified(apart, texts, kinds), "links"))
    labels = written(components(links), "labels")

    # copies meet their class only in the last join, which can be split where a class has many
    classes = known.groupBy("cid").agg(F.min("doc_id").alias("least"))
    classes = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classes.select("cid", "label").join(least, "label")
    rows = facts.select("doc_id", "h", "n", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("cid")).alias("cid"))
    named = rows.join(named, "cid", "left")
    return named.select("doc_id", "h", F.col("label").alias("group"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, less all but one of each group of `jaccard_components`: the one with the smallest key.

    Where a key is on rows of different texts, its text with the smallest hash stands for the group; each row belongs to the group of
    its own text. Of rows that repeat a kept key and its text one stays. Rows with a null key stay, and so does one row for every key and
    text without words (null counts as empty). Empty table: no rows. Columns may have any name.
    """
    groups = written(_grouped(docs, key, text), "groups").filter("doc_id IS NOT NULL")
    chosen = groups.filter("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "h")).alias("c")).select("c.*")
    alone = groups.filter("group IS NULL").select("doc_id", "h").distinct()
    counts = groups.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    kept, hashed = free_name(docs, "kept"), free_name(docs, "hashed")
    keys = counts.join(chosen.unionByName(alone), ["doc_id", "h"], "left_semi").select(F.col("doc_id").alias(kept), F.col("h").alias(hashed), "n")
    text_hash = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    own = (F.col(key).cast("long") == F.col(kept)) & (text_hash == F.col(hashed))
    single = docs.join(keys.filter("n = 1").select(kept, hashed), own, "left_semi")
    repeated = docs.join(keys.filter("n > 1").select(kept, hashed), own, "left_semi")
    repeated = repeated.withColumn(hashed, text_hash).dropDuplicates([key, hashed]).drop(hashed)
    return single.unionByName(repeated).unionByName(docs.filter(F.col(key).isNull()))
