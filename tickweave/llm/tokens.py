"""Whole texts to ids with the `tokenizers` library, each distinct run of characters between blanks encoded once.

The pre-tokenizer of the vocabularies used here never joins characters across a blank, so a text's ids are those of its runs,
one after the other. A run goes through the library's whole pipeline, except for plain lower-cased words: the normalizer would
leave them as they are, so they go to the library's model. Texts that spell a special token go to the library as a whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickweave.llm.bpe import byte_letters
from tickweave.llm.common import slices

#: distinct pieces of runs that a worker remembers before it forgets the rarer ones; bounds memory, not results
REMEMBERED = 400_000
#: bytes of text that are looked at together
TOGETHER = 4_000_000
_id_of = attrgetter("id")
#: a word in lower case, and signs behind it but apostrophes, which begin contractions: the pre-tokenizer cuts between the two
_WORD = r"^(?P<word>[a-zß-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"
#: characters after the Latin blocks: they may not be in normal form, or lower-case by context
_beyond_latin = re.compile("[ɐ-\U0010ffff]")


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype="<u4", count=int(counts.sum())), counts


class Encoder:
    """`encode_column(texts)`: the ids of each text. Of pieces that were seen before, `known`, their ids lie in `ids`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.letters = {b: c for b, c in enumerate(byte_letters()) if chr(b) != c}
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = "|".join(map(re.escape, special))
        self._forget()

    def _forget(self) -> None:
        """All but the empty piece, whose number is 0."""
        self.known = pa.array([""])
        self.ids, self.counts, self.starts = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _add(self, pieces: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """New pieces, numbered after those before."""
        self.known = pa.concat_arrays([self.known, pieces])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])

    def _learn(self, pieces: pa.Array) -> None:
        """Encode pieces not seen before, Latin ones in lower case. A plain word goes to the library's model as it is."""
        letters, tokenize = self.letters, self.library.model.tokenize
        ascii_words = pc.match_substring_regex(pieces, "^[a-z]+$")
        plain = pieces.filter(ascii_words)
        found = list(map(tokenize, plain.to_pylist()))
        rest = pieces.filter(pc.invert(ascii_words)).to_pylist()
        latin = [w for w in rest if w.isalpha() and _beyond_latin.search(w) is None and w == w.lower()]
        found += [tokenize(w.encode().decode("latin-1").translate(letters)) for w in latin]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(map(_id_of, chain.from_iterable(found)), dtype="<u4", count=int(counts.sum()))
        self._add(pa.concat_arrays([plain, pa.array(latin, type=pieces.type)]), ids, counts)
        other = list(set(rest).difference(latin))
        encoded = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)]
        self._add(pa.array(other, type=pieces.type), *_flat(encoded))

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of different pieces; new ones are learned."""
        found = pc.index_in(pieces, value_set=self.known)
        if len(self.known) > REMEMBERED:  # what this part of the texts has is common enough to keep
            keep = pc.and_(found.is_valid(), pc.not_equal(pieces, ""))
            old = found.filter(keep).to_numpy()
            ids, counts = self._gathered(old), self.counts[old]
            self._forget()
            self._add(pieces.filter(keep), ids, counts)
            found = pc.index_in(pieces, value_set=self.known)
        if found.null_count:
            self._learn(pieces.filter(found.is_null()))
            found = pc.index_in(pieces, value_set=self.known)
        return found.to_numpy()

    def _gathered(self, codes: np.ndarray) -> np.ndarray:
        """Ids of known pieces, one after the other."""
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        at = np.repeat(self.starts[codes] - ends + counts, counts)
        at += np.arange(len(at))
        return self.ids[at]

    def encode(self, texts: list[str], end: int | None = None) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for ids, counts in self.encode_column(pa.array(texts, type=pa.string()), end):
            ends = np.cumsum(counts)
            yield from (ids[i:j].tobytes() for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True))

    def encode_column(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts side by side and how many each has, each with `end` behind it. Looks ahead a few million characters at a
        time, so that a run is looked up once in all of them and new runs go to the library together."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, TOGETHER + (sizes[at - 1] if at else 0), side="right")))
            yield self._together(texts.slice(at, stop - at), end)
            at = stop

    def _together(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Many small objects come and go, none in a cycle: the collector would look at them in vain."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, end)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, str] = {}
        if self.special:
            whole = {i: texts[i].as_py() for i in np.flatnonzero(pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), list(whole))), pa.scalar("", type=texts.type), texts)
        # what the normalizer does to Latin texts, and all it does
        if pc.all(pc.string_is_ascii(texts)).as_py():
            texts = pc.ascii_lower(texts)
        else:
            texts = pa.array([t.lower() if t.isascii() or _beyond_latin.search(t) is None else t for t in texts.to_pylist()], type=texts.type)
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        n = 2 * np.diff(parts.offsets.to_numpy())
        runs = parts.flatten().dictionary_encode()
        # two pieces of each run: a word and the signs behind it, or the run and nothing
        own = runs.dictionary
        cut = pc.extract_regex(own, _WORD)
        word, signs = (pc.if_else(cut.is_valid(), pc.struct_field(cut, k), x) for k, x in ((0, own), (1, pa.scalar(""))))
        pieces = pa.concat_arrays([word, signs]).dictionary_encode()
        codes = self._codes(pieces.dictionary)[pieces.indices.to_numpy()].reshape(2, -1)
        codes = codes[:, runs.indices.to_numpy()].T.ravel()
        ids, counts, starts = self.ids, self.counts, self.starts
        if whole or end is not None:  # pieces of this part alone
            first, rows = len(counts), list(whole)
            self._add(pa.array([], type=pa.string()), *_flat([self.library.encode(t, add_special_tokens=False).ids for t in whole.values()] + [[end]] * (end is not None)))
            codes[(np.cumsum(n) - n)[rows]] = first + np.arange(len(rows))
            if end is not None:
                codes, n = np.insert(codes, np.cumsum(n), first + len(rows)), n + 1
        out, sizes = self._gathered(codes), self.counts[codes]
        self.ids, self.counts, self.starts = ids, counts, starts
        return out, np.add.reduceat(sizes, np.cumsum(n) - n) if len(n) else n


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column side by side, and where each row ends, 0 first."""
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary: later tasks find its runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SCHEMA = "part int, row long, doc_id long, before long, n_tokens long, ids binary"


def tokenized(texts: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, text) to ids with `end_id` appended: `part` and `row` number the rows of each task, `before` counts the
    ids of the same task's earlier rows. Write the result before it is used twice: a task's rows are numbered as it reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, before = TaskContext.get().partitionId(), 0, 0
        enc = encoder(path)
        for batch in slices(batches):
            done, doc_ids = 0, batch.column(0)
            for ids, n in enc.encode_column(batch.column(1), end_id):
                ends = np.cumsum(n)
                offsets = pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32))
                yield pa.record_batch(
                    {
                        "part": pa.array(np.full(len(n), part, dtype=np.int32)),
                        "row": pa.array(np.arange(row, row + len(n))),
                        "doc_id": doc_ids.slice(done, len(n)),
                        "before": pa.array(before + ends - n),
                        "n_tokens": pa.array(n),
                        "ids": pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids)]),
                    }
                )
                row, before, done = row + len(n), before + int(ends[-1]), done + len(n)

    return texts.select("doc_id", "text").mapInArrow(run, SCHEMA)


def prefix_sums(totals: DataFrame, order: str, count: str) -> DataFrame:
    """(order, base): the sum of `count` over all smaller `order`. For one row per task or file, never for rows of data."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(order, F.coalesce(F.sum(count).over(before), F.lit(0)).alias("base"))


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of several rows, and how many each row has."""
    data, ends = bytes_of(column)
    return np.ascontiguousarray(data).view("<u4"), np.diff(ends) // 4
