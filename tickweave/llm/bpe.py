"""Byte-pair encoding with a pair occurrence index, and decoding.

All distinct words of a batch are laid end to end as symbols. The index maps each pair that has a merge rank to every position
where it starts. Ranks are applied in ascending order, each to all its positions at once; the neighbours of what was
merged form new pairs, whose positions join the lists of their ranks.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickweave.llm.common import keyed_text, slices

#: distinct runs between blanks that a worker remembers before it starts anew; bounds memory, not results
REMEMBERED = 250_000
#: ids or characters in one Arrow batch, about
BATCH_BYTES = 8 << 20
#: characters that are looked at together, so that their new words share one index
TOGETHER = 5_000_000

# fixed values: how the vocabularies of this kind cut a text into words, and mark a word's end
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"
#: first character after the Latin blocks, which are in normal form as they are
LATIN_END = "ɐ"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairIndexCoder:
    """Vocabulary and merges of a file, and the encoder that applies them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.rules = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.names: list[str] = [""] * (max([*vocabulary.values(), *added.values()]) + 1)
        for token, i in [*vocabulary.items(), *added.items()]:
            self.names[i] = token
        self.inner = np.array([vocabulary[c] for c in byte_letters()], dtype=np.int64)
        self.last = np.array([vocabulary[c + WORD_END] for c in byte_letters()], dtype=np.int64)
        self.base = len(self.names)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.base + self.right
        self.rank_order = np.argsort(keys, kind="stable")
        self.sorted_keys = keys[self.rank_order]
        self.pattern = regex.compile(WORD_PATTERN)
        self.known: dict[str, bytes] = {"": b""}

    # words to ids

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """Merge rank of each pair key, -1 for none."""
        at = np.minimum(np.searchsorted(self.sorted_keys, keys), len(self.sorted_keys) - 1)
        return np.where(self.sorted_keys[at] == keys, self.rank_order[at], -1)

    def words_to_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, all merged through one index of their pairs."""
        if not words:
            return []
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        symbol = self.inner[text]
        symbol[ends - 1] = self.last[text[ends - 1]]
        following = np.arange(1, len(text) + 1)
        following[ends - 1] = -1
        before = np.arange(-1, len(text) - 1)
        before[np.concatenate([[0], ends[:-1]])] = -1

        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Positions whose pair may have a rank join that rank's list."""
            rank = self._ranks(symbol[at] * self.base + symbol[following[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
            for part, r in zip(np.split(at, starts[1:]), rank[starts].tolist(), strict=True) if len(rank) else ():
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heapq.heappush(active, r)

        note(np.flatnonzero(following >= 0))
        while active:
            r = heapq.heappop(active)
            lists = places.pop(r)
            at = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
            after = following[at]
            holds = (after >= 0) & (symbol[at] == self.left[r])
            holds &= symbol[after] == self.right[r]
            at, after = at[holds], after[holds]
            if len(lists) > 1 and len(at) > 1:
                once = np.concatenate([[True], at[1:] != at[:-1]])
                at, after = at[once], after[once]
            if self.left[r] == self.right[r] and len(at) > 1:  # of pairs that overlap, every second from the left
                joined = np.concatenate([[False], after[:-1] == at[1:]])
                n = np.arange(len(at))
                alternate = (n - np.maximum.accumulate(np.where(joined, 0, n))) % 2 == 0
                at, after = at[alternate], after[alternate]
            if not len(at):
                continue
            then = following[after]
            symbol[at] = self.merged[r]
            symbol[after] = -1
            following[at] = then
            more = then >= 0
            before[then[more]] = at[more]
            left = before[at]
            note(np.unique(np.concatenate([left[left >= 0], at[more]])))

        kept = symbol >= 0
        ids = symbol[kept].astype("<u4").tobytes()
        stops = (np.cumsum(kept)[ends - 1] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    # texts to ids

    def _pieces(self, run: str) -> list[bytes]:
        """Lower-cased words of a run. Beyond Latin the library's normalizer and word rules say what a letter is: versions of
        Unicode differ in that."""
        low = run.lower()
        if low and max(low) >= LATIN_END:
            words = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(run))
            return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in words]
        return [low.encode()] if low.isalpha() else [w.encode() for w in self.pattern.findall(low)]

    def _learn(self, runs: set[str]) -> None:
        pieces = {run: self._pieces(run) for run in runs}
        words = list({w for p in pieces.values() for w in p})
        ids = dict(zip(words, self.words_to_ids(words), strict=True))
        self.known.update((run, ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p])) for run, p in pieces.items())

    def _segments(self, text: str) -> list[str | int]:
        """Stretches of ordinary text, and the ids of special tokens between them."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode(part)
                part, size = [], 0
        yield from self._encode(part)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        cut = [[s if isinstance(s, int) else s.replace("\n", " ").split(" ") for s in self._segments(t)] for t in texts]
        new: set[str] = set()
        for segments in cut:
            for s in segments:
                if not isinstance(s, int):
                    new.update(s)
        self._learn(new.difference(self.known))
        known = self.known
        for segments in cut:
            if len(segments) == 1:
                yield b"".join([known[x] for x in segments[0]])
            else:
                yield b"".join(s.to_bytes(4, "little") if isinstance(s, int) else b"".join([known[x] for x in s]) for s in segments)

    def decode(self, ids: bytes) -> str:
        """Token names with a blank between, as a vocabulary file without a decoder says; ids without a name give nothing."""
        names = self.names
        return " ".join([names[i] for i in memoryview(ids).cast("I") if i < len(names)])


_coders: dict[str, PairIndexCoder] = {}


def coder(path: str) -> PairIndexCoder:
    if path not in _coders:
        _coders[path] = PairIndexCoder(path)
    return _coders[path]


def _batches(doc_ids: pa.Array, values: Iterator, name: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    done, held, size = 0, [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= BATCH_BYTES or done + len(held) == len(doc_ids):
            yield pa.record_batch({"doc_id": doc_ids.slice(done, len(held)), name: pa.array(held, type=kind)})
            done, held, size = done + len(held), [], 0


def bpe_encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every whole text.

    Null and empty texts: no ids. Null and repeated keys: each row on its own. Empty table: no rows. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from _batches(batch.column(0), coder(vocabulary).encode(batch.column(1).to_pylist()), "ids", pa.binary())

    return keyed_text(docs, key, text).mapInArrow(run, "doc_id long, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, decoded text of encoded documents. Null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(1, 2 * batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [None if x is None else coder(vocabulary).decode(x) for x in part.column("ids").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "decoded": pa.array(texts, type=pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
