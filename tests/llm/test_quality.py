"""Plain rules against a loop, the ratio against dictionaries, and rows that the operators of filters keep."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import ODD_TEXTS, SF, documents
from tickweave.llm import quality, queries
from tickweave.llm.quality import PRIOR, cells, keep_good, quality_rules

REPEATS = [
    "a b c a b c a b c", "x y z " * 30, "one two three four one two three", "a a a a a", "l1\nl2\n l1\nl1\n\n\nl2", "%% ok & fine\n" * 60,
    " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i % 61}" for i in range(400)),
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rules_and_ratio(spark):
    texts = [*ODD_TEXTS, *REPEATS, "same words", "same words"]
    keys = [None, *range(len(texts) - 2), 4]
    docs = documents(spark, texts, keys).repartition(3)
    trusted = documents(spark, [REPEATS[6], "one two three", None])
    got = quality_rules(docs, trusted).collect()
    assert Counter(tuple(r)[1:7] for r in got) == Counter(base(t) for t in texts)

    fallen = {r.text: r.c for r in docs.unionByName(trusted).select("text", cells(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    raw, good = Counter(), Counter()
    for t in texts:
        raw.update(fallen[t])
    for t in (REPEATS[6], "one two three", None):
        good.update(fallen[t])
    ratio = lambda c: math.log((good[c] + PRIOR) / (raw[c] * good.total() / raw.total() + PRIOR))
    want = sorted((base(t)[:5], sum(map(ratio, fallen[t])) / len(fallen[t]) if fallen[t] else 0.0, base(t)[5]) for t in texts)
    have = sorted((tuple(r)[1:6], r.ratio, r.base_failed, r.kept) for r in got)
    for (a, x, failed), (b, y, failed2, kept) in zip(want, have, strict=True):
        assert a == b and abs(x - y) < 1e-9 and failed == failed2 and kept == (not failed and y >= -0.1)
    rows = keep_good(docs, trusted)
    assert rows.columns == docs.columns and rows.count() == sum(r.kept for r in got)
    # a filter on the result doesn't change it
    assert quality_rules(docs, trusted).filter("kept AND n_words > 60").count() == sum(r.kept and r.n_words > 60 for r in got)


def test_long_texts_compare_whole_hashes(spark, monkeypatch):
    # one repeated window among many words; and every text by the way of long ones
    text = " ".join(f"w{i}" for i in range(30_000)) + " w5 w6 w7"
    assert [r.n_repeat_words for r in quality_rules(documents(spark, [text]), documents(spark, [])).collect()] == [6]
    monkeypatch.setattr(quality, "PACKED", 0)
    texts = [*ODD_TEXTS, *REPEATS]
    got = quality_rules(documents(spark, texts), documents(spark, [])).collect()
    assert Counter(tuple(r)[1:7] for r in got) == Counter(base(t) for t in texts)


def test_texts_are_cut_by_patterns(spark):
    docs = documents(spark, [*ODD_TEXTS, *REPEATS, "a$$$ b--c\x0bd\x0ce\u00a0f\u2028g ٣x é\u0301"])
    text = F.coalesce("text", F.lit(""))
    spaced = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"([^\p{L}\p{N}\s]+)", " $1 "), r"[ \t\n\x0B\f\r]+", " ")), " ")
    cell = lambda h: h.bitwiseAND(F.lit(quality.CELLS - 1).cast("long")).cast("int")
    alone = F.transform(F.array_remove(spaced, ""), lambda w: cell(F.xxhash64(w)))
    for r in docs.select(cells(text).alias("c"), alone.alias("w")).collect():
        assert r.c[: len(r.w)] == r.w and len(r.c) == max(2 * len(r.w) - 1, 0)
    # letter by letter through a map is slow
    plan = docs.select(cells(text), quality.base_counts(text))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan


def test_empty(spark):
    assert quality_rules(documents(spark, []), documents(spark, [])).count() == 0
    got = quality_rules(documents(spark, ["a b"]), documents(spark, [])).collect()
    assert [(r.ratio, r.kept) for r in got] == [(0.0, False)]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_quality(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in got if labels.get(r.doc_id) is not None and not r.base_failed]
    assert sum(kept for q, kept in judged if q == 1) >= 0.97 * sum(q for q, _ in judged)
