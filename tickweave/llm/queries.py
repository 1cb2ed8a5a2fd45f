"""The registered query of every operator: production parameters, whole tables, results in the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.bpe import bpe_decode, bpe_encode
from tickweave.llm.centroids import lloyd
from tickweave.llm.collocations import collocations
from tickweave.llm.common import keyed_text, table
from tickweave.llm.extract import extract_text
from tickweave.llm.jaccard import jaccard_components
from tickweave.llm.langid import languages_of
from tickweave.llm.packing import pack
from tickweave.llm.quality import quality_rules, trusted_texts
from tickweave.llm.tokenfiles import read_token_files, write_token_files
from tickweave.llm.topk import largest_products
from tickweave.llm.toxicity import toxicity_scores
from tickweave.llm.urllists import filter_captures, host_of, segments_of
from tickweave.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def fold() -> Column:
    """Remainder that holds rows of a labelled table out of learning, if it is 0."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled rows that aren't held out."""
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=fold() != 0)
    return scores.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    rows = read_archives(write_archives(table(spark, sf_dir, "pages"))).filter("kind = 'record'")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(5),
        lambda k: (((strpos('0123456789abcdef', substr(hex, CAST((5 * i + k) // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - (5 * i + k) % 4 AS BIGINT)) & 1)
            << CAST(4 - k AS BIGINT))) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM p"""


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to ranked variable-length files in key order and read back."""
    read = read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in windows of 2048."""
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary(), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return largest_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op5_topk"] = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded through the pair index and decoded again."""
    coded = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, trusted_texts(keyed_text(docs, "doc_id", "text"), labels))


@query
def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against dated list entries. The pages have no dates, so both are made of them: a page is fetched on day
    (7919 * page_id) mod 1000, and puts its host, domain or first folder on the list, or takes it off, on day (104729 * page_id) mod 1000."""
    pages = table(spark, sf_dir, "pages")
    host, parts = host_of(F.col("url")), segments_of(F.col("url"))
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    named = [F.concat(F.lit("host:"), host), F.concat(F.lit("domain:"), domain), F.concat(F.lit("prefix:"), host, F.lit("/"), F.get(parts, F.lit(0)))]
    entries = pages.select(
        F.get(F.array(*named), (F.col("page_id") % 3).cast("int")).alias("key"),
        (F.col("page_id") * 104729 % 1000).cast("int").alias("day"),
        (F.floor(F.col("page_id") / 3) % 2 == 0).alias("listed"),
    )
    return filter_captures(pages.withColumn("day", (F.col("page_id") * 7919 % 1000).cast("int")), entries)


ORACLES["op7_url_lists"] = r"""
WITH p AS (
    SELECT page_id, url, CAST(page_id * 7919 % 1000 AS INTEGER) AS day, CAST(page_id * 104729 % 1000 AS INTEGER) AS entry_day,
        rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.') AS host,
        list_filter(string_split(regexp_extract(url, '^[^/?#]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS parts
    FROM pages),
e AS (
    SELECT CASE page_id % 3 WHEN 0 THEN 'host:' || host WHEN 1 THEN 'domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1)
            ELSE 'prefix:' || host || '/' || parts[1] END AS key,
        entry_day AS day, page_id // 3 % 2 = 0 AS listed
    FROM p),
d AS (SELECT key, day, bool_or(listed) AS listed FROM e WHERE key IS NOT NULL GROUP BY ALL),
k AS (
    SELECT DISTINCT page_id, day, unnest(list_concat(['host:' || host],
        list_transform(range(1, len(string_split(host, '.'))), lambda i: 'domain:' || array_to_string(list_slice(string_split(host, '.'), i, 999), '.')),
        list_transform(range(1, len(parts) + 1), lambda i: 'prefix:' || host || '/' || array_to_string(list_slice(parts, 1, i), '/')))) AS key
    FROM p WHERE host <> ''),
a AS (
    SELECT k.page_id, k.key FROM k JOIN d ON d.key = k.key AND d.day <= k.day
    GROUP BY k.page_id, k.key HAVING arg_max(d.listed, d.day)),
g AS (SELECT page_id, count(*) AS n, arg_min(key, (-length(key), key)) AS entry FROM a GROUP BY page_id)
SELECT page_id, url, day, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_active, entry FROM p LEFT JOIN g USING (page_id)"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rules and the hashed ratio for every document."""
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of dimension-sharded Lloyd over all vectors of 64 components."""
    return lloyd(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def _lloyd_sql(k: int = 8, rounds: int = 10) -> str:
    """Round after round as tables: the centroids, the assignment to them, the means."""
    floor_of_mean = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v
    QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT i, any_value(v) AS v, any_value(vec_id) AS vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.i, v.vec_id, v.v, c.c, CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY i)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT c, list({floor_of_mean} ORDER BY p) AS v FROM (
        SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range(64)) AS p, unnest(v) AS x FROM a{r}) GROUP BY c, p) GROUP BY c) m USING (c))"""
            )
    last = f"c{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN {last} c ON a.c = c.c"""
    )


ORACLES["op11_centroids"] = _lloyd_sql()


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of every language."""
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, most=2000)


ORACLES["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?
-
]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split(translate(piece, chr(9), ' '), ' '), lambda x: x <> '') AS w FROM pieces),
spans AS (SELECT lang, w, unnest([1, 2, 3]) AS m FROM words),
f AS MATERIALIZED (
    SELECT lang, m, phrase, count(*) AS f FROM (
        SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM spans)
    GROUP BY lang, m, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM cand),
cut AS (
    SELECT c.*, l.f AS l, r.f AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS score FROM cuts c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE m = 3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


def third() -> Column:
    """Remainder that holds rows out of learning their language, if it is 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


@query
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents that aren't held out."""
    found = languages_of(table(spark, sf_dir, "documents"), may_learn=third() != 1)
    return found.select("doc_id", (third() == 1).alias("held_out"), "lang_pred", "score")
