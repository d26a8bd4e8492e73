"""The registered queries of this subpackage and their SQL, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.bpe import round_trip_digests
from meshloom.llm.collocations import collocations
from meshloom.llm.common import fresh_dir, table
from meshloom.llm.html_text import visible_texts
from meshloom.llm.jaccard import jaccard_components
from meshloom.llm.minhash import edited_fingerprints
from meshloom.llm.negatives import hard_negatives
from meshloom.llm.packing import packed
from meshloom.llm.quality import quality_verdicts
from meshloom.llm.sharding import sharded
from meshloom.llm.token_counts import token_counts
from meshloom.llm.token_file import token_index, write_tokens
from meshloom.llm.toxicity import toxicity_scores
from meshloom.llm.warc import read_archives, write_archives

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), WORD_BPE, capacity=2048, end_id=0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "tokens")
    return token_index(spark, folder, write_tokens(table(spark, sf_dir, "documents"), WORD_BPE, folder, end_id=1))


def op9_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visible_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), min_words=2, max_words=3, min_count=10, top=2000)


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), shards=8)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip, op2_warc_archives, op3_quality_ledger, op4_jaccard_components, op5_fingerprints, op6_toxicity, op7_best_fit_packing, op8_token_files, op9_visible_text, op10_token_counts,
        op11_collocations, op12_virtual_slots, op13_hard_negatives,
    )
}

#: Payloads, digests and which record stands for equal ones.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""

#: Measurements, rules and the two policies, word by word.
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, i - coalesce(before, i - 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters,
             coalesce(c.n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
              + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
              + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_upper > 6 * n_letters THEN 32 ELSE 0 END) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_letters, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits, 'default-1' AS policy,
       CASE failed_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'word_length' WHEN 32 THEN 'upper_case' END AS alone,
       count(*) OVER (PARTITION BY failed_bits) AS alike
FROM b
"""

#: Every run of words of every piece counted, all cuts and all longer runs compared.
COLLOCATIONS_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, a, count(*) AS f FROM (SELECT lang, unnest(words) AS a FROM w) GROUP BY lang, a HAVING count(*) >= 10),
g2 AS (SELECT lang, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) >= 2),
f2 AS (SELECT lang, words[i] AS a, words[i + 1] AS b, count(*) AS f FROM g2 GROUP BY ALL HAVING count(*) >= 10),
g3 AS (SELECT lang, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3),
f3 AS (SELECT lang, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, count(*) AS f FROM g3 GROUP BY ALL HAVING count(*) >= 10),
cut AS (
    SELECT x.lang, x.a || ' ' || x.b AS phrase, x.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 x JOIN f1 l ON l.lang = x.lang AND l.a = x.a JOIN f1 r ON r.lang = x.lang AND r.a = x.b
    UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 1, l.f, r.f FROM f3 x JOIN f1 l ON l.lang = x.lang AND l.a = x.a JOIN f2 r ON r.lang = x.lang AND r.a = x.b AND r.b = x.c
    UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 2, l.f, r.f FROM f3 x JOIN f2 l ON l.lang = x.lang AND l.a = x.a AND l.b = x.b JOIN f1 r ON r.lang = x.lang AND r.a = x.c),
scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, a || ' ' || b AS phrase, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3) GROUP BY lang, phrase),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""

#: Every anchor against every row.
NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""

#: The other queries need a tokenizer, a trained model, hashes that SQL lacks or a search too slow for it on whole tables.
ORACLES: dict[str, str] = {"op2_warc_archives": WARC_SQL, "op3_quality_ledger": QUALITY_SQL, "op11_collocations": COLLOCATIONS_SQL, "op13_hard_negatives": NEGATIVES_SQL}
