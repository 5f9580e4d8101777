"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.llm import (
    codes,
    decontaminate,
    graysearch,
    lexsearch,
    licenses,
    linededup,
    neardup,
    packing,
    quality,
    sharding,
    toxicity,
    urlfilter,
    warc,
)
from visitflow.llm.shared import table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")

Query = Callable[[SparkSession, str], DataFrame]


def usable_labels(labels: DataFrame) -> DataFrame:
    """The labels that models may learn from: two thirds, by the checksum of the id."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(docs, VOCABULARY, digest=True)


# --- fixed values: licence statements ------------------------------------------------------------------------------
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("all-rights-reserved", "All rights reserved."),
)
# --- end of fixed values -------------------------------------------------------------------------------------------
LICENSE_SHARE = 0.1  # of a document's words that makes it the licence file of its directory


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/<thousand>/<id>``."""
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    values = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
    templates = spark.sql(f"SELECT * FROM VALUES {values} AS templates(license, text)")
    return licenses.scanned(docs, templates, share=LICENSE_SHARE).select(
        "row.doc_id", "row.path", "license", "similarity", "how", "from_directory")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= quality.KEEP)).alias("kept"),
        F.round("posterior", 4).alias("posterior"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.deduplicated(docs).select(
        "row.doc_id",
        "n_lines",
        F.size("gone").alias("n_removed"),
        F.array_join("gone", ",").alias("removed_lines"),
        F.crc32(F.coalesce("clean", F.lit("")).cast("binary")).alias("clean_crc32"),
        "empty",
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_class", "first")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, usable_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    return toxicity.scored(docs, model).select(
        "row.doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.matched(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# --- fixed values: the rules of the URL query ----------------------------------------------------------------------
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# --- end of fixed values -------------------------------------------------------------------------------------------


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, listing).select("row.page_id", "host", "path", "rule", "verdict")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graysearch.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "n_nodes")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexsearch.ranked(docs, table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.coded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    rows = codes.with_group_error(found.rows, F.col("row.label"))
    digits = F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return rows.select(
        "row.vec_id", F.array_join(digits, "").alias("code"), "error", "label_error",
        F.lit(found.digest()).alias("codebooks_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_url_filter": op10_url_filter,
    "op11_simhash": op11_simhash,
    "op12_lexical_search": op12_lexical_search,
    "op13_vector_codes": op13_vector_codes,
}



def _quality_sql() -> str:
    """The measures by plain regular expressions, and the same fit as one table for each of its steps."""
    rules = quality.RULES
    spaces = "[^\\x20\\x09-\\x0D]"

    def value(measure: str) -> str:
        if measure.startswith("abs("):
            return "abs(word_chars / nullif(n_words, 0) - 5.2)"
        top, bottom = measure.split(" / ")
        return f"{top} / nullif({bottom}, 0)"

    digits = ", ".join(
        f"CASE WHEN {value(m)} >= {bad} THEN 0 WHEN {value(m)} <= {good} THEN 2 ELSE 1 END AS d{j}"
        for j, (_, m, bad, good) in enumerate(rules)
    )
    names = ", ".join(f"d{j}" for j in range(len(rules)))
    odds = "ln(share) - ln(1 - share) + " + " + ".join(
        f"ln(CASE d{j} WHEN 0 THEN g{j}_0 WHEN 1 THEN g{j}_1 ELSE g{j}_2 END)"
        f" - ln(CASE d{j} WHEN 0 THEN b{j}_0 WHEN 1 THEN b{j}_1 ELSE b{j}_2 END)" for j in range(len(rules))
    )
    posterior, start, weight = f"1 / (1 + exp(-({odds})))", quality.START, quality.WEIGHT
    fitted = ", ".join(
        f"(sum(CASE WHEN d{j} = {v} THEN f * {q} ELSE 0 END) + {weight * start[c][v]!r}) / (sum(f * {q}) + {weight}) "
        f"AS {c[0]}{j}_{v}"
        for c, q in (("good", "q"), ("bad", "(1 - q)")) for j in range(len(rules)) for v in range(3)
    )
    first = ", ".join(f"{start[c][v]} AS {c[0]}{j}_{v}" for c in start for j in range(len(rules)) for v in range(3))
    steps = "".join(
        f""", s{k + 1} AS MATERIALIZED (
  SELECT (sum(f * q) + {weight * quality.GOOD_SHARE!r}) / {1 + weight} AS share, {fitted}
  FROM (SELECT *, {posterior} AS q FROM seen, s{k})
)"""
        for k in range(quality.ROUNDS)
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '{spaces}+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{spaces}')) AS l FROM texts
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS three FROM parts, unnest(range(1, len(w) - 1)) AS r(i)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM repeated, unnest([i, i + 1, i + 2]) AS r(j) GROUP BY doc_id
), measures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(regexp_extract_all(t, '!')) AS n_exclamations, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals
  FROM parts LEFT JOIN covered USING (doc_id)
), voted AS MATERIALIZED (SELECT *, {digits} FROM measures),
seen AS MATERIALIZED (SELECT {names}, count(*) / (SELECT count(*) FROM voted) AS f FROM voted GROUP BY {names}),
s0 AS (SELECT {quality.GOOD_SHARE} AS share, {first}){steps},
judged AS (
  SELECT *, {posterior} AS posterior, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM voted, s{quality.ROUNDS}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND posterior >= {quality.KEEP} AS kept, round(posterior, 4) AS posterior
FROM judged
"""


def _codes_sql() -> str:
    """Parts in long form; every round is one table of assignments and one of entries."""
    n, scale, parts = codes.ENTRIES, codes.SCALE, codes.PARTS

    def placed(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, p, min(d * {n} + e) % {n} AS e, min(d * {n} + e) // {n} AS d FROM (
    SELECT vec_id, x.p, e, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d
    FROM x JOIN b{k} ON x.p = b{k}.p AND x.k = b{k}.k GROUP BY vec_id, x.p, e
  ) GROUP BY vec_id, p
)"""

    steps = ", ".join(
        placed(k) + f""", b{k + 1} AS MATERIALIZED (
  SELECT b{k}.p, b{k}.e, b{k}.k, coalesce(m.y, b{k}.y) AS y FROM b{k} LEFT JOIN (
    SELECT x.p, a{k}.e, x.k, CAST(floor(sum(x) / count(*)) AS BIGINT) AS y
    FROM x JOIN a{k} ON x.vec_id = a{k}.vec_id AND x.p = a{k}.p GROUP BY x.p, a{k}.e, x.k
  ) AS m ON m.p = b{k}.p AND m.e = b{k}.e AND m.k = b{k}.k
)"""
        for k in range(codes.ROUNDS)
    )
    last = codes.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(embedding) // {parts}) AS p, (i - 1) % (len(embedding) // {parts}) AS k,
    CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, unnest(range(1, len(embedding) + 1)) AS r(i)
), b0 AS MATERIALIZED (
  SELECT p, e, k, x AS y FROM x JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {n}
  ) USING (vec_id)
), {steps}, {placed(last)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a{last} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, k)) FROM b{last}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_9 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TERMS_12 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op3_quality": _quality_sql(),
    "op4_warc": """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM payloads),
winners AS (SELECT payload_digest, max(page_id) AS winner FROM digests WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN winner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN winner <> page_id THEN winner END AS refers_to
FROM digests LEFT JOIN winners USING (payload_digest)
""",
    "op9_decontamination": f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_9} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS window
  FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce({_WORDS_9}, []) AS w FROM documents
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS window
  FROM docs, (SELECT DISTINCT n FROM windows) AS sizes, unnest(range(1, len(w) - n + 2)) AS r(i)
), hits AS (
  SELECT doc_id, i, places.n, item_id FROM places JOIN windows ON places.window = windows.window
  AND places.n = windows.n
), words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op10_url_filter": f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
urls AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), fits AS (
  SELECT page_id, rules.host || rules.path AS rule, verdict FROM parts JOIN rules
  ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
""",
    "op12_lexical_search": f"""
WITH items AS (
  SELECT DISTINCT item_id, unnest(list_distinct({_TERMS_12})) AS term FROM benchmark WHERE text IS NOT NULL
), terms AS (
  SELECT doc_id, unnest({_TERMS_12}) AS term FROM documents WHERE text IS NOT NULL
), counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
sizes AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
lengths AS (SELECT doc_id, 10 + (90 * n * docs) // all_terms AS m FROM sizes, whole),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, whole
  GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
""",
    "op13_vector_codes": _codes_sql(),
}
