"""The thin queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, chat_format, divergence, embedding_join, filter_audit, mixing, ngram_join, packing, quality_rules, sharding, suffix_dedup, toxicity, warc
from .common import read_table

PLANTED_TURN = r"\### Assistant: </turn> ok"
#: Production weights of the mix: (domain,) and (domain, language); all else has weight 1.
MIX_WEIGHTS = {("web",): 1.0, ("books",): 2.0, ("news",): 1.5, ("code",): 1.0, ("books", "en"): 2.0}
MIX_DOMAINS = ("web", "books", "news", "code")


def mix_levels() -> dict:
    """Domain (sources dealt over four by their number), language, source."""
    number = F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    domain = F.element_at(F.array(*[F.lit(d) for d in MIX_DOMAINS]), (number % len(MIX_DOMAINS) + 1).cast("int"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows become records of mixed layouts; what is formatted is what fingerprints and mappings make of these."""
    rows = read_table(spark, sf_dir, "conversations")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_TURN).alias("text"),
    )
    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    turns = chat_format.canonical_rows(chat_format.mixed_records(whole))
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(turns)))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + 8 AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("posterior"), *[f"vote_{r.name}" for r in quality_rules.RULES],
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
"""


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures_of_pages(read_table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "url", F.unix_seconds("ts").alias("at"), "response_id", F.unix_seconds("response_ts").alias("response_at"), "verdict", lines.alias("headers"))


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS body, strlen(html)::VARCHAR AS n,
    1704067200 + (page_id * 7919 % 525600) * 60 AS first FROM pages
), raw AS (
  SELECT 'r' || page_id AS id, 'response' AS kind, url AS uri, first AS ts, '"' || body || '"' AS etag, first AS modified, n, 'max-age=60' AS cache FROM p
  UNION ALL
  SELECT 's' || page_id, 'response', url, first + (page_id % 50 + 1) * 86400, '"' || substr(body, 1, 16) || '"', first + (page_id % 50 + 1) * 86400, n, 'no-cache' FROM p WHERE page_id % 5 = 0
  UNION ALL
  SELECT 'v' || page_id, 'revisit',
    CASE WHEN page_id % 4 = 0 THEN 'HTTP://' || upper(regexp_extract(url, '^https?://([^/?#]*)', 1)) || regexp_replace(url, '^https?://[^/?#]*', '') || '#seen' ELSE url END,
    first + page_id % 97 * 3600,
    CASE WHEN page_id % 10 = 2 THEN '"stale"' WHEN page_id % 10 <> 4 THEN '"' || body || '"' END,
    CASE WHEN page_id % 10 = 4 THEN first END, NULL, 'max-age=600' FROM p WHERE page_id % 2 = 0
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(uri), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM raw
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\d*\.|:(?:80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda f: f <> '' AND NOT regexp_matches(f, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))), '&') AS query FROM bare
), c AS (
  SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM parts
), f AS (
  SELECT v.id, v.url, v.ts, v.etag, v.modified, v.cache,
    max(struct_pack(ts := r.ts, id := r.id, etag := r.etag, modified := r.modified, n := r.n, cache := r.cache)) AS x
  FROM c v LEFT JOIN c r ON r.kind = 'response' AND r.url = v.url AND r.ts < v.ts
  WHERE v.kind = 'revisit' GROUP BY ALL
), j AS (
  SELECT id, url, ts, ts AS seen, etag, modified, cache, x.id AS rid, x.ts AS rts, x.etag AS retag, x.modified AS rmod, x.n AS rn FROM f
), k AS (
  SELECT *, CASE WHEN rid IS NULL THEN 'missing' WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN etag = retag THEN 'etag' ELSE 'changed' END
    WHEN modified IS NOT NULL AND rmod IS NOT NULL THEN CASE WHEN modified = rmod THEN 'last_modified' ELSE 'changed' END ELSE 'unchecked' END AS verdict FROM j
)
SELECT id AS record_id, url, ts::BIGINT AS at, rid AS response_id, rts::BIGINT AS response_at, verdict,
  CASE WHEN verdict IN ('etag', 'last_modified') THEN
    'cache-control: max-age=600' || coalesce(chr(10) || 'content-length: ' || rn, '') || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') END AS headers
FROM k
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.93)


OP8_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), r AS (
  SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v
), m AS (
  SELECT v, min(c) AS c FROM r GROUP BY v
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
FROM embeddings e JOIN m ON m.v = e.vec_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    away = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", away.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mixing.mix(docs, mix_levels(), budget=0.8, weights=MIX_WEIGHTS, max_epochs=2)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens; documents and attention are as many as these allow, so that they cost no sequence, and the norm weighs tokens above all."""
    return best_fit.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), tokens=2048, weights=(1.0, 0.001, 0.001))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=30, top=50)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term
), f AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own, sum(n) OVER (PARTITION BY lang, term) AS n_all, sum(n) OVER (PARTITION BY lang) AS whole FROM f
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), p AS (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000 * (s.n + 5)::HUGEINT) // (s.own + 5 * v.v)::HUGEINT AS p, 1 + (1000000000 * (s.n_all + 5)::HUGEINT) // (s.whole + 5 * v.v)::HUGEINT AS q
  FROM s JOIN v ON v.lang = s.lang
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN (
    SELECT y.lang, y.source, z.source AS item, sum(abs(y.p - z.p)) AS value FROM p y JOIN p z ON z.lang = y.lang AND z.term = y.term AND z.source <> y.source GROUP BY y.lang, y.source, z.source
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return filter_audit.audit(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS mask
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT c.part, s.filter_order, s.step, s.f,
    sum(CASE WHEN translate(mask, before || f, '') = mask THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') = mask THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') <> mask THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') = mask THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(mask, f) AND translate(mask, before, '') = mask THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY c.part, s.filter_order, s.step, s.f
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM r
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_packing": op7_packing,
    "op8_embedding_join": op8_embedding_join,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_interaction": op13_filter_interaction,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op5_ngram_join": OP5_SQL, "op6_warc_revisits": OP6_SQL, "op8_embedding_join": OP8_SQL, "op12_source_divergence": OP12_SQL, "op13_filter_interaction": OP13_SQL}
