"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def tokenizer_file() -> tuple[str, str]:
    """The rank file and the pattern of the public tokenizer that this machine offers."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(C.table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages; a page's fetch time follows from its id, and the dated list from the hosts' digests."""
    from . import urls

    pages = C.table(spark, sf_dir, "pages")
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    fetched = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("page_id") * 7_919) % 730 * 86_400 + F.col("page_id") % 86_400)
    out = urls.evaluate(pages.select("page_id", "url", fetched.alias("fetched_at")), urls.sample_list(hosts))
    return out.withColumn("listed_at", F.date_format("listed_at", "yyyy-MM-dd"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode_decode(C.table(spark, sf_dir, "documents"), *tokenizer_file())


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.deduplicate(C.table(spark, sf_dir, "documents"), keep_text=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    hits = decontaminate.scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", F.col("n_words").cast("long"), F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(C.table(spark, sf_dir, "documents")).drop("detections")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pst

    return pst.score_texts(C.table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = C.table(spark, sf_dir, "documents")
    out = langid.identify(docs, *langid.learn(docs))
    return out.select("doc_id", (C.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    out = media.media_columns(C.table(spark, sf_dir, "documents"), f"{C.shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    out = quality.classify(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import credentials as S

    docs = C.table(spark, sf_dir, "documents")
    out = S.scan(docs, S.learn(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*S.KINDS))
    return out.select("doc_id", *map(count, S.KINDS), F.sha2(S.joined(base), 256).alias("base_sha256"), S.joined(F.col("spans")).alias("spans"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(C.table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_suffix_array": op4_suffix_array,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_suffix_tree": op7_suffix_tree,
    "op8_language": op8_language,
    "op9_media_columns": op9_media_columns,
    "op10_quality": op10_quality,
    "op11_secrets": op11_secrets,
    "op12_source_divergence": op12_source_divergence,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Words as the contracts define them, in DuckDB's SQL.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_jaccard_join": f"""
WITH RECURSIVE doc AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(len(w), 5) + 1)) AS i FROM doc WHERE len(w) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE c >= 0.8 * (s.n + t.n - c) - 1e-9),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS n FROM link GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM class LEFT JOIN degree USING (doc_id)
""",
    "op2_url_filters": r"""
WITH page AS (SELECT page_id, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', '')) AS h,
       regexp_extract_all(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]+') AS seg,
       to_timestamp(1704067200 + (page_id * 7919) % 730 * 86400 + page_id % 86400) AS t FROM pages),
capture AS (SELECT page_id, CASE WHEN h <> '' THEN h END AS host, seg, t FROM page),
host AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 3) AS INT) AS a, CAST('0x' || substr(md5(host), 4, 3) AS INT) % 600 AS b,
                CAST('0x' || substr(md5(host), 7, 3) AS INT) AS c FROM capture WHERE host IS NOT NULL),
entry AS (SELECT 'host:' || host AS value, 'add' AS action, b AS d, 'spam' AS category FROM host WHERE a % 16 = 0
          UNION ALL SELECT 'host:' || host, 'remove', b + 30 + c % 60, 'spam' FROM host WHERE a % 16 = 0 AND c % 2 = 0
          UNION ALL SELECT 'host:' || host, 'add', b + 120, 'malware' FROM host WHERE a % 16 = 0 AND c % 4 = 0
          UNION ALL SELECT 'domain:' || host, 'add', b, 'adult' FROM host WHERE a % 16 = 1
          UNION ALL SELECT 'prefix:' || host || '/en', 'add', b, 'ads' FROM host WHERE a % 8 = 2),
span AS (SELECT value, action, category, to_timestamp(1704067200 + d * 86400) AS b,
                to_timestamp(1704067200 + lead(d) OVER (PARTITION BY value ORDER BY d, action) * 86400) AS e FROM entry),
key AS (SELECT page_id, t, 'host:' || host AS value, 1000 AS rank FROM capture WHERE host IS NOT NULL
        UNION ALL SELECT page_id, t, 'prefix:' || host || '/' || lower(seg[1]), 1001 FROM capture WHERE host IS NOT NULL AND len(seg) > 0
        UNION ALL SELECT page_id, t, 'domain:' || array_to_string(l[len(l) - i + 1 :], '.'), i
                  FROM (SELECT page_id, t, string_split(host, '.') AS l, unnest(generate_series(1, len(string_split(host, '.')))) AS i FROM capture WHERE host IS NOT NULL)),
hit AS (SELECT key.page_id, key.value, key.rank, span.category, span.b FROM key JOIN span ON key.value = span.value AND span.action = 'add'
        AND span.b <= key.t AND (span.e IS NULL OR key.t < span.e)),
best AS (SELECT page_id, count(*) AS n, arg_max(value, rank) AS rule, arg_max(category, rank) AS category, arg_max(b, rank) AS b FROM hit GROUP BY page_id)
SELECT capture.page_id, host, coalesce(n, 0) AS n_active, n IS NOT NULL AS blocked, rule, category, strftime(b AT TIME ZONE 'UTC', '%Y-%m-%d') AS listed_at
FROM capture LEFT JOIN best ON capture.page_id = best.page_id
""",
    "op4_suffix_array": r"""
WITH doc AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
spot AS (SELECT doc_id, b, octet_length(b) AS n, unnest(range(octet_length(b) - 99)) AS s FROM doc),
string AS (SELECT doc_id, s, b[s + 1 : s + 100] AS g FROM spot),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, doc_id * 100000000 + s AS k, min(doc_id * 100000000 + s) OVER (PARTITION BY g) AS first FROM string) WHERE k > first),
edge AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM hit),
isle AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edge),
span AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS z FROM isle GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(hex(b), 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept
        FROM gap JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(kept || substr(hex(b), 2 * last + 1)) END) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)
""",
    "op5_decontaminate": f"""
WITH item AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT doc_id, n, i, w[i : i + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.n, spot.i, win.item_id FROM spot JOIN win ON spot.n = win.n AND spot.g = win.g),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
item_of AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN item_of USING (doc_id)
""",
    "op12_source_divergence": r"""
WITH doc AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM doc) GROUP BY lang, term HAVING count(*) >= 30),
occ AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM doc) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cell AS (SELECT grp.lang, grp.source, kept.term, coalesce(occ.n, 0) AS n FROM grp JOIN kept ON kept.lang = grp.lang
         LEFT JOIN occ ON occ.lang = grp.lang AND occ.source = grp.source AND occ.term = kept.term),
total AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM cell GROUP BY lang, source),
prob AS (SELECT cell.lang, cell.source, cell.term, cell.n, 1 + (1000000000::HUGEINT * (cell.n + 5)) // (total.n + 5 * size.v) AS p
         FROM cell JOIN total ON total.lang = cell.lang AND total.source = cell.source JOIN size ON size.lang = cell.lang),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
          FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM cell GROUP BY lang, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM prob a JOIN prob b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.f, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT prob.lang, source, 'term' AS part, prob.term AS item, p - q AS value FROM prob JOIN whole ON whole.lang = prob.lang AND whole.term = prob.term WHERE n > 0 AND p > q),
both_parts AS (SELECT * FROM pair UNION ALL SELECT * FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_hard_negatives": """
WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v, row_number() OVER () AS place
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
score AS (SELECT a.place AS a, a.vec_id AS anchor_id, b.place AS b, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
          FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.place <> b.place),
pos AS (SELECT a, anchor_id, b, vec_id AS positive_id, s AS positive_score FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id) <= 5),
neg AS (SELECT pos.anchor_id, positive_id, vec_id AS negative_id, positive_score, s AS negative_score, row_number() OVER (PARTITION BY pos.a, pos.b ORDER BY s DESC, vec_id) AS rank
        FROM pos JOIN score ON score.a = pos.a AND NOT same AND 80 * positive_score <= 100 * s AND s <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
""",
}
