"""The registered queries of these operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import language as lang_id
from kindred.llm import quality as quality_trees
from kindred.llm import toxicity as toxic_field
from kindred.llm.common import table
from kindred.llm.exact_dedup import exact_dedup
from kindred.llm.jaccard_join import jaccard_components
from kindred.llm.packing import pack, token_counts
from kindred.llm.substring_dedup import repeated_words
from kindred.llm.tokenize_op import encode_decode
from kindred.llm.topk import top_k
from kindred.llm.url_filter import bad_page, host_path, url_filter


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As few sequences as can be. The score weighs what is left of all three capacities; at their defaults only tokens bind."""
    return pack(token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = pages.select(host_path(F.col("url"))[0].alias("host"), bad_page(F.col("html")).alias("bad"))
    return url_filter(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_trees.quality(docs, quality_trees.train(docs, table(spark, sf_dir, "labels")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_field.toxicity(docs, toxic_field.train(docs, table(spark, sf_dir, "labels")), with_spans=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.language(docs, lang_id.train(docs))


QUERIES = {f.__name__: f for f in (op1_packing, op2_jaccard_join, op3_bpe, op4_url_filter, op5_quality, op6_substring_dedup, op7_toxicity, op8_exact_dedup, op9_topk, op10_language)}

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLES = {
    "op2_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
        u AS (SELECT doc_id, md5_number_lower(unnest(sh)) AS h FROM s),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM u x JOIN u y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
        near AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n_shingles + y.n_shingles - shared)),
        links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, n_shingles, component_id FROM n JOIN c USING (doc_id)""",
    "op4_url_filter": r"""
        WITH p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
        t AS (SELECT host, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<[^>]*>', ' ', 'g') AS txt FROM q),
        o AS (SELECT host, len(list_filter(string_split_regex(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '')) < 20 OR length(regexp_replace(txt, '[^\p{L}]+', '', 'g')) < 0.7 * length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g')) AS bad FROM t),
        h AS (SELECT host, count(*) AS n, sum(bad::BIGINT) AS bad, regexp_extract(host, '(?:^|\.)([^.]*)$', 1) AS suffix, CASE WHEN contains(host, '.') THEN regexp_extract(host, '(?:^|\.)([^.]*\.[^.]*)$', 1) ELSE host END AS domain FROM o GROUP BY host),
        top AS (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS rate FROM h),
        g1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS m FROM h, top GROUP BY suffix),
        w1 AS (SELECT count(*) AS g, sum(n) AS n, sum(n * n) AS n2, sum(n * pow(bad / n - m, 2) / greatest(m * (1 - m), 1e-6)) AS s FROM g1),
        r1 AS (SELECT CASE WHEN n - n2 / n - (g - 1) > 0 THEN (s - (g - 1)) / (n - n2 / n - (g - 1)) ELSE 0 END AS rho FROM w1),
        b1 AS (SELECT suffix, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM g1, (SELECT CASE WHEN rho > 0 THEN least(1e4, greatest(1.0, (1 - rho) / rho)) ELSE 1e4 END AS w FROM r1)),
        g2 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(a / (a + b)) AS m FROM h JOIN b1 USING (suffix) GROUP BY ALL),
        w2 AS (SELECT count(*) AS g, sum(n) AS n, sum(n * n) AS n2, sum(n * pow(bad / n - m, 2) / greatest(m * (1 - m), 1e-6)) AS s FROM g2),
        r2 AS (SELECT CASE WHEN n - n2 / n - (g - 1) > 0 THEN (s - (g - 1)) / (n - n2 / n - (g - 1)) ELSE 0 END AS rho FROM w2),
        b2 AS (SELECT domain, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM g2, (SELECT CASE WHEN rho > 0 THEN least(1e4, greatest(1.0, (1 - rho) / rho)) ELSE 1e4 END AS w FROM r2)),
        g3 AS (SELECT host, n, bad, a / (a + b) AS m FROM h JOIN b2 USING (domain)),
        w3 AS (SELECT count(*) AS g, sum(n) AS n, sum(n * n) AS n2, sum(n * pow(bad / n - m, 2) / greatest(m * (1 - m), 1e-6)) AS s FROM g3),
        r3 AS (SELECT CASE WHEN n - n2 / n - (g - 1) > 0 THEN (s - (g - 1)) / (n - n2 / n - (g - 1)) ELSE 0 END AS rho FROM w3),
        b3 AS (SELECT host, m * w + bad AS a, (1 - m) * w + n - bad AS b FROM g3, (SELECT CASE WHEN rho > 0 THEN least(1e4, greatest(1.0, (1 - rho) / rho)) ELSE 1e4 END AS w FROM r3)),
        k AS (SELECT host, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 3 * rate / (1 - rate) / (1 + 3 * rate / (1 - rate)) AS blocked FROM b3, top),
        z AS (SELECT page_id, host, path, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM q)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL OR blocked THEN 'block' ELSE 'allow' END AS verdict FROM z LEFT JOIN k USING (host)""",
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
        v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
        f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
        hit AS (SELECT doc_id, i FROM v JOIN f USING (h) WHERE first < doc_id),
        x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
        c AS (SELECT x.doc_id, x.i, word, max(hit.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM x LEFT JOIN hit USING (doc_id, i)),
        s AS (SELECT doc_id, sum(gone::BIGINT)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op9_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p QUALIFY rank <= 5""",
}
