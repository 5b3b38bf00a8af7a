"""The registered queries of this folder: each applies one operator, with
production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    licenses,
    line_dedup,
    minhash,
    periodic_runs,
    sharding,
    substring_dedup,
    toxicity,
    url_filter,
    vector_search,
    warc,
)
from epilens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
RANKS = "byte_bpe_50k.tiktoken"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, width=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.remainder(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "threshold",
        "rejected",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs)
    names = F.array_sort(F.array_distinct(F.col("notices.license")))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.col("notices.kind"))), ",").alias("kinds"),
        F.round(F.array_max(F.col("notices.coverage")), 6).alias("coverage"),
    )


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k(vectors, every=50, k=5, scale=256)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.find_passages(docs)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_filter.rules_frame(spark, URL_RULES)
    return url_filter.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    return bpe.decode(ids, path).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"]).select("doc_id", "slot", "shard")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), F.col("id") % 100 == 0, scale=256)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 repeats p of its words from word a on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    docs = docs.withColumn("w", F.when(F.col("g").isNotNull(), F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda x: x != "")))
    n, g, w = F.size("w"), F.col("g"), F.col("w")
    a = (g % n).cast("int")
    m = 3 + g % 8
    p = (1 + F.floor((n - a) / m)).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(w, a + 1, p), m.cast("int")))
    planted = F.concat(F.slice(w, F.lit(1), a), F.slice(repeated, F.lit(1), n - a))
    return docs.select("doc_id", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(_with_planted_runs(docs)).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_vector_search": op4_vector_search,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_line_dedup": op13_line_dedup,
}

_LOWER = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINE_KEY = f"translate(trim(x, {_SPACE}), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}')"
# crc32 (reflected polynomial 0xEDB88320) of the decimal id
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(
        list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))))"""
_URL = "coalesce(url, '')"
_HOST = f"translate(regexp_extract({_URL}, '^.*?://([^/?#]*)', 1, 's'), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}')"
_PATH = f"regexp_extract({_URL}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}'))"


ORACLE_SQL: dict[str, str] = {
    "op1_minhash": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1),
                lambda i: array_to_string(w[i:i + 2], ' '))) AS s
            FROM words WHERE len(w) > 0),
        members AS (SELECT doc_id, unnest(s) AS g FROM sets),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM members AS x JOIN members AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM shared JOIN sets AS p ON p.doc_id = a JOIN sets AS q ON q.doc_id = b
            WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT DISTINCT a AS doc_id, a AS r FROM both_ways
            UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON r = a),
        low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(len(s), 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
            coalesce(component_id, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN low USING (doc_id)""",
    "op4_vector_search": """
        WITH v AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                list_sum(list_transform(range(1, len(v.e) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, coalesce(score, 0) AS score FROM r WHERE rank <= 5""",
    "op5_decontamination": f"""
        WITH items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
        docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        grams AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM docs, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
        hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
        words AS (
            SELECT doc_id, count(DISTINCT j) AS n_hit
            FROM hits, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op7_url_filter": f"""
        WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages)
        SELECT page_id, host, path, split_part(r, ' ', 2) AS rule, coalesce(split_part(r, ' ', 1), 'allow') AS verdict
        FROM (SELECT *, CASE
            {" ".join(f"WHEN {_fits(h, p)} THEN '{v} {h}{p}'" for v, h, p in sorted(URL_RULES, key=lambda x: -len(x[1] + x[2])))}
            END AS r FROM u)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last_id FROM q)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM r""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS a, v.vec_id AS i, a.label = v.label AS same,
                coalesce(list_sum(list_transform(range(1, len(v.e) + 1), lambda j: a.e[j] * v.e[j])), 0)::BIGINT AS score
            FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
        p AS (
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, i) AS r FROM s WHERE same)
            WHERE r <= 5),
        n AS (
            SELECT p.a, p.i AS p, p.score AS ps, s.i, s.score,
                row_number() OVER (PARTITION BY p.a, p.i ORDER BY s.score DESC, s.i)::INTEGER AS r
            FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
        SELECT a AS anchor_id, p AS positive_id, r AS rank, i AS negative_id, ps AS positive_score, score AS negative_score
        FROM n WHERE r <= 5""",
    "op12_periodic_runs": f"""
        WITH given AS (
            SELECT row_number() OVER () AS r, doc_id, {_CRC32} AS h,
                regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        places AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS m FROM given),
        docs AS (
            SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
                w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // m) END]) ELSE w END AS w
            FROM places),
        words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM docs),
        equal AS (
            SELECT y.r, y.i, z.i - y.i AS q FROM words AS y JOIN words AS z
            ON y.r = z.r AND y.x = z.x AND z.i > y.i AND 4 * (z.i - y.i) <= y.n),
        stretches AS (
            SELECT r, q, min(i) AS s, count(*) + q AS l
            FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM equal)
            GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
        runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
        dropped AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (
            SELECT r, string_agg(x, ' ' ORDER BY i) AS t
            FROM words ANTI JOIN dropped USING (r, i) GROUP BY r),
        listed AS (
            SELECT r, count(*) AS n, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t
            FROM runs GROUP BY r),
        pairs AS (
            SELECT DISTINCT x.r, x.s, x.l, x.q FROM runs AS x
            ANTI JOIN runs AS y ON x.r = y.r AND (y.l * x.q > x.l * y.q
                OR y.l * x.q = x.l * y.q AND (y.s < x.s OR y.s = x.s AND y.q < x.q)))
        SELECT doc_id, coalesce(listed.n, 0) AS n_runs, s AS start, l AS length, q AS period,
            1000 * l // q AS exponent_milli, sha256(coalesce(listed.t, '')) AS runs_sha256,
            sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r) LEFT JOIN pairs USING (r)""",
    "op13_line_dedup": f"""
        WITH lines AS (
            SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
        keys AS (SELECT r, doc_id, t, list_transform(t, lambda x: {_LINE_KEY}) AS k FROM lines),
        hot AS (
            SELECT k FROM (SELECT doc_id, unnest(k) AS k FROM keys)
            WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        kept AS (
            SELECT r, string_agg(x, chr(10) ORDER BY i) AS s, count(*) AS n
            FROM (SELECT r, unnest(t) AS x, unnest(k) AS k, unnest(range(1, len(t) + 1)) AS i FROM keys)
            WHERE k NOT IN (SELECT k FROM hot) GROUP BY r)
        SELECT doc_id, len(t) AS n_lines, len(t) - coalesce(n, 0) AS n_dropped, sha256(coalesce(s, '')) AS kept_sha256
        FROM keys LEFT JOIN kept USING (r)""",
}
