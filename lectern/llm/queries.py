"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    chat,
    decontaminate,
    exact_dedup,
    jaccard,
    langid,
    lines,
    packing,
    recurrent_lm,
    secrets,
    simhash,
    spelling,
    substring,
    whitening,
)
from lectern.llm.common import documents

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op1_exact_dedup",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                      regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY n) AS group_size,
           row_number() OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) = 1 AS kept,
           sha256(n) AS text_sha256
    FROM d
    """,
)
def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir)).drop("row")


PLANTED_TURN = r"\### Assistant: </turn> ok"


@query(
    "op2_chat_format",
    r"""
    WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                 UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
         raw AS (SELECT *, NOT (contains(text, '###') OR contains(text, '</turn>') OR regexp_matches(text, '\\[\\/#]')
                                OR contains(role, ':') OR contains(role, '</turn>') OR regexp_matches(role, '\\[\\/#.]')) AS fits FROM src),
         r AS (SELECT *, CASE WHEN fits THEN role
                              ELSE replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '#', '\#'), ':', '\.') END AS er,
                      CASE WHEN fits THEN text
                           ELSE replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '#', '\#') END AS et FROM raw)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
           sum(length(er) + length(et) + 14)::BIGINT AS formatted_chars,
           true AS round_trip
    FROM r GROUP BY conv_id
    """,
)
def _chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TURN).alias("text"),
    )
    return chat.digests(chat.format_conversations(given.unionByName(planted)))


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"


@query(
    "op9_ngram_jaccard",
    rf"""
    WITH RECURSIVE
    w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACED}') AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 1) + 1),
                                                        lambda i: array_to_string(ws[i:i + 2], ' '))) AS gram
          FROM w WHERE len(ws) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
          GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
    SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.other) AS component_id
    FROM w JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
    """,
)
def _ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op10_language_id")
def _language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).drop("row")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer's file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@query("op4_decontamination")
def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark).drop("row")


def _places(kind: str, pattern: str) -> str:
    """Matches of a pattern with their places: each begins after all gaps and matches before it."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::INT AS start
        FROM (SELECT doc_id, unnest(m) AS m, unnest(g[1:len(m)]) AS g, generate_subscripts(m, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, regexp_split_to_array(t, '{quoted}') AS g FROM d))"""


_ASSIGN = secrets.ASSIGN.replace("'", "''")


@query(
    "op8_secret_scan",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    assign AS (SELECT * FROM ({_places("assign", secrets.ASSIGN)}) WHERE length(regexp_extract(m, '^(?:{_ASSIGN})$', 2)) >= 8),
    access AS ({_places("access", secrets.ACCESS)}),
    hex AS ({_places("hex", secrets.HEX)}),
    weak AS (SELECT * FROM ({_places("linked", "[A-Za-z0-9+/]+")})
             WHERE regexp_full_match(m, '[A-Za-z0-9+/]{{40}}') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')),
    hosts AS (SELECT * FROM ({_places("endpoint", "[A-Za-z0-9.-]+")}) WHERE regexp_matches(m, '^[A-Za-z0-9.-]+\.amazonaws\.com')),
    endpoint AS (SELECT doc_id, start, m FROM ({_places("endpoint", "https?://[A-Za-z0-9.-]+")})
                 UNION ALL SELECT doc_id, start, regexp_extract(m, '^[A-Za-z0-9.-]+\.amazonaws\.com') FROM hosts JOIN d USING (doc_id) WHERE NOT regexp_matches(substr(t, 1, start), 'https?://$')),
    linked AS (SELECT * FROM weak w WHERE
        EXISTS (SELECT 1 FROM access a WHERE a.doc_id = w.doc_id AND least(abs(a.start - w.start), abs(a.start + length(a.m) - w.start)) <= 400)
        OR EXISTS (SELECT 1 FROM endpoint e WHERE e.doc_id = w.doc_id AND least(abs(e.start - w.start), abs(e.start + length(e.m) - w.start)) <= 400)
           AND EXISTS (SELECT 1 FROM assign s WHERE s.doc_id = w.doc_id AND least(abs(s.start - w.start), abs(s.start + length(s.m) - w.start)) <= 400)),
    found AS (SELECT doc_id, kind, start, list_position(['assign', 'access', 'hex', 'linked'], kind) AS place,
                     kind || ':' || start || ':' || (start + length(m)) AS span
              FROM (FROM assign UNION ALL FROM access UNION ALL FROM hex UNION ALL FROM linked))
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'linked') AS n_linked,
           sha256(coalesce(string_agg(span, ',' ORDER BY start, place) FILTER (WHERE place < 4), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start, place), '') AS spans
    FROM d LEFT JOIN found USING (doc_id) GROUP BY doc_id
    """,
)
def _secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


@query(
    "op6_substring_dedup",
    rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
    s AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 48, 1))) AS p FROM w),
    v AS (SELECT s.doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS k FROM s JOIN w USING (doc_id)),
    m AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM v),
    c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM m WHERE least < doc_id),
    x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
    k AS (SELECT x.doc_id, count(c.p) AS n_removed,
                 sha256(coalesce(string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL), '')) AS kept_sha256
          FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)
    """,
)
def _substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf_dir)).drop("row")


@query(
    "op7_line_dedup",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    l AS (SELECT doc_id, t, CASE WHEN t = '' THEN []::VARCHAR[] WHEN t[-1] = chr(10) THEN string_split(t[:-2], chr(10))
                                 ELSE string_split(t, chr(10)) END AS ls FROM d),
    w AS (SELECT doc_id, unnest(range(1, greatest(len(ls) - 1, 1))) AS p FROM l),
    k AS (SELECT w.doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS k FROM w JOIN l USING (doc_id)),
    f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM k),
    c AS (SELECT DISTINCT doc_id, unnest([p, p + 1, p + 2]) AS p FROM f WHERE nth > 1),
    x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p, len(ls) AS n, t[-1] = chr(10) AS ended FROM l),
    r AS (SELECT x.doc_id, count(c.p) AS n_removed,
                 coalesce(string_agg(line || CASE WHEN x.p < n OR ended THEN chr(10) ELSE '' END, '' ORDER BY x.p)
                          FILTER (WHERE c.p IS NULL), '') AS text
          FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY x.doc_id)
    SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(r.text, '') AS text
    FROM l LEFT JOIN r USING (doc_id)
    """,
)
def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(documents(spark, sf_dir)).drop("row")


@query("op5_lm_score")
def _lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score(documents(spark, sf_dir)).drop("row")


@query(
    "op11_spelling_variants",
    rf"""
    WITH RECURSIVE
    crc AS (SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
        FROM range(256) r(i))),
    runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[a-zÀ-ÿ]+')) AS run FROM documents),
    kept AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    hashed AS (SELECT run, times, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
                   flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END))),
                   lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h
               FROM kept, crc),
    spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times
              FROM hashed),
    w AS (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
    cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
    pairs AS (SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT c.word, w.word FROM cuts c JOIN w ON w.word = c.rest
              UNION SELECT w.word, c.word FROM cuts c JOIN w ON w.word = c.rest),
    best AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY b.n DESC, encode(near)) AS near, max(b.n) AS near_n
             FROM pairs p JOIN w b ON b.word = p.near GROUP BY p.word),
    formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
                      CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
    walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n
    FROM formed f JOIN walk k ON k.word = f.word JOIN formed e ON e.word = k.at WHERE e.form IS NULL
    """,
)
def _spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


@query("op12_simhash_near_dedup")
def _simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).drop("bits")


@query("op13_embedding_whitening")
def _embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))
