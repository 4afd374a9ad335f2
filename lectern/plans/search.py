"""Queries over texts: candidates, reranking, lexical search, contexts, citations, prompts, answers.

Questions are the rows of ``benchmark``. Sources are the token windows of ``documents``
(type ``chunk``) and the turns of ``conversations`` (type ``table``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import text as X
from lectern.operators import chunking, completion, context, embedding, ingest, postings, retrieval
from lectern.plans.registry import ORACLES, Inputs, query
from lectern.plans.text import language_sql, tokens_sql, windows_sql
from lectern.plans.vectors import DIM, SLOTS, rounded
from lectern.session import scratch_path
from lectern.sources.store import file_state, stored

ATTACH = ("university_id", "program", "year", "source_file", "section_title")


def asked(t: Inputs):
    return embedding.embed(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


def texts(t: Inputs) -> dict:
    """The items of both sources before they are encoded."""
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "lang", "source", "text")).select(
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("_"), F.col("window_idx")).alias("item_id"),
        F.col("chunk").alias("text"),
        F.col("source").alias("university_id"),
        F.col("lang").alias("program"),
        F.lit("2024").alias("year"),
        F.concat(F.col("source"), F.lit("_handbook.md")).alias("source_file"),
        F.concat(F.lit("Part "), F.col("window_idx")).alias("section_title"),
    )
    turns = t.conversations.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("item_id"),
        F.lit("").alias("text_fallback"),
        "text",
        F.lit("chat").alias("university_id"),
        F.col("role").alias("program"),
        F.lit("2023").alias("year"),
        F.lit("turns.md").alias("source_file"),
        F.lit("").alias("section_title"),
    )
    return {"chunk": chunks, "table": turns}


def sources(t: Inputs) -> dict:
    return {name: indexed(t, name, items) for name, items in texts(t).items()}


# Where the encoded items of an input lie, per application and state of the files they come from.
_INDEXED: dict[tuple, str] = {}
READ_FROM = {"chunk": "documents", "table": "conversations"}


def indexed(t: Inputs, name: str, items):
    """Ingest encodes and writes the items of an input once; all searches of the session scan them until its files change.

    What this costs is the query items_indexed, which keeps nothing.
    """
    state = file_state(t.spark, f"{t.path}/{READ_FROM[name]}.parquet")
    key = (t.spark.sparkContext.applicationId, t.path, name, state)
    if key in _INDEXED:
        try:
            return t.spark.read.parquet(_INDEXED[key])
        except AnalysisException:  # the folder was cleared
            pass
    path = scratch_path(t.spark, name)
    found = stored(embedding.embed(items), path)
    _INDEXED[key] = path
    return found


ITEMS = f"""WITH items AS (
    SELECT 'd' || doc_id || '_' || window_idx AS item_id, 'chunk' AS type, 0 AS place, chunk AS text, source AS university_id,
      lang AS program, '2024' AS year, source || '_handbook.md' AS source_file, 'Part ' || window_idx AS section_title
    FROM ({windows_sql(512, 50, 'doc_id, lang, source')})
    UNION ALL SELECT 'c' || conv_id || '_' || turn, 'table', 1, text, 'chat', role, '2023', 'turns.md', '' FROM conversations),
  qn AS (SELECT item_id AS query_id, text FROM benchmark),
  iv AS (SELECT item_id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY item_id))::DOUBLE)::FLOAT::DOUBLE AS v
    FROM ({SLOTS.format(key='item_id', dim=DIM, tokens=tokens_sql('lower(text)'), source='items')})),
  qv AS (SELECT query_id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY query_id))::DOUBLE)::FLOAT::DOUBLE AS v
    FROM ({SLOTS.format(key='query_id', dim=DIM, tokens=tokens_sql('lower(text)'), source='qn')})),
  dots AS (SELECT query_id, item_id, round(sum(qv.v * iv.v), 9) AS s FROM qv JOIN iv USING (slot) GROUP BY ALL),
  scored AS (SELECT q.query_id, i.*, coalesce(d.s, 0.0) AS s, q.text AS query_text
    FROM qn q CROSS JOIN items i LEFT JOIN dots d ON d.query_id = q.query_id AND d.item_id = i.item_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY s DESC, item_id) AS r FROM scored)
"""

@query(
    "items_indexed",
    ITEMS
    + """SELECT i.type, i.item_id, i.text, count(iv.slot)::INT AS n_slots FROM items i LEFT JOIN iv USING (item_id)
    GROUP BY i.type, i.item_id, i.text""",
)
def items_indexed(t: Inputs):
    written = [
        stored(embedding.embed(items), scratch_path(t.spark, name)).select(
            F.lit(name).alias("type"), "item_id", "text", F.size(F.filter("embedding", lambda x: x != 0)).alias("n_slots")
        )
        for name, items in texts(t).items()
    ]
    return written[0].union(written[1])


OVERLAP = (
    f"len(list_intersect(list_distinct({tokens_sql('lower(query_text)')}), {tokens_sql('lower(text)')}))::DOUBLE"
    f" / len(list_distinct({tokens_sql('lower(query_text)')}))"
)


@query(
    "sources_searched",
    ITEMS + "SELECT query_id, type, item_id, r::INT AS rank, round(s, 6) AS score, text FROM ranked WHERE r <= 10",
)
def sources_searched(t: Inputs):
    hits = retrieval.search_sources(sources(t), asked(t), 10)
    return rounded(hits, "score").select("query_id", "type", "item_id", "rank", "score", "text")


def reranked_sql(k: int, order: str) -> str:
    return (
        ITEMS
        + f""", cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, item_id) AS cr
        FROM ranked WHERE r <= {2 * k}) WHERE cr <= {3 * k}),
      pairs AS (SELECT *, {OVERLAP} AS rerank_score FROM cand),
      hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, cr)::INT AS rank
        FROM pairs) WHERE rank <= {k})
"""
    )


HITS = reranked_sql(5, "s DESC, place")


@query(
    "search_reranked",
    HITS + "SELECT query_id, type, item_id, rank, round(s, 6) AS score, round(rerank_score, 6) AS rerank_score FROM hits",
)
def search_reranked(t: Inputs):
    hits = retrieval.search_and_rerank(sources(t), asked(t), 5)
    return rounded(hits, "score", "rerank_score").select("query_id", "type", "item_id", "rank", "score", "rerank_score")


@query(
    "search_reranked_by_source",
    reranked_sql(5, "place, s DESC") + "SELECT query_id, item_id, rank, round(rerank_score, 6) AS rerank_score FROM hits",
)
def search_reranked_by_source(t: Inputs):
    hits = retrieval.search_and_rerank(sources(t), asked(t), 5, order="source")
    return rounded(hits, "rerank_score").select("query_id", "item_id", "rank", "rerank_score")


@query(
    "search_unranked",
    ITEMS
    + """SELECT query_id, item_id, rank, round(s, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, place, item_id)::INT AS rank FROM ranked WHERE r <= 5)
    WHERE rank <= 5""",
)
def search_unranked(t: Inputs):
    hits = retrieval.search_and_rerank(sources(t), asked(t), 5, rerank=False)
    return rounded(hits, "score").select("query_id", "item_id", "rank", "score")


@query(
    "pairs_scored",
    f"""SELECT conv_id, turn, round({OVERLAP}, 6) AS rerank_score FROM (
      SELECT a.conv_id, a.turn, a.text AS query_text, b.text FROM conversations a JOIN conversations b
      ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""",
)
def pairs_scored(t: Inputs):
    turns = t.conversations.select("conv_id", "turn", F.col("text").alias("query_text"))
    replies = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    pairs = turns.join(replies, ["conv_id", "turn"])
    return rounded(retrieval.score_pairs(pairs), "rerank_score").select("conv_id", "turn", "rerank_score")


# ---- lexical search ----------------------------------------------------------------------------

BM25 = f"""WITH docs AS (SELECT doc_id AS item_id, {tokens_sql('lower(text)')} AS w FROM documents),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('lower(text)')}) AS term FROM benchmark),
  size AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM docs),
  tf AS (SELECT item_id, len(w) AS length, term, count(*) AS tf FROM (SELECT item_id, w, unnest(w) AS term FROM docs) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  bm AS (SELECT query_id, item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5))
      * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 9) AS s
    FROM asked JOIN tf USING (term) JOIN df USING (term) CROSS JOIN size GROUP BY ALL),
  bm_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id)::INT AS rank FROM bm)
"""


def documents(t: Inputs):
    return t.documents.select(F.col("doc_id").alias("item_id"), "text")


@query("lexical_search", BM25 + "SELECT query_id, item_id, rank, round(s, 6) AS score FROM bm_hits WHERE rank <= 10")
def lexical_search(t: Inputs):
    return rounded(retrieval.bm25(documents(t), asked(t).drop("embedding")), "score")


@query("lexical_search_cells", BM25 + "SELECT query_id, item_id, rank, round(s, 6) AS score FROM bm_hits WHERE rank <= 10")
def lexical_search_cells(t: Inputs):
    """The same search by cells, as for query sets too large to send to every task."""
    return rounded(retrieval.bm25(documents(t), asked(t).drop("embedding"), strategy="cells"), "score")


@query("lexical_search_stored", BM25 + "SELECT query_id, item_id, rank, round(s, 6) AS score FROM bm_hits WHERE rank <= 10")
def lexical_search_stored(t: Inputs):
    """The same search over stored postings: no text is read."""
    index = postings.postings_store(documents(t), scratch_path(t.spark, "postings"))
    return rounded(postings.bm25_stored(index, asked(t).drop("embedding")), "score")


FUSED = (
    BM25
    + f""", qn AS (SELECT item_id AS query_id, text FROM benchmark),
  iv AS (SELECT doc_id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id))::DOUBLE)::FLOAT::DOUBLE AS v
    FROM ({SLOTS.format(key='doc_id', dim=DIM, tokens=tokens_sql('lower(text)'), source='documents')})),
  qv AS (SELECT query_id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY query_id))::DOUBLE)::FLOAT::DOUBLE AS v
    FROM ({SLOTS.format(key='query_id', dim=DIM, tokens=tokens_sql('lower(text)'), source='qn')})),
  vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM (
    SELECT query_id, doc_id AS item_id, round(sum(qv.v * iv.v), 9) AS s FROM qv JOIN iv USING (slot) GROUP BY ALL)),
  a AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM vec WHERE rank <= 10),
  b AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM bm_hits WHERE rank <= 10),
  both_hits AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id,
      CASE WHEN a.s IS NULL THEN NULL WHEN a.hi > a.lo THEN (a.s - a.lo) / (a.hi - a.lo) ELSE 1 END AS vs,
      CASE WHEN b.s IS NULL THEN NULL WHEN b.hi > b.lo THEN (b.s - b.lo) / (b.hi - b.lo) ELSE 1 END AS ts
    FROM a FULL JOIN b ON a.query_id = b.query_id AND a.item_id = b.item_id),
  fused AS (SELECT *, round(0.7 * coalesce(vs, 0) + 0.3 * coalesce(ts, 0), 9) AS c FROM both_hits)
"""
)


@query(
    "scores_fused",
    FUSED
    + """SELECT query_id, item_id, rank, round(c, 6) AS combined_score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id)::INT AS rank FROM fused) WHERE rank <= 10""",
)
def scores_fused(t: Inputs):
    texts = documents(t)
    vector = retrieval.knn_exact(embedding.embed(texts), asked(t), 10)
    lexical = retrieval.bm25(texts, asked(t).drop("embedding"), 10)
    return rounded(retrieval.fuse(vector, lexical), "combined_score").select(
        "query_id", "item_id", "rank", "combined_score"
    )


# ---- contexts, citations, prompts ------------------------------------------------------------------


def hits(t: Inputs):
    return retrieval.search_and_rerank(sources(t), asked(t), 5, attach=ATTACH)


_PART = f"""'[' || rank || '] 🏫 UNIVERSITY: ' || university_id || E'\\n📚 Program: ' || program || E'\\n📄 Source: ' || source_file
  || E'\\n📑 Section: ' || section_title || E'\\n{'-' * 40}\\n' || text"""
CONTEXT = (
    HITS
    + f""", contexts AS (SELECT query_id, string_agg({_PART}, E'\\n\\n{'=' * 50}\\n\\n' ORDER BY rank) AS context,
      count(*) AS num_sources FROM hits GROUP BY query_id)
"""
)


@query("contexts", CONTEXT + "SELECT * FROM contexts")
def contexts(t: Inputs):
    return context.assemble_context(hits(t))


@query(
    "contexts_within_budget",
    HITS
    + f""", parts AS (SELECT query_id, rank, part, sum(len({tokens_sql('part')})) OVER (PARTITION BY query_id ORDER BY rank) AS used
      FROM (SELECT query_id, rank, {_PART} AS part FROM hits))
    SELECT query_id, string_agg(part, E'\\n\\n{'=' * 50}\\n\\n' ORDER BY rank) AS context, count(*) AS num_sources
    FROM parts WHERE used <= 900 GROUP BY query_id""",
)
def contexts_within_budget(t: Inputs):
    return context.assemble_context(hits(t), max_tokens=900)


# Window texts are one line; a title is inferred where none is given.
def inferred_sql(text: str, given: str) -> str:
    line = (
        f"list_filter(list_transform(string_split({text}, E'\\n')[1:5], lambda l: trim(l, E' \\t\\r')), lambda l: "
        "length(l) > 5 AND length(l) < 80 AND ((regexp_matches(l, '\\p{Lu}') AND NOT regexp_matches(l, '[\\p{Ll}\\p{Lt}]')) "
        "OR (regexp_matches(l, '^\\p{Lu}') AND contains(substr(l, 1, 5), '.'))))[1]"
    )
    numbered = ", ".join(
        f"nullif(trim(regexp_replace(regexp_extract({text}, '{p}', 1), '\\s+', ' ', 'g')), '')" for p in fixed.HEADING_PATTERNS
    )
    return (
        f"coalesce(CASE WHEN {given} NOT IN ('', 'Unknown') THEN {given} END, {numbered}, "
        f"CASE WHEN {line} <> 'Unknown' THEN {line} END, 'Document Content')"
    )


@query("sections_inferred", f"SELECT doc_id, {inferred_sql('text', 'NULL')} AS section_title FROM documents")
def sections_inferred(t: Inputs):
    return context.infer_section(t.documents.select("doc_id", "text")).drop("text")


CITED = (
    HITS
    + f""", titled AS (SELECT *, {inferred_sql('text', 'section_title')} AS section FROM hits),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_file, section ORDER BY rerank_score DESC, rank) AS pr FROM titled),
  sections AS (SELECT query_id, source_file, section, min(rank) AS first_rank, count(*) AS n, max(rerank_score) AS score,
      string_agg(CASE WHEN pr <= 2 THEN CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END || E'\\n\\n' END,
        '' ORDER BY pr) AS passages FROM best GROUP BY ALL),
  grouped AS (SELECT query_id, source_file, min(first_rank) AS first_rank, list_sort(list(section)) AS sections,
      sum(n)::BIGINT AS chunk_count, max(score) AS score,
      string_agg('📑 Section: ' || section || E'\\n{'-' * 60}\\n' || passages || CASE WHEN n > 2 THEN '[... and ' || (n - 2)
        || E' more passage(s) from this section]\\n' ELSE '' END || E'\\n', '' ORDER BY first_rank) AS body
    FROM sections GROUP BY ALL),
  cited AS (SELECT g.*, h.university_id, h.program, h.year,
      row_number() OVER (PARTITION BY g.query_id ORDER BY g.score DESC, g.first_rank)::INT AS id
    FROM grouped g JOIN hits h ON h.query_id = g.query_id AND h.rank = g.first_rank)
"""
)


@query(
    "citations",
    CITED
    + f"""SELECT query_id, id, 'pdf' AS type, source_file, university_id, program, year, array_to_string(sections, ';') AS sections,
      chunk_count, round(score, 6) AS score, trim('📄 ' || replace(replace(source_file, '.md', '.pdf'), '_', ' ') || E'\\n🏫 ' || university_id
        || ' | 📚 ' || program || ' | 📅 ' || year || E'\\n\\n{'=' * 60}\\n\\n' || body, E' \\n') AS text FROM cited""",
)
def citations(t: Inputs):
    return rounded(context.citations(hits(t)), "score").withColumn("sections", F.array_join("sections", ";"))


def _prompt_sql(kind: str, language: str, question: str, ctx: str) -> str:
    text = fixed.PROMPT_TEMPLATES[(kind, language)].replace("'", "''").replace("\n", "\\n")
    for name, column in (("{context}", ctx), ("{question}", question)):
        text = text.replace(name, f"' || {column} || E'")
    return f"E'{text}'"


_CASES = " ".join(
    f"WHEN kind = '{kind}' AND language = '{lang}' THEN {_prompt_sql(kind, lang, 'text', 'context')}"
    for kind, lang in fixed.PROMPT_TEMPLATES
)


@query(
    "prompts",
    CONTEXT
    + f""", typed AS (SELECT query_id, text, context, ['qa', 'summary', 'comparison', 'chat'][query_id % 4 + 1] AS type,
        {language_sql('text')} AS language FROM contexts JOIN qn USING (query_id)),
      known AS (SELECT * REPLACE (CASE WHEN language = 'ar' THEN 'ar' ELSE 'en' END AS language), language AS found,
        CASE WHEN type = 'chat' THEN 'qa' ELSE type END AS kind FROM typed)
    SELECT query_id, type AS question_type, found AS language, CASE {_CASES} END AS prompt FROM known""",
)
def prompts(t: Inputs):
    joined = context.assemble_context(hits(t)).join(
        t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id"
    )
    typed = joined.withColumns(
        {
            # "chat" is no known type and falls back to qa.
            "question_type": F.element_at(F.array(*map(F.lit, ("qa", "summary", "comparison", "chat"))), (F.col("query_id") % 4 + 1).cast("int")),
            "language": X.language(F.col("question")),
        }
    )
    return context.build_prompts(typed).select("query_id", "question_type", "language", "prompt")


_LINE = "CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text || E'\\n'"


@query(
    "conversation_contexts",
    f"""SELECT conv_id, E'Previous conversation:\\n' || history || E'\\nCurrent question:\\nWhat follows?' AS question_with_context
    FROM (SELECT conv_id, string_agg({_LINE}, '' ORDER BY turn) AS history FROM (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6
      GROUP BY conv_id)""",
)
def conversation_contexts(t: Inputs):
    current = t.conversations.select("conv_id").distinct().withColumn("question", F.lit("What follows?"))
    return context.conversation_context(t.conversations, current).select("conv_id", "question_with_context")


@query(
    "running_histories",
    f"""SELECT a.conv_id, a.turn, coalesce(string_agg(b.line, '' ORDER BY b.turn), '') AS history FROM conversations a
    LEFT JOIN (SELECT conv_id, turn, {_LINE} AS line FROM conversations) b
      ON b.conv_id = a.conv_id AND b.turn BETWEEN a.turn - 6 AND a.turn - 1 GROUP BY a.conv_id, a.turn""",
)
def running_histories(t: Inputs):
    return context.running_history(t.conversations).select("conv_id", "turn", "history")


# ---- completion and answers ------------------------------------------------------------------------


REFUSED = "there"


def _reverse_model():
    """A stand-in model: reverses prompts, refuses a call in which any prompt holds a certain word."""

    def run(prompts: list[str]) -> list[str]:
        if any(REFUSED in p for p in prompts):
            raise RuntimeError("refused")
        return [p[::-1] for p in prompts]

    return run


@query(
    "completions",
    f"""SELECT doc_id, contains(text, '{REFUSED}') AS refused, CASE WHEN NOT contains(text, '{REFUSED}') THEN coalesce(nullif(trim(reverse(text)), ''), '.') ELSE CASE WHEN length(first) <= 100
      THEN first || '.' ELSE substr(first, 1, 100) || '...' END END AS answer
    FROM (SELECT doc_id, text, trim(regexp_split_to_array(trim(text, E' \\n'), '[.!?]+\\s+')[1]) AS first FROM documents)""",
)
def completions(t: Inputs):
    # Calls of the default size: refused prompts stand among others, which still get their answers.
    done = completion.complete(t.documents.select("doc_id", "text"), "text", _reverse_model, name="answer", failed="refused")
    return done.select("doc_id", "refused", "answer")


@query(
    "completions_stored",
    ORACLES["completions"].replace("AS refused,", "AS refused, NOT refused AS reused,", 1),
)
def completions_stored(t: Inputs):
    # The second job finds all answers but those of refused prompts, which it asks again.
    path, docs = scratch_path(t.spark, "answer-store"), t.documents.select("doc_id", "text")
    for _ in range(2):
        done = completion.complete_stored(docs, "text", _reverse_model, path, "reverse", name="answer", reused="reused")
    return done.select("doc_id", (~F.col("reused")).alias("refused"), "reused", "answer")


@query(
    "answers",
    CITED
    + """, top AS (SELECT query_id, trim(regexp_split_to_array(trim(text), '[.!?]+\\s+')[1]) AS first FROM hits WHERE rank = 1)
    SELECT q.query_id, q.text AS question, CASE WHEN length(first) <= 100 THEN first || '.' ELSE substr(first, 1, 100) || '...' END AS answer,
      count(DISTINCT h.rank) AS num_sources, (SELECT count(*) FROM cited c WHERE c.query_id = q.query_id)::INT AS num_citations
    FROM qn q JOIN top USING (query_id) JOIN hits h USING (query_id) GROUP BY ALL""",
)
def answers(t: Inputs):
    answered = completion.answer_batch(asked(t), sources(t), 5)
    return answered.select(
        "query_id", "question", "answer", "num_sources", F.size("citations").alias("num_citations")
    )


@query(
    "chunk_report",
    HITS
    + """SELECT item_id AS chunk_id, count(*) AS hits, round(avg(rank), 6) AS mean_rank, round(avg(s), 6) AS mean_vector_score,
      round(avg(rerank_score), 6) AS mean_rerank_score FROM hits GROUP BY item_id""",
)
def chunk_report(t: Inputs):
    retrieved = hits(t).select(
        "query_id", F.col("item_id").alias("chunk_id"), "rank", F.col("score").alias("vector_score"), "rerank_score"
    )
    return rounded(ingest.chunk_report(retrieved), "mean_rank", "mean_vector_score", "mean_rerank_score")


