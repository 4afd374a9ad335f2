"""Queries over text cleaning, questions, windows and pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import arrow
from lectern.operators import chunking, cleaning, profiles, questions
from lectern.operators import filters as flt
from lectern.plans.registry import Inputs, query

TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')"
CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
# Letters beyond ASCII count as word characters; RE2's \b does not know them.
ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', '_', 'g')"


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)


def clean_sql(column: str) -> str:
    return CLEAN.format(column)


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def mask_sql(column: str) -> str:
    text = column
    for kind, pattern in fixed.PII_PATTERNS.items():
        text = f"regexp_replace({text}, '{pattern}', '{fixed.PII_REPLACEMENTS[kind]}', 'g')"
    return text


def language_sql(column: str) -> str:
    lowered = f"lower({column})"
    words = f"regexp_split_to_array({lowered}, '[^\\pL]+')"
    scores = []
    for rank, lang in enumerate(fixed.LANGUAGE_WORDS):
        listed = quoted(sorted(set(fixed.LANGUAGE_WORDS[lang])))
        score = f"len(list_filter({words}, lambda w: w IN ({listed})))"
        letters = fixed.LANGUAGE_LETTERS[lang]
        if letters:
            score += f" + 0.5 * length(regexp_replace({lowered}, '[^{letters}]', '', 'g'))"
        scores.append(f"{{'score': ({score})::DOUBLE, 'ord': {-rank}, 'lang': '{lang}'}}")
    best = f"list_max([{', '.join(scores)}])"
    letters = f"length(regexp_replace({lowered}, '[^\\pL]', '', 'g'))"
    arabic = f"length(regexp_replace({lowered}, '[^\\p{{Arabic}}]', '', 'g'))"
    return (
        f"CASE WHEN {letters} = 0 THEN 'unknown' WHEN {arabic} * 2 > {letters} THEN 'ar' "
        f"WHEN {best}.score > 0 THEN {best}.lang ELSE 'unknown' END"
    )


def intent_sql(column: str) -> tuple[str, str]:
    """(best intent struct, blank test) over a text column."""
    matched = ASCII.format(f"lower({column})")
    scores = []
    for rank, (intent, patterns) in enumerate(fixed.INTENT_PATTERNS.items()):
        hits = " + ".join(
            f"regexp_matches({matched}, '{p}')::INT" for p in patterns if p.isascii()
        )
        scores.append(f"{{'score': ({hits})::DOUBLE / {len(patterns)}, 'ord': {-rank}, 'intent': '{intent}'}}")
    return f"list_max([{', '.join(scores)}])", f"{clean_sql(column)} = ''"


@query("whitespace_normalized", f"SELECT doc_id, {clean_sql('text')} AS text FROM documents")
def whitespace_normalized(t: Inputs):
    return cleaning.normalize_whitespace(t.documents.select("doc_id", "text"))


# The tables hold no compatibility characters, so some are put in; each has its plain form beside it.
_COMPATIBLE = (("of", "\ufb01\u2460", "fi1"), ("la", "\uff21\u00bd", "A1\u20442"), ("er", "\u2126e\u0301\u2075", "\u03a9\u00e95"))


def _plain_form() -> str:
    text = "text"
    for word, _, plain in _COMPATIBLE:
        text = f"replace({text}, ' {word} ', ' {plain} ')"
    return f"nfc_normalize({text})"


@query("unicode_normalized", f"SELECT doc_id, {_plain_form()} AS text FROM documents")
def unicode_normalized(t: Inputs):
    text = F.col("text")
    for word, odd, _ in _COMPATIBLE:
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {odd} "))
    return cleaning.normalize_unicode(t.documents.select("doc_id", text.alias("text")))


def _hits_sql() -> str:
    parts, text = [], "text"
    for kind, pattern in fixed.PII_PATTERNS.items():
        parts.append(f"len(regexp_extract_all({text}, '{pattern}'))::INT AS {kind}_hits")
        text = f"regexp_replace({text}, '{pattern}', '{fixed.PII_REPLACEMENTS[kind]}', 'g')"
    return ", ".join(parts)


@query("pii_masked", f"SELECT doc_id, {mask_sql('text')} AS text, {_hits_sql()} FROM documents")
def pii_masked(t: Inputs):
    return cleaning.mask_pii(t.documents.select("doc_id", "text"))


@query("language_detected", f"SELECT doc_id, lang, {language_sql('text')} AS language FROM documents")
def language_detected(t: Inputs):
    return cleaning.detect_language(t.documents.select("doc_id", "lang", "text")).drop("text")


@query(
    "token_counts",
    f"SELECT doc_id, len({tokens_sql('text')})::INT AS words, length(text)::INT AS characters FROM documents",
)
def token_counts(t: Inputs):
    counted = cleaning.count_tokens(t.documents.select("doc_id", "text"), name="words")
    return cleaning.count_tokens(counted, method="character", name="characters").drop("text")


@query(
    "tokens_truncated",
    f"""SELECT doc_id, CASE WHEN len(w) <= 50 THEN text ELSE array_to_string(w[1:50], ' ') END AS text
    FROM (SELECT doc_id, text, {tokens_sql('text')} AS w FROM documents)""",
)
def tokens_truncated(t: Inputs):
    return cleaning.truncate_tokens(t.documents.select("doc_id", "text"), "text", 50)


# Learned from three quarters of the rows, by a number of the row that both engines compute.
HELD_OUT = "doc_id % 4 = 2"


@query(
    "language_profiled",
    f"""WITH c AS (SELECT doc_id, lang, ' ' || regexp_replace(trim(regexp_replace(lower(coalesce(text, '')), '{profiles.NO_LETTERS}', ' ', 'g')), ' +', ' ', 'g') || ' ' AS t FROM documents),
    g AS (SELECT doc_id, any_value(lang) AS lang, z[1] || z[2] || z[3] AS gram, count(*) AS n
          FROM (SELECT doc_id, lang, unnest(list_zip(l, l[2:], l[3:])) AS z FROM (SELECT doc_id, lang, string_split(t, '') AS l FROM c))
          WHERE z[3] IS NOT NULL GROUP BY doc_id, gram),
    p AS (SELECT lang AS language, gram, {profiles.PROFILE_SIZE + 1} - row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) AS weight
          FROM g WHERE lang IS NOT NULL AND NOT ({HELD_OUT}) GROUP BY lang, gram QUALIFY weight > 0),
    s AS (SELECT doc_id, language, sum(n * weight)::BIGINT AS score FROM g JOIN p USING (gram) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS r FROM s)
    SELECT d.doc_id, {HELD_OUT.replace('doc_id', 'd.doc_id')} AS held_out, coalesce(language, 'unknown') AS language, coalesce(score, 0) AS score
    FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND r = 1""",
)
def language_profiled(t: Inputs):
    docs = t.documents.select("doc_id", "text", "lang")
    learned = profiles.learned(docs.filter(~F.expr(HELD_OUT)))
    return profiles.identify(docs, "doc_id", learned).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "language", "score")


def preprocessed_sql(source: str, keys: str, column: str) -> str:
    return f"""SELECT {keys}, masked AS text, length({column})::INT AS original_length,
      length(masked)::INT AS processed_length, len({tokens_sql('masked')})::INT AS token_count,
      {language_sql('masked')} AS language, masked <> cleaned AS pii_masked
    FROM (SELECT *, {mask_sql('cleaned')} AS masked
      FROM (SELECT *, {clean_sql(f'nfc_normalize({column})')} AS cleaned FROM {source}))"""


@query("text_preprocessed", preprocessed_sql("documents", "doc_id", "text"))
def text_preprocessed(t: Inputs):
    return cleaning.preprocess(t.documents.select("doc_id", "text"))


@query(
    "keywords",
    f"""WITH words AS (
      SELECT doc_id, unnest(list_transform(w, lambda x, i: {{'word': x, 'pos': i}}), recursive := true)
      FROM (SELECT doc_id, {tokens_sql('lower(text)')} AS w FROM documents)),
    counted AS (
      SELECT doc_id, word, count(*) AS n, min(pos) AS first_pos FROM words
      WHERE length(word) > 2 AND word NOT IN ({quoted(fixed.KEYWORD_STOP_WORDS)}) GROUP BY doc_id, word)
    SELECT doc_id, rank::INT AS rank, word, n AS count FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank FROM counted)
    WHERE rank <= 10""",
)
def keywords(t: Inputs):
    return cleaning.extract_keywords(t.documents, "doc_id")


@query(
    "summaries",
    """SELECT doc_id, CASE WHEN length(first) <= 100 THEN first || '.' ELSE substr(first, 1, 100) || '...' END AS summary
    FROM (SELECT doc_id, trim(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '[.!?]+\\s+')[1], E' \\n\\t\\r') AS first
      FROM documents)""",
)
def summaries(t: Inputs):
    return cleaning.simple_summary(t.documents.select("doc_id", "text")).drop("text")


# ---- questions ---------------------------------------------------------------------

_BEST, _BLANK = intent_sql("text")
_INTENT = """CASE WHEN is_blank THEN 'other' WHEN best.score < 0.5 THEN 'other' ELSE best.intent END"""
_CONFIDENCE = "CASE WHEN is_blank THEN 0.0 ELSE round(best.score, 6) END"


@query(
    "intents",
    f"""SELECT conv_id, turn, {_INTENT} AS intent, {_CONFIDENCE}::DOUBLE AS intent_confidence
    FROM (SELECT conv_id, turn, {_BEST} AS best, {_BLANK} AS is_blank FROM conversations)""",
)
def intents(t: Inputs):
    found = questions.classify_intent(t.conversations.select("conv_id", "turn", "text"))
    return found.select("conv_id", "turn", "intent", F.round("intent_confidence", 6).alias("intent_confidence"))


# Letters outside ASCII count as word characters in one regex engine and not in the other, so the
# entity queries look at texts in which each of them is an "x".
_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')"


def _entities_sql() -> str:
    """All matches with their places per pattern, then per type those that do not begin inside an earlier one."""
    parts = []
    for kind, patterns in fixed.ENTITY_PATTERNS_REFERENCE.items():
        for place, (pattern, subtype) in enumerate(patterns):
            pattern = fixed.ENTITY_CORRECTIONS.get(subtype, pattern).replace("(?<!\\w)", "(?:^|\\W)").replace("'", "''")
            flags = "" if kind in fixed.CASE_SENSITIVE_ENTITY_TYPES else "(?i)"
            parts.append(
                f"""SELECT doc_id, '{kind}' AS type, {place} AS place, '{subtype}' AS subtype, m, i,
                  sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
                  SELECT doc_id, unnest(m) AS m, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i FROM (
                    SELECT doc_id, regexp_extract_all(t, '{flags}{pattern}') AS m, regexp_split_to_array(t, '{flags}{pattern}') AS p
                    FROM plain))"""
            )
    return f"""WITH plain AS (SELECT doc_id, {_PLAIN} AS t FROM documents),
      spans AS (SELECT doc_id, type, place, subtype, CASE WHEN subtype = 'hash_invoice' THEN regexp_extract(m, '#.*') ELSE m END AS value,
        stop::INT AS stop FROM ({" UNION ALL ".join(parts)})),
      listed AS (SELECT doc_id, type, list({{'start': stop - length(value)::INT, 'place': place, 'stop': stop, 'subtype': subtype,
        'value': value}} ORDER BY stop - length(value), place) AS s FROM spans GROUP BY doc_id, type),
      kept AS (SELECT doc_id, type, unnest(list_reduce(s[2:], lambda a, x: CASE WHEN x.start >= a[-1].stop THEN list_append(a, x) ELSE a END,
        s[1:1])) AS e FROM listed),
      entities AS (SELECT doc_id, type, e.subtype AS subtype, e.value AS value, e.start AS start, e.stop AS "end" FROM kept)"""


ENTITIES = _entities_sql()


def plain_entities(t: Inputs):
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return questions.extract_entities(t.documents.select("doc_id", text.alias("text")), "doc_id")


@query("entities", ENTITIES + """ SELECT doc_id, type, subtype, value, start, "end" FROM entities""")
def entities(t: Inputs):
    return plain_entities(t)


@query(
    "entity_emails",
    f"""SELECT doc_id, unnest(regexp_extract_all(text, '{fixed.PII_PATTERNS["email"]}')) AS value FROM documents""",
)
def entity_emails(t: Inputs):
    only = {"email": fixed.ENTITY_PATTERNS_REFERENCE["email"]}
    return questions.extract_entities(t.documents, "doc_id", rules=only).select("doc_id", "value")


@query(
    "entity_counts",
    ENTITIES
    + " SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS {k}" for k in fixed.ENTITY_PATTERNS_REFERENCE)
    + ", count(*) AS entity_count FROM entities GROUP BY doc_id",
)
def entity_counts(t: Inputs):
    return questions.entity_counts(plain_entities(t), "doc_id")


# The same over the texts as they are; DuckDB's word bounds are ASCII, so these have no SQL.
@query("entities_unicode")
def entities_unicode(t: Inputs):
    return questions.extract_entities(t.documents, "doc_id")


@query("entity_counts_unicode")
def entity_counts_unicode(t: Inputs):
    return questions.entity_counts(entities_unicode(t), "doc_id")


_RECORD_BEST, _ = intent_sql("processed")


@query(
    "question_records",
    f"""SELECT conv_id, turn, processed AS processed_question, token_count, language, pii_masked,
      CASE WHEN processed = '' THEN 'unknown' WHEN best.score < 0.5 THEN 'other' ELSE best.intent END AS intent,
      CASE WHEN processed = '' THEN 0.0 ELSE round(best.score, 6) END::DOUBLE AS intent_confidence
    FROM (SELECT *, text AS processed, {_RECORD_BEST.replace('processed', 'text')} AS best
      FROM ({preprocessed_sql('conversations', 'conv_id, turn', 'text')}))""",
)
def question_records(t: Inputs):
    records = questions.make_question_records(t.conversations.withColumnRenamed("text", "question"))
    return records.select(
        "conv_id",
        "turn",
        F.when(F.col("preprocessing.error").isNotNull(), "").otherwise(F.col("processed_question")).alias("processed_question"),
        "preprocessing.token_count",
        "preprocessing.language",
        "preprocessing.pii_masked",
        "intent",
        F.round("intent_confidence", 6).alias("intent_confidence"),
    )


@query(
    "questions_validated",
    """SELECT conv_id, turn, CASE
        WHEN role = 'system' THEN 'missing processed_question'
        WHEN role = 'assistant' THEN 'question_id is no UUID'
        WHEN turn = 0 THEN 'timestamp is not ISO' END AS reason,
      role = 'user' AND turn > 0 AS valid FROM conversations""",
)
def questions_validated(t: Inputs):
    made = questions.make_question_records(t.conversations.withColumnRenamed("text", "question"))
    # Records damaged by role and turn, so that every reason occurs.
    damaged = made.withColumns(
        {
            "processed_question": F.when(F.col("role") != "system", F.col("processed_question")),
            "question_id": F.when(F.col("role") == "assistant", F.md5("original_question")).otherwise(
                F.col("question_id")
            ),
            "timestamp": F.when(F.col("turn") == 0, "yesterday").otherwise(F.col("timestamp")),
        }
    )
    damaged = damaged.withColumn("question_id", F.concat("question_id", F.when(F.col("role") == "assistant", "!").otherwise("")))
    return flt.validate_questions(damaged).select("conv_id", "turn", "reason", "valid")


# ---- windows and pieces ----------------------------------------------------------------


def windows_sql(max_tokens: int, overlap: int, keys: str = "doc_id", source: str = "documents", column: str = "text") -> str:
    step = max_tokens - overlap
    return f"""SELECT {keys}, (s / {step})::INT AS window_idx,
      array_to_string(w[s + 1 : s + {max_tokens}], ' ') AS chunk, len(w[s + 1 : s + {max_tokens}])::INT AS n_tokens
    FROM (SELECT {keys}, w, unnest(range(0, len(w), {step})) AS s
      FROM (SELECT {keys}, {tokens_sql(column)} AS w FROM {source}))"""


WINDOWS = windows_sql(fixed.MAX_CHUNK_TOKENS, fixed.OVERLAP_TOKENS)


@query("token_windows", WINDOWS)
def token_windows(t: Inputs):
    return chunking.chunk_tokens(t.documents.select("doc_id", "text"))


def offsets_loader(name: str = "word_bpe_49k.json"):
    """Loader of a public tokenizer's character offsets; its file lies at the same place on every machine."""

    def load():
        import public_tokenizers
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda text: tokenizer.encode(text, add_special_tokens=False).offsets

    return load


def word_offsets_loader(name: str = "word_bpe_49k.json"):
    """The same offsets, those of a word computed once per Python worker."""

    def load():
        import public_tokenizers
        from tokenizers import Tokenizer

        return arrow.WordOffsets(Tokenizer.from_file(public_tokenizers.path(name)))

    return load


# No SQL: a tokenizer decides. Tested against a plain pass; what SQL can tell, that no character is lost, is the next query.
@query("subword_windows")
def subword_windows(t: Inputs):
    return chunking.chunk_subwords(t.documents.select("doc_id", "text"), word_offsets_loader())


@query("subword_windows_joined", "SELECT doc_id, text, true AS in_place FROM documents WHERE text <> ''")
def subword_windows_joined(t: Inputs):
    cut = chunking.chunk_subwords(t.documents.select("doc_id", "text"), word_offsets_loader(), overlap=0)
    parts = F.array_sort(F.collect_list(F.struct("window_idx", "chunk", "start_char", "end_char")))
    return cut.groupBy("doc_id").agg(
        F.array_join(parts["chunk"], "").alias("text"),
        F.bool_and((F.length("chunk") == F.col("end_char") - F.col("start_char")) & (F.col("n_tokens") <= fixed.MAX_CHUNK_TOKENS)).alias("in_place"),
    )


@query("fixed_pieces", windows_sql(50, 0))
def fixed_pieces(t: Inputs):
    return chunking.fixed_pieces(t.documents.select("doc_id", "text"))


# Ten pieces of 50 tokens are one run of 500 tokens.
@query(
    "merged_pieces",
    f"SELECT doc_id, window_idx AS group_idx, chunk FROM ({windows_sql(500, 0)})",
)
def merged_pieces(t: Inputs):
    pieces = chunking.piece_arrays(t.documents.select("doc_id", "text"))
    return chunking.merge_at_splits(pieces, chunking.even_splits(F.col("pieces")))


# Windows of 20 pieces that move on by 7: cuts at 3 and 7 of each, as long as more than 10 pieces are left.
_ASKED = "CASE WHEN n > 10 THEN ceil((n - 10) / 7.0)::INT ELSE 0 END"


@query(
    "proposed_pieces",
    f"""WITH pieces AS ({windows_sql(5, 0)}),
      placed AS (SELECT doc_id, window_idx AS i, chunk, CASE WHEN i >= 7 * asked THEN 7 * asked WHEN i % 7 < 3 THEN i - i % 7
          ELSE i - i % 7 + 3 END AS start
        FROM pieces JOIN (SELECT doc_id, {_ASKED} AS asked FROM (SELECT doc_id, count(*) AS n FROM pieces GROUP BY doc_id)) USING (doc_id))
    SELECT doc_id, (dense_rank() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS group_idx, chunk
    FROM (SELECT doc_id, start, string_agg(chunk, ' ' ORDER BY i) AS chunk FROM placed GROUP BY doc_id, start)""",
)
def proposed_pieces(t: Inputs):
    """Pieces of five tokens, so long documents have thousands, regrouped at proposed points."""
    pieces = chunking.piece_arrays(t.documents.select("doc_id", "text"), size=5)
    return chunking.merge_at_splits(pieces, chunking.proposed_splits(F.col("pieces"), lambda: lambda part: [3, 7]))


@query(
    "semantic_pieces",
    f"""WITH pieces AS (SELECT doc_id, window_idx AS i, chunk, list_distinct({tokens_sql('lower(chunk)')}) AS words
        FROM ({windows_sql(50, 0)})),
      scored AS (SELECT doc_id, i, chunk, words, lag(words) OVER (PARTITION BY doc_id ORDER BY i) AS previous FROM pieces),
      cut AS (SELECT doc_id, i, chunk, CASE WHEN previous IS NOT NULL AND len(list_intersect(previous, words))::DOUBLE
          / greatest(len(previous) + len(words) - len(list_intersect(previous, words)), 1) < 0.1 THEN 1 ELSE 0 END AS new
        FROM scored),
      numbered AS (SELECT doc_id, i, chunk, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut)
    SELECT doc_id, g::INT AS group_idx, string_agg(chunk, ' ' ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, g""",
)
def semantic_pieces(t: Inputs):
    pieces = chunking.piece_arrays(t.documents.select("doc_id", "text"))
    return chunking.merge_at_splits(pieces, chunking.semantic_splits(F.col("pieces"), threshold=0.1))


@query(
    "chunk_stats",
    f"""SELECT lang, count(*) AS n_chunks, round(avg(length(chunk)), 6) AS avg_size, min(length(chunk))::INT AS min_size,
      max(length(chunk))::INT AS max_size, sum(length(chunk))::BIGINT AS total_size
    FROM ({windows_sql(512, 50, 'doc_id, lang')}) GROUP BY lang""",
)
def chunk_stats(t: Inputs):
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "lang", "text"))
    return chunking.chunk_stats(chunks, by=["lang"]).withColumn("avg_size", F.round("avg_size", 6))


@query(
    "chunk_overlaps",
    f"""WITH chunks AS (SELECT doc_id, window_idx, {tokens_sql('chunk')} AS w FROM ({WINDOWS})),
      pairs AS (SELECT a.doc_id, a.window_idx, a.w AS a, b.w AS b
        FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND b.window_idx = a.window_idx + 1),
      lengths AS (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS n FROM pairs)
    SELECT p.doc_id, p.window_idx::BIGINT AS window_idx, coalesce(max(l.n), 0)::INT AS overlap
    FROM pairs p LEFT JOIN lengths l ON l.doc_id = p.doc_id AND l.window_idx = p.window_idx
      AND l.a[len(l.a) - l.n + 1 : len(l.a)] = l.b[1 : l.n]
    GROUP BY p.doc_id, p.window_idx""",
)
def chunk_overlaps(t: Inputs):
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "text"))
    return chunking.chunk_overlap(chunks, "doc_id", "window_idx")


@query(
    "chunk_ids",
    f"""SELECT doc_id, window_idx, 'U_' || lang || '_2024_chunk_' || row_number() OVER (
        PARTITION BY source ORDER BY doc_id, window_idx) AS chunk_id
    FROM ({windows_sql(512, 50, 'doc_id, lang, source')})""",
)
def chunk_ids(t: Inputs):
    chunks = chunking.chunk_tokens(t.documents.select("doc_id", "lang", "source", "text")).select(
        "doc_id",
        "window_idx",
        F.lit("U").alias("university_id"),
        F.col("lang").alias("program"),
        F.lit("2024").alias("year"),
        F.col("source").alias("source_file"),
    )
    return chunking.assign_chunk_ids(chunks, ["doc_id", "window_idx"]).select("doc_id", "window_idx", "chunk_id")


def corpus(t: Inputs):
    """Documents with metadata columns: the source stands in for the university."""
    return t.documents.select(
        "doc_id",
        F.col("source").alias("university_id"),
        F.col("lang").alias("program"),
        F.lit("2024").alias("year"),
        F.array(F.col("lang")).alias("aliases"),
        F.col("doc_id").cast("string").alias("source_file"),
        "text",
    )


def plain_sql(column: str) -> str:
    """Markdown marks removed; for texts that are one block without links, code or underscores."""
    listed = f"regexp_matches({column}, '^ {{0,3}}([-*+]|\\d+\\.)[ \\t]+')"
    item = f"regexp_replace({column}, '(?m)^[ \\t]*([-*+]|\\d+\\.)[ \\t]+', '', 'g')"
    text = f"CASE WHEN {listed} THEN {item} ELSE {column} END"
    for pattern in (
        "(?m)^#{1,6}[ \\t]*([^\\n]*?)[ \\t]*#*$",
        "(?s)\\*{3}(.+?)\\*{3}",
        "(?s)\\*{2}(.+?)\\*{2}",
        "\\*([^*]+)\\*",
    ):
        text = f"regexp_replace({text}, '{pattern}', '\\1', 'g')"
    return text


def summary_sql(column: str) -> str:
    first = f"trim(regexp_split_to_array({column}, '[.!?]+\\s+')[1])"
    return f"CASE WHEN length({first}) <= 100 THEN {first} || '.' ELSE substr({first}, 1, 100) || '...' END"


CHUNKS = f"""SELECT university_id || '_' || program || '_2024_chunk_' || (window_idx + 1) AS chunk_id, chunk AS text,
      {summary_sql('chunk')} AS summary, university_id, program, source_file, window_idx AS chunk_index, n_tokens, doc_id
    FROM ({windows_sql(512, 50, 'doc_id, university_id, program, source_file',
    "(SELECT doc_id, source AS university_id, lang AS program, doc_id::VARCHAR AS source_file, "
    f"{plain_sql('text')} AS text FROM documents)")})"""


@query(
    "paragraph_chunks",
    f"SELECT chunk_id, text, summary, '' AS section_title, chunk_index, source_file FROM ({CHUNKS})",
)
def paragraph_chunks(t: Inputs):
    return chunking.build_chunks(corpus(t)).select(
        "chunk_id", "text", "summary", "section_title", "chunk_index", "source_file"
    )


