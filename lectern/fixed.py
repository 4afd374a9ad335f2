"""Fixed values.

Patterns, word lists, templates and defaults that results depend on. They are part
of the data contract and are stated here in one place.
"""

# --- fixed values: personal-data patterns, applied in this order ---------------
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?216[\s-]?)?\d{2}[\s-]?\d{3}[\s-]?\d{3}\b",
    "national_id": r"\b\d{8}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
}
PII_REPLACEMENTS = {
    "email": "[EMAIL]",
    "phone": "[PHONE]",
    "national_id": "[ID]",
    "iban": "[IBAN]",
}

# --- fixed values: intent patterns, matched against lower-cased text -----------
INTENT_PATTERNS = {
    "extract_structured": [
        r"\b(extract|get|find|show|list|table|data|information)\b.*\b(table|data|list|information|details)\b",
        r"\bwhat\s+(are|is)\s+the\b.*\b(courses|prerequisites|requirements|credits)\b",
        r"\b(show|display|give)\s+me\b.*\b(table|list|data)\b",
    ],
    "summarize": [
        r"\b(summarize|summary|overview|brief|tldr|main\s+points)\b",
        r"\bgive\s+me\s+a\s+(summary|overview)\b",
        r"\bwhat\s+is\s+the\s+main\b",
    ],
    "translate": [
        r"\b(translate|translation|in\s+(arabic|french|english))\b",
        r"\bما\s+هو\b",
        r"\btraduire\b",
    ],
    "qa": [
        r"\b(what|when|where|who|why|how|is|are|does|do|can|should)\b",
        r"\b(explain|tell\s+me|describe)\b",
        r"\?$",
    ],
}

# --- fixed values: entity patterns (type -> [(pattern, subtype)]) --------------
# "reference" keeps the original patterns, all matched without regard to case.
ENTITY_PATTERNS_REFERENCE = {
    "date": [
        (r"\b\d{4}-\d{2}-\d{2}\b", "iso_date"),
        (r"\b\d{1,2}/\d{1,2}/\d{4}\b", "us_date"),
        (r"\b\d{1,2}\.\d{1,2}\.\d{4}\b", "eu_date"),
        (r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+\d{4}\b", "natural_date"),
    ],
    "amount": [
        (r"\b\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|EUR|TND|DT|\$|€)\b", "currency"),
        (r"\b\d+(?:,\d{3})*(?:\.\d+)?\b", "numeric"),
    ],
    "invoice_number": [
        (r"\b(?:INV|INVOICE)[- ]?\d+\b", "invoice_code"),
        (r"\b#\d{4,}\b", "hash_invoice"),
        (r"\b\d{4,}[-/]\d+\b", "compound_invoice"),
    ],
    "email": [
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "email"),
    ],
    "phone": [
        (r"\b(?:\+?216[\s-]?)?\d{2}[\s-]?\d{3}[\s-]?\d{3}\b", "tunisian_phone"),
        (r"\+\d{1,3}[\s-]?\d{1,4}[\s-]?\d{1,4}[\s-]?\d{1,9}", "international_phone"),
    ],
    "company": [
        (r"\b[A-Z][A-Za-z\s&]+(?:LLC|Inc|Ltd|Corp|Corporation|SA|SARL|GmbH)\b", "company_suffix"),
        (r"\b[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)+\b", "capitalized_entity"),
    ],
}
# Corrections used by default: a leading "#", "$" or "€" needs no word character
# next to it, and company patterns keep their capitals.
ENTITY_CORRECTIONS = {
    "currency": r"\b\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:(?:USD|EUR|TND|DT)\b|[$€])|[$€]\s?\d+(?:,\d{3})*(?:\.\d+)?\b",
    "hash_invoice": r"(?<!\w)#\d{4,}\b",
}
CASE_SENSITIVE_ENTITY_TYPES = ("company",)

# --- fixed values: keyword stop words ------------------------------------------
KEYWORD_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by",
)

# --- fixed values: function words per language (language identification) -------
LANGUAGE_WORDS = {
    "en": (
        "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "as",
        "be", "this", "have", "from", "or", "by", "not", "but", "what", "when", "which", "at", "an", "for",
    ),
    "fr": (
        "le", "la", "les", "de", "des", "du", "un", "une", "et", "est", "en", "que", "qui", "dans",
        "pour", "par", "sur", "avec", "au", "aux", "ce", "cette", "pas", "plus", "ou", "quel", "quelle",
    ),
    "de": (
        "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "von", "mit", "den", "dem",
        "des", "auf", "für", "im", "sich", "als", "auch", "es", "an", "werden", "aus", "er", "sie", "in",
    ),
    "es": (
        "el", "la", "los", "las", "de", "del", "y", "que", "en", "un", "una", "es", "por", "con",
        "para", "no", "se", "su", "al", "lo", "como", "más", "pero", "sus", "le", "o", "este",
    ),
}
# Letters that mark a language; each occurrence counts like half a function word.
LANGUAGE_LETTERS = {"en": "", "fr": "çèêàùœ", "de": "äöüß", "es": "ñíóú¿¡"}

# --- fixed values: defaults -----------------------------------------------------
MAX_CHUNK_TOKENS = 512
OVERLAP_TOKENS = 50
HEADER_LEVEL = 2
ENCODER_BATCH = 8
RETRIEVAL_K = 10
VECTOR_WEIGHT = 0.7
TEXT_WEIGHT = 0.3
NORM_EPS = 1e-8
POOL_EPS = 1e-9
SUMMARY_LENGTH = 100
NO_RESULT_ANSWER = "No relevant information found."
DEFAULT_SECTION = "Document Content"
DEFAULT_UNIVERSITY = "UNKNOWN"
DEFAULT_PROGRAM = "General"
DEFAULT_YEAR = "2024"

# --- fixed values: context and citation layout -----------------------------------
CONTEXT_HEADER = (
    ("🏫 UNIVERSITY: ", "university_id"),
    ("📚 Program: ", "program"),
    ("📄 Source: ", "source_file"),
    ("📑 Section: ", "section_title"),
)
CONTEXT_RULE = "-" * 40
CONTEXT_SEPARATOR = "=" * 50
CITATION_RULE = "=" * 60
CITATION_SECTION_RULE = "-" * 60
CITATION_TEXT_LENGTH = 400

# --- fixed values: heading patterns used to infer a section title ----------------
HEADING_PATTERNS = (
    r"(?m)^(\d+\.\d+\.?\s+[A-Z][^\n]{5,80})",
    r"(?m)^(\d+\.\s+[A-Z][^\n]{5,80})",
)

# --- fixed values: prompt templates ({context} and {question} are replaced) -------
PROMPT_TEMPLATES = {
    ("qa", "en"): """You are an academic assistant specialized in answering questions about university curricula.

Use the following information to answer the question. If you cannot find the answer in the provided context, respond with: "This information is not currently available and will be added soon."

Context:
{context}

Question: {question}

Instructions:
- Answer accurately based on the provided information
- Cite sources using numbers [1], [2], etc.
- ⚠️ CRITICAL: Each source comes from a DIFFERENT university/institution. DO NOT mix information from different universities
- When answering, clearly specify which university each piece of information applies to
- If the user asks about a specific university, only answer with information from that university
- If information is insufficient, respond with: "This information is not currently available and will be added soon."
- Be concise and direct

Answer:""",
    ("qa", "ar"): """أنت مساعد أكاديمي متخصص في الإجابة على الأسئلة حول المناهج الجامعية.

استخدم المعلومات التالية للإجابة على السؤال. إذا لم تجد الإجابة في السياق المقدم، قل "هذه المعلومات غير متوفرة حالياً وسيتم إضافتها قريباً."

السياق:
{context}

السؤال: {question}

تعليمات:
- أجب بدقة بناءً على المعلومات المقدمة
- استشهد بالمصادر باستخدام الأرقام [1], [2], إلخ
- ⚠️ مهم جداً: كل مصدر يأتي من جامعة/مؤسسة مختلفة. لا تخلط بين المعلومات من جامعات مختلفة
- عند الإجابة، حدد بوضوح أي جامعة تنطبق عليها كل معلومة
- إذا سأل المستخدم عن جامعة معينة، أجب فقط بالمعلومات الخاصة بتلك الجامعة
- إذا كانت المعلومات غير كافية، قل "هذه المعلومات غير متوفرة حالياً وسيتم إضافتها قريباً."
- كن موجزاً ومباشراً

الإجابة:""",
    ("comparison", "en"): """You are an academic assistant specialized in comparing university curricula.

Compare programs or institutions based on the following information.

Context:
{context}

Question: {question}

Provide a structured comparison with source citations.

Answer:""",
    ("comparison", "ar"): """أنت مساعد أكاديمي متخصص في مقارنة المناهج الجامعية.

قارن بين البرامج أو المؤسسات بناءً على المعلومات التالية.

السياق:
{context}

السؤال: {question}

قدم مقارنة منظمة مع الاستشهاد بالمصادر.

الإجابة:""",
    ("summary", "en"): """Summarize the following information about: {question}

Context:
{context}

Provide a comprehensive and structured summary.

Summary:""",
    ("summary", "ar"): """لخص المعلومات التالية حول: {question}

السياق:
{context}

قدم ملخصاً شاملاً ومنظماً.

الملخص:""",
}

# --- fixed values: HTML entities decoded in text ------------------------------------
# "&amp;" comes last so that an escaped entity is decoded once.
HTML_ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
)

# --- fixed values: columns and types of the relational tables ---------------------
RELATIONAL_TABLES = {
    "documents": {
        "id": "bigint",
        "source_file": "string",
        "file_path": "string",
        "file_content": "binary",
        "file_type": "string",
        "university_id": "string",
        "program": "string",
        "year": "string",
        "file_size": "bigint",
        "num_pages": "int",
        "num_chunks": "bigint",
        "processed_date": "timestamp",
        "metadata": "string",
    },
    "chunks": {
        "id": "bigint",
        "chunk_id": "string",
        "document_id": "bigint",
        "text": "string",
        "chunk_type": "string",
        "section_title": "string",
        "chunk_index": "int",
        "start_char": "int",
        "end_char": "int",
        "summary": "string",
        "table_html": "string",
        "table_description": "string",
        "metadata": "string",
        "created_at": "timestamp",
    },
    "embeddings": {
        "id": "bigint",
        "chunk_id": "bigint",
        "model_name": "string",
        "embedding_dim": "int",
        "position": "bigint",
        "embedding": "array<float>",
        "created_at": "timestamp",
    },
    "indices": {
        "id": "bigint",
        "index_name": "string",
        "index_type": "string",
        "file_path": "string",
        "dimension": "int",
        "num_vectors": "bigint",
        "model_name": "string",
        "build_date": "timestamp",
        "index_params": "string",
    },
    "query_history": {
        "id": "bigint",
        "user_id": "bigint",
        "question": "string",
        "question_type": "string",
        "answer": "string",
        "num_sources": "bigint",
        "response_time_ms": "bigint",
        "llm_model": "string",
        "embedding_model": "string",
        "metadata_filters": "string",
        "timestamp": "timestamp",
    },
    "query_feedback": {
        "id": "bigint",
        "query_id": "bigint",
        "rating": "int",
        "helpful": "boolean",
        "comments": "string",
        "created_at": "timestamp",
    },
    "retrieved_chunks": {
        "id": "bigint",
        "query_id": "bigint",
        "chunk_id": "bigint",
        "rank": "int",
        "vector_score": "double",
        "bm25_score": "double",
        "combined_score": "double",
        "rerank_score": "double",
    },
}
