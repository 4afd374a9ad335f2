"""Queries over embeddings: encoding, arithmetic, catalog, exact and approximate search."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import arrow
from lectern.functions.rows import each
from lectern.operators import embedding, probing, retrieval, two_level
from lectern.plans.registry import ORACLES, Inputs, query
from lectern.plans.text import tokens_sql
from lectern.session import scratch_path

DIM = embedding.DIM


def items(t: Inputs):
    return t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding", "label")


def asked(t: Inputs):
    """Every vector asks for its neighbours."""
    return t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")


# Scores are compared at nine decimals; ties go to the smaller id.
PAIRS = """SELECT q.vec_id AS query_id, i.vec_id AS item_id, i.label, q.label AS query_label,
      round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS s
    FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id"""


def top_sql(pairs: str, k: int, order: str = "s DESC", where: str = "true") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, item_id) AS rank
      FROM ({pairs}) WHERE {where}) WHERE rank <= {k}"""


def rounded(hits, *names: str):
    return hits.withColumns({n: F.round(n, 6) for n in names})


# ---- encoding ------------------------------------------------------------------------------

SLOTS = """SELECT {key}, ('0x' || substr(md5(token), 1, 8))::UBIGINT % {dim} AS slot, count(*) AS n
  FROM (SELECT {key}, unnest({tokens}) AS token FROM {source}) GROUP BY {key}, slot"""


def encoded_sql(key: str, source: str, column: str = "text") -> str:
    """(key, slot, value): non-zero entries of the default encoding, in single precision."""
    slots = SLOTS.format(key=key, dim=DIM, tokens=tokens_sql(f"lower({column})"), source=source)
    return f"SELECT {key}, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY {key}))::DOUBLE)::FLOAT AS value FROM ({slots})"


@query(
    "texts_embedded",
    f"SELECT doc_id, slot::INT AS slot, round(value::DOUBLE, 6) AS value FROM ({encoded_sql('doc_id', 'documents')})",
)
def texts_embedded(t: Inputs):
    encoded = embedding.embed(t.documents.select("doc_id", "text"))
    return each(encoded, ["doc_id"], F.col("embedding"), "v", "slot").filter("v <> 0").select(
        "doc_id", "slot", F.round(F.col("v").cast("double"), 6).alias("value")
    )


def _hashing_model():
    """The default encoder as a plug-in: texts -> matrix."""

    def encode(texts: list[str]) -> np.ndarray:
        matrix = np.zeros((len(texts), DIM))
        for row, text in enumerate(texts):
            for token in re.findall(r"[^ \t\n\r\f\v]+", text.lower()):
                matrix[row, arrow.token_slot(token, DIM)] += 1
        return matrix

    return encode


@query("texts_embedded_by_length", ORACLES["texts_embedded"])
def texts_embedded_by_length(t: Inputs):
    encoded = embedding.embed_by_length(t.documents.select("doc_id", "text"), "text", _hashing_model)
    return each(encoded, ["doc_id"], F.col("embedding"), "v", "slot").filter("v <> 0").select(
        "doc_id", "slot", F.round(F.col("v").cast("double"), 6).alias("value")
    )


@query(
    "vectors_normalized",
    """SELECT vec_id, (i - 1)::INT AS dim, round(e[i] / greatest(sqrt(list_dot_product(e, e)), 1e-8), 6) AS value
    FROM (SELECT vec_id, e, unnest(range(1, len(e) + 1)) AS i FROM (
      SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * label) AS e FROM embeddings))""",
)
def vectors_normalized(t: Inputs):
    # Scaled by the label, so that label 0 gives zero vectors.
    scaled = t.embeddings.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * F.col("label")).alias("embedding")
    )
    unit = embedding.l2_normalize(scaled)
    return each(unit, ["vec_id"], F.col("embedding"), "v", "dim").select(
        "vec_id", "dim", (F.round("v", 6) + F.lit(0.0)).alias("value")
    )


@query(
    "pairs_cosine",
    """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
      / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
        * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def pairs_cosine(t: Inputs):
    left = t.embeddings.select("vec_id", F.col("embedding").alias("a"))
    right = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return rounded(embedding.cosine(left.join(right, "vec_id"), "a", "b"), "cosine").select("vec_id", "cosine")


@query(
    "vectors_pooled",
    """SELECT label, (i - 1)::INT AS dim, round(sum(CASE WHEN first > 0 THEN v ELSE 0 END)
      / greatest(count(*) FILTER (WHERE first > 0), 1e-9), 6) AS value
    FROM (SELECT label, embedding[1] AS first, unnest(embedding::DOUBLE[]) AS v, unnest(range(1, len(embedding) + 1)) AS i
      FROM embeddings) GROUP BY label, i""",
)
def vectors_pooled(t: Inputs):
    masked = t.embeddings.withColumn("mask", (F.get("embedding", F.lit(0)) > 0).cast("int"))
    pooled = embedding.mean_pool(masked, "label", "embedding", "mask")
    return each(pooled, ["label"], F.col("pooled"), "v", "dim").select(
        "label", "dim", F.round("v", 6).alias("value")
    )


@query(
    "embedding_catalog",
    """SELECT chunk_id, 'hash-64' AS model_name, dim AS embedding_dim, (row_number() OVER (ORDER BY chunk_id) + 999)::BIGINT AS position
    FROM (SELECT 'U' || label || '_General_2024_chunk_' || vec_id AS chunk_id, len(embedding)::INT AS dim FROM embeddings)""",
)
def embedding_catalog(t: Inputs):
    # Ids as the chunk operator makes them; positions follow their order as strings.
    key = F.concat(F.lit("U"), "label", F.lit("_General_2024_chunk_"), "vec_id")
    rows = t.embeddings.select(key.alias("chunk_id"), "embedding")
    return embedding.embedding_catalog(rows, "hash-64", start=1000)


@query(
    "alignment",
    """SELECT doc_id, 'vector without metadata' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'metadata without vector' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def alignment(t: Inputs):
    return retrieval.check_alignment(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@query(
    "index_summary",
    """SELECT 'vector_index' AS index_name, 'flat' AS index_type, count(embedding) AS num_vectors,
      max(len(embedding))::INT AS dimension FROM embeddings UNION ALL
    SELECT 'document_index', 'flat', count(*), 64 FROM documents""",
)
def index_summary(t: Inputs):
    return retrieval.index_info(
        {"vector": t.embeddings, "document": embedding.embed(t.documents.select("text"))}
    )


# ---- search ------------------------------------------------------------------------------------


@query(
    "knn_label_agreement",
    f"""SELECT query_id, item_id, rank::INT AS rank, round(s, 6) AS score, query_label = label AS same_label
    FROM ({top_sql(PAIRS, 5)})""",
)
def knn_label_agreement(t: Inputs):
    hits = retrieval.knn_exact(items(t), asked(t), 5, skip_same_id=True)
    labelled = hits.join(t.embeddings.select(F.col("vec_id").alias("item_id"), "label"), "item_id").join(
        t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id"
    )
    return rounded(labelled, "score").select(
        "query_id", "item_id", "rank", "score", (F.col("label") == F.col("query_label")).alias("same_label")
    )


KNN10 = f"SELECT query_id, item_id, rank::INT AS rank, round(s, 6) AS score FROM ({top_sql(PAIRS, 10)})"


@query("knn_exact", KNN10)
def knn_exact(t: Inputs):
    return rounded(retrieval.knn_exact(items(t), asked(t), skip_same_id=True), "score")


@query("knn_exact_cells", KNN10)
def knn_exact_cells(t: Inputs):
    """The same search by cells, as for query sets too large to send to every task."""
    return rounded(retrieval.knn_exact(items(t), asked(t), skip_same_id=True, strategy="cells"), "score")


@query(
    "knn_squared_l2",
    f"""SELECT query_id, item_id, rank::INT AS rank, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score FROM (
      {top_sql('''SELECT q.vec_id AS query_id, i.vec_id AS item_id,
        round(list_sum(list_transform(range(1, len(q.embedding) + 1),
          lambda n: (q.embedding[n]::DOUBLE - i.embedding[n]::DOUBLE) ** 2)), 9) AS d
        FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id''', 3, 'd')})""",
)
def knn_squared_l2(t: Inputs):
    return rounded(retrieval.knn_exact(items(t), asked(t), 3, "l2", skip_same_id=True), "score", "distance")


@query(
    "knn_filtered_before",
    f"""SELECT query_id, item_id, rank::INT AS rank, round(s, 6) AS score FROM ({top_sql(PAIRS, 5, where='label = 3')})""",
)
def knn_filtered_before(t: Inputs):
    hits = retrieval.knn_filtered(items(t), asked(t), {"label": 3}, 5, "pre", skip_same_id=True)
    return rounded(hits, "score")


@query(
    "knn_filtered_after",
    f"""SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank, round(s, 6) AS score
    FROM ({top_sql(PAIRS, 15)}) WHERE label = 3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 5""",
)
def knn_filtered_after(t: Inputs):
    hits = retrieval.knn_filtered(items(t), asked(t), {"label": 3}, 5, "post", skip_same_id=True)
    return rounded(hits, "score")


# Probing every list is the exact search.
@query("clustered_search_all_lists", KNN10)
def clustered_search_all_lists(t: Inputs):
    index = retrieval.ivf_store(retrieval.ivf_build(items(t), nlist=16), scratch_path(t.spark, "index"))
    return rounded(retrieval.ivf_search(index, asked(t), nprobe=16, skip_same_id=True), "score")


# Every vector asks for ten neighbours; nine of ten of the exact ones must be found.
RECALL = "SELECT count(*) AS queries, 10 * count(*) AS expected, true AS enough FROM embeddings"


def enough(t: Inputs, found):
    measured = retrieval.recall(found, retrieval.knn_exact(items(t), asked(t), 10, skip_same_id=True))
    return measured.select("queries", "expected", (F.col("recall") >= 0.9).alias("enough"))


@query("clustered_search_recall", RECALL)
def clustered_search_recall(t: Inputs):
    """A stored index; the vectors are close to random, so most lists must be probed."""
    index = retrieval.ivf_store(retrieval.ivf_build(items(t), nlist=16), scratch_path(t.spark, "index"))
    return enough(t, retrieval.ivf_search(index, asked(t), 10, nprobe=12, skip_same_id=True))


@query("two_level_search_recall", RECALL)
def two_level_search_recall(t: Inputs):
    """A stored index of lists below roots; the vectors are close to random, so most lists must be probed."""
    index = two_level.two_level_store(two_level.two_level_build(items(t), list_items=32), scratch_path(t.spark, "index"))
    lists = index.lists.count()
    return enough(t, two_level.two_level_search(index, asked(t), 10, -(-4 * lists // 5), len(index.roots), skip_same_id=True))


@query("probed_search_recall", RECALL)
def probed_search_recall(t: Inputs):
    """A stored index whose buckets are probed in the order of their chance to hold a neighbour."""
    index = probing.probe_store(probing.probe_build(items(t)), scratch_path(t.spark, "index"))
    return enough(t, probing.probe_search(index, asked(t), 10, target=0.95, skip_same_id=True))


@query("bucketed_search_recall", RECALL)
def bucketed_search_recall(t: Inputs):
    return enough(t, retrieval.lsh_search(items(t), asked(t), 10, tables=32, skip_same_id=True))
