"""Embeddings, centroids, nearest topics, number of clusters and density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctopics.operators import density, encoders, neighbours
from doctopics.operators import embeddings as emb
from doctopics.plans.base import merge_cte, r6, register, table, tokens
from doctopics.plans.cleaning_queries import WORD_LISTS_CTE
from doctopics.runtime import materialise

# cent: unit-length mean vector per label; scored: cosine of every vector with every centroid
CENT = """pos AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM pos GROUP BY label, i),
  lens AS (SELECT label, sqrt(sum(m * m)) AS len FROM means GROUP BY label),
  cent AS (SELECT m.label AS topic, list(m / len ORDER BY i) AS vec FROM means m JOIN lens USING (label) GROUP BY m.label),
  scored AS (SELECT vec_id, label, topic, list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec) AS score
    FROM embeddings CROSS JOIN cent),
  best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) AS rn FROM scored)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "topic")


@register(
    "topic_centroids",
    f"""WITH {CENT} SELECT m.label AS topic, CAST(i AS INT) AS pos, round(m / len, 6) + 0.0 AS x
    FROM means m JOIN lens USING (label)""",
)
def topic_centroids(spark, sf_dir):
    cent = emb.topic_centroids(vectors(spark, sf_dir))
    long = cent.select("topic", F.posexplode("vector").alias("pos", "x"))
    return long.select("topic", (F.col("pos") + 1).alias("pos"), r6("x", "x"))


@register(
    "assign_to_nearest_topic",
    f"WITH {CENT} SELECT vec_id, topic, round(score, 6) AS score FROM best WHERE rn = 1",
)
def assign_to_nearest_topic(spark, sf_dir):
    df = vectors(spark, sf_dir)
    out = emb.assign_to_nearest_topic(df.drop("topic"), emb.topic_centroids(df))
    return out.select("vec_id", "topic", r6("score", "score"))


INVERSE = """inv AS (SELECT vec_id, label, topic, 1 / greatest(list_distance(CAST(embedding AS DOUBLE[]), vec), 1e-12) AS w
    FROM embeddings CROSS JOIN cent),
  probs AS (SELECT vec_id, label, topic, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM inv)"""


@register(
    "topic_probabilities",
    f"WITH {CENT}, {INVERSE} SELECT vec_id, topic, round(p, 6) AS p FROM probs",
)
def topic_probabilities(spark, sf_dir):
    df = vectors(spark, sf_dir)
    out = emb.topic_probabilities(df.drop("topic"), emb.topic_centroids(df))
    return out.select("vec_id", F.posexplode("probabilities").alias("topic", "p")).select("vec_id", "topic", r6("p", "p"))


def _with_outliers(df):
    """Every seventh vector loses its topic."""
    return df.withColumn("topic", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("topic")))


@register(
    "assign_outliers",
    f"""WITH {CENT}, {INVERSE}, b AS (SELECT vec_id, arg_max(topic, p) AS best FROM probs GROUP BY vec_id)
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN best ELSE label END AS topic FROM embeddings JOIN b USING (vec_id)""",
)
def assign_outliers(spark, sf_dir):
    df = vectors(spark, sf_dir)
    cent = emb.topic_centroids(df)
    topics = [r["topic"] for r in cent.select("topic").orderBy("topic").collect()]
    out = emb.assign_outliers(emb.topic_probabilities(_with_outliers(df), cent), topics)
    return out.select("vec_id", "topic")


@register(
    "topic_nearest_words",
    f"""WITH {CENT}, r AS (SELECT topic, vec_id, score,
        row_number() OVER (PARTITION BY topic ORDER BY score DESC, concat('w', CAST(vec_id AS VARCHAR))) AS rank FROM scored)
    SELECT topic, CAST(rank AS INT) AS rank, concat('w', CAST(vec_id AS VARCHAR)) AS term, round(score, 6) AS score
    FROM r WHERE rank <= 10""",
)
def topic_nearest_words(spark, sf_dir):
    df = vectors(spark, sf_dir)
    words = df.select(F.concat(F.lit("w"), F.col("vec_id")).alias("term"), F.col("embedding").alias("vector"))
    return emb.topic_nearest_words(words, emb.topic_centroids(df)).select("topic", "rank", "term", r6("score", "score"))


@register(
    "hierarchical_reduction",
    f"""WITH RECURSIVE {CENT}, gsize AS (SELECT label AS topic, count(*) AS size FROM embeddings GROUP BY label),
    gcell AS (SELECT a.topic AS i, b.topic AS j, list_dot_product(a.vec, b.vec) AS x FROM cent a CROSS JOIN cent b),
    {merge_cte(4)} SELECT CAST(topic AS INT) AS orig_topic, reduced_topic FROM grouped""",
)
def hierarchical_reduction(spark, sf_dir):
    return emb.hierarchical_reduction(emb.topic_centroids(vectors(spark, sf_dir)), 4)


@register(
    "map_reduced_topics",
    "SELECT vec_id, CASE WHEN label < 8 THEN label % 4 ELSE -1 END AS topic FROM embeddings",
)
def map_reduced_topics(spark, sf_dir):
    df = vectors(spark, sf_dir)
    # Topics 8 and 9 have no entry.
    lookup = df.select("topic").distinct().filter("topic < 8").selectExpr("topic AS orig_topic", "topic % 4 AS reduced_topic")
    return emb.map_reduced_topics(df, lookup).select("vec_id", "topic")


@register(
    "assignment_quality",
    f"""WITH {CENT}, q AS (SELECT CASE WHEN vec_id % 7 = 0 THEN -1 ELSE topic END AS topic, score FROM best WHERE rn = 1)
    SELECT count(*) AS documents, count(*) FILTER (topic <> -1) AS assigned,
        round(avg(score) FILTER (topic <> -1), 6) AS mean_score, round(median(score) FILTER (topic <> -1), 6) AS median_score
    FROM q""",
)
def assignment_quality(spark, sf_dir):
    df = vectors(spark, sf_dir)
    assigned = _with_outliers(emb.assign_to_nearest_topic(df.drop("topic"), emb.topic_centroids(df)))
    out = emb.assignment_quality(assigned)
    return out.select("documents", "assigned", r6("mean_score", "mean_score"), r6("median_score", "median_score"))


CURVE = """SELECT label + 2 AS k, sum(CAST(x AS DOUBLE) * x) AS sse, avg(CAST(x AS DOUBLE)) AS silhouette
    FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label"""


@register(
    "elbow_point",
    f"""WITH curve AS ({CURVE}), b AS (SELECT *, sse - 2 * lag(sse, 1) OVER (ORDER BY k) + lag(sse, 2) OVER (ORDER BY k) AS bend FROM curve)
    SELECT (SELECT k FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1) AS elbow_k,
        (SELECT k FROM b ORDER BY silhouette DESC, k LIMIT 1) AS best_silhouette_k""",
)
def elbow_point(spark, sf_dir):
    x = F.col("x").cast("double")
    curve = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.explode("embedding").alias("x"))
        .groupBy((F.col("label") + 2).alias("k"))
        .agg(F.sum(x * x).alias("sse"), F.avg(x).alias("silhouette"))
    )
    return emb.elbow_point(curve)


@register("kmeans_elbow")
def kmeans_elbow(spark, sf_dir):
    return emb.kmeans_elbow(table(spark, sf_dir, "embeddings"))


@register("embed_documents")
def embed_documents(spark, sf_dir):
    docs, _ = emb.embed_word2vec(tokens(spark, sf_dir), size=32)
    # a plain explode filters by the array's size, and would embed every document twice for it
    return docs.select("doc_id", F.posexplode_outer("embedding").alias("pos", "x"))


PMI_TERMS, PMI_WINDOW = 500, 5
_SHIFTED = " UNION ALL ".join(f"SELECT x.term AS a, y.term AS b FROM k x JOIN k y ON x.doc_id = y.doc_id AND y.i = x.i + {d}" for d in range(1, PMI_WINDOW + 1))


@register(
    "pmi_cells",
    f"""WITH {WORD_LISTS_CTE},
    p AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS i FROM t),
    v AS (SELECT term FROM p GROUP BY term HAVING count(*) >= 2 ORDER BY count(*) DESC, term LIMIT {PMI_TERMS}),
    k AS (SELECT p.* FROM p JOIN v USING (term)),
    pairs AS ({_SHIFTED}),
    c AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) GROUP BY a, b),
    s AS (SELECT a, sum(n) AS s FROM c GROUP BY a)
    SELECT c.a AS term, c.b AS near_term, c.n, round(ln(c.n * (SELECT CAST(sum(n) AS DOUBLE) FROM c) / (CAST(x.s AS DOUBLE) * y.s)), 6) AS pmi
    FROM c JOIN s x ON x.a = c.a JOIN s y ON y.a = c.b
    WHERE ln(c.n * (SELECT CAST(sum(n) AS DOUBLE) FROM c) / (CAST(x.s AS DOUBLE) * y.s)) > 0""",
)
def pmi_cells(spark, sf_dir):
    """Positive mutual information of the 500 most frequent terms within five words: what the second encoder factorises."""
    df = materialise(tokens(spark, sf_dir).select("tokens"), "tokens")  # a cached list of words is not compressed
    terms, _ = encoders.bounded_vocabulary(df, "tokens", 2, PMI_TERMS)
    pairs = materialise(encoders.cooccurrences(df, terms, window=PMI_WINDOW), "pairs")
    names = F.broadcast(spark.createDataFrame(list(enumerate(terms)), "a int, term string"))
    cells = encoders.positive_pmi(pairs).join(pairs, ["a", "b"]).join(names, "a")
    cells = cells.join(names.select(F.col("a").alias("b"), F.col("term").alias("near_term")), "b")
    return cells.select("term", "near_term", "n", r6("pmi", "pmi"))


def _reduced(spark, sf_dir):
    return emb.reduce_dims(table(spark, sf_dir, "embeddings"))


@register("reduce_dims")
def reduce_dims(spark, sf_dir):
    return _reduced(spark, sf_dir).select("vec_id", F.posexplode("reduced").alias("pos", "x"))


@register("reduce_dims_neighbours")
def reduce_dims_neighbours(spark, sf_dir):
    """Coordinates from the neighbour graph of all vectors, in place of main directions."""
    out = neighbours.reduce_neighbours(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.posexplode("reduced").alias("pos", "x"))


@register("density_cluster")
def density_cluster(spark, sf_dir):
    return density.density_cluster(_reduced(spark, sf_dir)).select("vec_id", "label", "topic")
