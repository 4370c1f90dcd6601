"""Batch retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from subventa.functions.text import hypothetical_descriptions
from subventa.functions.trigram import similarity, trigrams
from subventa.functions.vectors import l2_normalise
from subventa.operators import cache as K
from subventa.operators import retrieve as R
from subventa.operators.dense import approximate_top_k, dense_top_k, projection_lines
from subventa.operators.fusion import reciprocal_rank_fusion
from subventa.operators.order import blocked_rank, top_per_key
from subventa.operators.similarity_join import similarity_join
from subventa.operators.sparse import sparse_top_k
from subventa.operators.vector_index import build_index, index_top_k
from subventa.plans.corpora import DOCUMENTS_SQL, QUERIES_SQL, documents_corpus, search_queries
from subventa.plans.registry import query, table
from subventa.sources.shared import shared_path

# --- vectors -------------------------------------------------------------------


def _dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _cosine_sql(a: str, b: str) -> str:
    return f"round({_dot_sql(a, b)} / (sqrt({_dot_sql(a, a)}) * sqrt({_dot_sql(b, b)})), 9)"


@query(
    "vector_normalise",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * label) AS e FROM embeddings),
    n AS (SELECT vec_id, e, sqrt({_dot_sql("e", "e")}) AS norm FROM v)
    SELECT vec_id, unnest(range(0, len(e))) AS dim, round(unnest(list_transform(e, lambda x: CASE WHEN norm = 0 THEN x ELSE x / norm END)), 9) AS x FROM n""",
)
def vector_normalise(spark, sf_dir):
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label"))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalise(scaled).alias("e"))
    return unit.select("vec_id", F.posexplode("e").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 9).alias("x")
    )


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    corpus = e.select(
        F.col("vec_id").alias("grant_id"),
        "embedding",
        F.concat(F.lit("p"), F.col("label").cast("string")).alias("portal"),
        F.when(F.col("label") < 5, "DE").otherwise("EU").alias("country"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return e.select(F.col("vec_id").alias("qid"), "embedding", "label"), corpus


_VECTOR_CORPUS_SQL = "SELECT vec_id AS grant_id, embedding, 'p' || label AS portal, CASE WHEN label < 5 THEN 'DE' ELSE 'EU' END AS country, label FROM embeddings"


@query(
    "dense_top_k",
    f"""WITH c AS ({_VECTOR_CORPUS_SQL}), s AS (SELECT q.vec_id AS qid, c.grant_id, {_cosine_sql("q.embedding", "c.embedding")} AS similarity
      FROM embeddings q CROSS JOIN c),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, grant_id) - 1 AS rank FROM s)
    SELECT qid, grant_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10""",
)
def dense(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    return dense_top_k(queries, corpus, 10).withColumn("similarity", F.round("similarity", 6))


@query(
    "dense_top_k_filtered",
    f"""WITH c AS ({_VECTOR_CORPUS_SQL}), q AS (SELECT vec_id AS qid, embedding, CASE WHEN label >= 7 THEN 'p' || label END AS portal,
        CASE WHEN label < 3 THEN 'DE' WHEN label < 6 THEN 'EU' END AS country FROM embeddings),
    s AS (SELECT qid, c.grant_id, {_cosine_sql("q.embedding", "c.embedding")} AS similarity FROM q JOIN c
      ON (q.portal IS NULL OR q.portal = c.portal) AND (q.country IS NULL OR q.country = c.country)),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, grant_id) - 1 AS rank FROM s)
    SELECT qid, grant_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10""",
)
def dense_filtered(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    label = F.col("label")
    asked = queries.withColumn(
        "portal", F.when(label >= 7, F.concat(F.lit("p"), label.cast("string")))
    ).withColumn("country", F.when(label < 3, "de").when(label < 6, "eu"))
    return dense_top_k(asked, corpus, 10).withColumn("similarity", F.round("similarity", 6))


def _key_sql(table_no: int) -> str:
    """Sign key of `embedding` along one table's lines, written out."""
    lines = projection_lines(64, 8, 4, 42)[table_no].T
    bits = [f"CASE WHEN {_dot_sql('embedding', '[' + ','.join(str(int(x)) for x in line) + ']')} >= 0 THEN {1 << i} ELSE 0 END" for i, line in enumerate(lines)]
    return " + ".join(bits)


@query(
    "dense_approximate",
    f"""WITH v AS (SELECT vec_id, label, embedding, {", ".join(f"{_key_sql(t)} AS k{t}" for t in range(4))} FROM embeddings),
    m AS (SELECT q.vec_id AS qid, c.vec_id AS grant_id, {_cosine_sql("q.embedding", "c.embedding")} AS s FROM v q, v c
      WHERE {" OR ".join(f"bit_count(xor(q.k{t}, c.k{t})) <= 2" for t in range(4))})
    SELECT qid, grant_id, round(s, 6) AS similarity, CAST(row_number() OVER w - 1 AS INTEGER) AS rank FROM m
    WINDOW w AS (PARTITION BY qid ORDER BY s DESC, grant_id) QUALIFY row_number() OVER w <= 10""",
)
def dense_approximate(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    return approximate_top_k(queries, corpus, 10).withColumn("similarity", F.round("similarity", 6))


@query(
    "dense_index_top_k",
    f"""WITH c AS ({_VECTOR_CORPUS_SQL}), s AS (SELECT q.vec_id AS qid, c.grant_id, {_cosine_sql("q.embedding", "c.embedding")} AS similarity
      FROM embeddings q CROSS JOIN c WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, grant_id) - 1 AS rank FROM s)
    SELECT qid, grant_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 10""",
)
def dense_index(spark, sf_dir):
    """Exact search in stored lists: the angle bound tells which lists a query need not read."""
    queries, corpus = _vectors(spark, sf_dir)
    index = build_index(corpus, shared_path(spark, "index"), lists=32)
    hits = index_top_k(queries.filter("qid % 100 = 0"), index, 10, probes=4, exact=True)
    return hits.withColumn("similarity", F.round("similarity", 6))


# --- trigrams ------------------------------------------------------------------


def grams_sql(expr: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    per_word = "list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: ('  ' || w || ' ')[i:i + 2])"
    return f"list_distinct(flatten(list_transform({words}, lambda w: {per_word})))"


@query(
    "trigram_similarity",
    f"""WITH g AS (SELECT p_partkey, {grams_sql("p_name")} AS a, {grams_sql("p_type || ' ' || p_brand || ' ring'")} AS b FROM part)
    SELECT p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) AS score FROM g""",
)
def trigram_similarity(spark, sf_dir):
    other = F.concat("p_type", F.lit(" "), "p_brand", F.lit(" ring"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(similarity(F.col("p_name"), other), 9).alias("score"))


# Text leg over whole titles and whole summaries.
_TEXT_LEG = f"""
dg AS MATERIALIZED (SELECT grant_id, field, len(g) AS d_size, unnest(g) AS gram FROM (
    SELECT grant_id, 0 AS field, {grams_sql("title")} AS g FROM c WHERE deleted_at IS NULL
    UNION ALL SELECT grant_id, 1 AS field, {grams_sql("summary")} AS g FROM c WHERE deleted_at IS NULL)),
qg AS MATERIALIZED (SELECT qid, len(g) AS q_size, unnest(g) AS gram FROM (SELECT qid, {grams_sql("query")} AS g FROM q)),
ov AS (SELECT qid, grant_id, field, q_size, d_size, count(*) AS shared FROM dg JOIN qg USING (gram) GROUP BY ALL),
sp AS (SELECT qid, grant_id, max(shared / (q_size + d_size - shared)) AS score FROM ov
    WHERE shared / (q_size + d_size - shared) >= 0.3 GROUP BY ALL),
sparse AS (SELECT qid, grant_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grant_id) - 1 AS rank FROM sp)
"""


def _dense_leg(name: str, queries: str) -> str:
    return f"""{name} AS (SELECT qid, grant_id, similarity, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, grant_id) - 1 AS rank
    FROM (SELECT v.qid, c.grant_id, {_cosine_sql("v.embedding", "c.embedding")} AS similarity FROM {queries} v CROSS JOIN c
      WHERE c.deleted_at IS NULL AND c.embedding IS NOT NULL))"""


def _fused_leg(name: str, dense_name: str) -> str:
    return f"""{name}_u AS (SELECT qid, grant_id, d.rank AS dense_rank, s.rank AS sparse_rank,
      coalesce(1.0 / (60 + d.rank + 1), 0) + coalesce(1.0 / (60 + s.rank + 1), 0) AS rrf_score
    FROM (SELECT * FROM {dense_name} WHERE rank < 50) d FULL OUTER JOIN (SELECT * FROM sparse WHERE rank < 50) s USING (qid, grant_id)),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST,
      sparse_rank ASC NULLS LAST, grant_id) - 1 AS fused_rank FROM {name}_u)"""


def _reranked_leg(name: str, fused: str) -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, fused_rank) - 1 AS rank FROM (
      SELECT f.*, CASE WHEN contains(lower(c.title || chr(10) || c.summary), lower(q.query)) THEN 10.0 ELSE 1.0 END AS rerank_score
      FROM {fused} f JOIN c USING (grant_id) JOIN q USING (qid) WHERE fused_rank < 50))"""


BASE_SQL = f"WITH c AS MATERIALIZED ({DOCUMENTS_SQL}), q AS MATERIALIZED ({QUERIES_SQL}), {_TEXT_LEG}"
HYBRID_SQL = f"{BASE_SQL}, {_dense_leg('dense', 'q')}, {_fused_leg('fused', 'dense')}, {_reranked_leg('reranked', 'fused')}"


@query("sparse_top_k", f"{BASE_SQL} SELECT qid, grant_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank < 50")
def sparse(spark, sf_dir):
    hits = sparse_top_k(search_queries(spark, sf_dir), documents_corpus(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 9))


@query(
    "sparse_top_k_filtered",
    f"""{BASE_SQL}, f AS (SELECT sp.qid, sp.grant_id, score FROM sp JOIN c USING (grant_id) JOIN q USING (qid) WHERE c.country = CASE WHEN q.label < 5 THEN 'EN' ELSE c.country END),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, grant_id) - 1 AS rank FROM f)
    SELECT qid, grant_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank < 50""",
)
def sparse_filtered(spark, sf_dir):
    asked = search_queries(spark, sf_dir).withColumn("country", F.when(F.col("label") < 5, "en"))
    return sparse_top_k(asked, documents_corpus(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query("sparse_join_top_k", f"{BASE_SQL} SELECT qid, grant_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank < 50")
def sparse_by_join(spark, sf_dir):
    """The way of batches of any size."""
    hits = sparse_top_k(search_queries(spark, sf_dir), documents_corpus(spark, sf_dir), max_broadcast_grams=0)
    return hits.withColumn("score", F.round("score", 9))


@query(
    "similar_titles",
    f"""WITH t AS (SELECT min(grant_id) AS id, title FROM ({DOCUMENTS_SQL}) GROUP BY title),
    s AS (SELECT id, {grams_sql("title")} AS g FROM t), g AS MATERIALIZED (SELECT id, len(g) AS size, unnest(g) AS gram FROM s),
    o AS (SELECT a.id, b.id AS like_id, a.size + b.size AS sizes, count(*) AS shared FROM g a JOIN g b USING (gram) WHERE a.id < b.id GROUP BY ALL)
    SELECT id, like_id, round(shared / (sizes - shared), 9) AS score FROM o WHERE shared / (sizes - shared) >= 0.8""",
)
def similar_titles(spark, sf_dir):
    """Different titles of similar wording, each by the smallest id that has it."""
    titles = documents_corpus(spark, sf_dir).groupBy("title").agg(F.min("grant_id").alias("id"))
    sets = titles.select(F.col("id").alias("l_id"), trigrams(F.col("title")).alias("grams"))
    pairs = similarity_join(sets, None, 0.8)
    return pairs.select(F.col("l_id").alias("id"), F.col("r_id").alias("like_id"), F.round("score", 9).alias("score"))


# --- fusion ----------------------------------------------------------------------

# Two rankings of the customers' orders, by date and by price, with the candidates
# a leg hands on; one list repeats ids.
_RANKINGS_SQL = """
a AS (SELECT * FROM (SELECT o_custkey AS qid, o_orderkey AS grant_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS rank
  FROM orders WHERE o_orderstatus <> 'P') WHERE rank < 50),
b AS (SELECT * FROM (SELECT o_custkey AS qid, o_orderkey AS grant_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank
  FROM orders WHERE o_orderstatus <> 'F') WHERE rank < 50)
"""


@query(
    "rank_fusion",
    f"""WITH {_RANKINGS_SQL}, u AS (SELECT qid, grant_id, a.rank AS dense_rank, b.rank AS sparse_rank,
      coalesce(1.0 / (60 + a.rank + 1), 0) + coalesce(1.0 / (60 + b.rank + 1), 0) AS rrf_score
      FROM a FULL OUTER JOIN b USING (qid, grant_id))
    SELECT qid, grant_id, round(rrf_score, 9) AS rrf_score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank,
      CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, grant_id) - 1 AS INTEGER) AS fused_rank
    FROM u""",
)
def rank_fusion(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "qid", "o_orderkey": "grant_id"})

    def ranked(df, column):
        best = top_per_key(df, ["qid"], [F.desc(column), F.col("grant_id")], R.DENSE_CANDIDATES)
        return best.select("qid", "grant_id", "rank")

    by_date = ranked(orders.filter(F.col("o_orderstatus") != "P"), "o_orderdate")
    by_price = ranked(orders.filter(F.col("o_orderstatus") != "F"), "o_totalprice")
    # a list that names an id twice counts its first place only
    repeated = by_date.unionByName(by_date.withColumn("rank", F.col("rank") + 1000))
    return reciprocal_rank_fusion(repeated, by_price).withColumn("rrf_score", F.round("rrf_score", 9))


# --- modes -------------------------------------------------------------------------

_HIT_SQL = """qid, grant_id, CAST({rank} AS INTEGER) AS rank, round({final}, 9) AS final_score, CAST({d} AS INTEGER) AS dense_rank,
  CAST({s} AS INTEGER) AS sparse_rank, {rrf} AS rrf_score, {rr} AS rerank_score"""

_NULL = "CAST(NULL AS DOUBLE)"
_DENSE_HITS = _HIT_SQL.format(rank="rank", final="similarity", d="rank", s="NULL", rrf=_NULL, rr=_NULL)
_HYBRID_HITS = _HIT_SQL.format(rank="fused_rank", final="rrf_score", d="dense_rank", s="sparse_rank", rrf="round(rrf_score, 9)", rr=_NULL)
_RERANK_HITS = _HIT_SQL.format(rank="rank", final="rerank_score", d="dense_rank", s="sparse_rank", rrf="round(rrf_score, 9)", rr="CAST(rerank_score AS DOUBLE)")


def _rounded(hits):
    return hits.withColumns({"final_score": F.round("final_score", 9), "rrf_score": F.round("rrf_score", 9)})


def _retrieved(spark, sf_dir, mode):
    return R.retrieve(search_queries(spark, sf_dir), documents_corpus(spark, sf_dir), mode, 10, R.contains_scorer)


@query("retrieve_dense", f"WITH c AS ({DOCUMENTS_SQL}), q AS ({QUERIES_SQL}), {_dense_leg('dense', 'q')} SELECT {_DENSE_HITS} FROM dense WHERE rank < 10")
def retrieve_dense(spark, sf_dir):
    return _rounded(_retrieved(spark, sf_dir, R.DENSE).hits)


@query("retrieve_hybrid", f"{HYBRID_SQL} SELECT {_HYBRID_HITS} FROM fused WHERE fused_rank < 10")
def retrieve_hybrid(spark, sf_dir):
    return _rounded(_retrieved(spark, sf_dir, R.HYBRID).hits)


@query("retrieve_hybrid_rerank", f"{HYBRID_SQL} SELECT {_RERANK_HITS} FROM reranked WHERE rank < 10")
def retrieve_rerank(spark, sf_dir):
    return _rounded(_retrieved(spark, sf_dir, R.HYBRID_RERANK).hits)


@query(
    "retrieve_stage_counts",
    f"""{HYBRID_SQL} SELECT qid, (SELECT count(*) FROM dense d WHERE d.qid = q.qid AND rank < 50) AS dense_count,
      (SELECT count(*) FROM sparse s WHERE s.qid = q.qid AND rank < 50) AS sparse_count,
      (SELECT count(*) FROM fused f WHERE f.qid = q.qid) AS fused_count,
      (SELECT count(*) FROM fused f WHERE f.qid = q.qid AND fused_rank < 50) AS rerank_count FROM q""",
)
def stage_counts(spark, sf_dir):
    return R.stage_counts(_retrieved(spark, sf_dir, R.HYBRID_RERANK), search_queries(spark, sf_dir))


@query(
    "retrieve_assembled",
    f"""{HYBRID_SQL} SELECT f.qid, f.grant_id, CAST(f.fused_rank AS INTEGER) AS rank, round(f.rrf_score, 9) AS final_score, c.title, c.portal, c.source_doc_id
    FROM fused f JOIN c USING (grant_id) WHERE fused_rank < 10 AND c.deleted_at IS NULL""",
)
def assembled(spark, sf_dir):
    found = _retrieved(spark, sf_dir, R.HYBRID)
    hits = found.hits.select("qid", "grant_id", "rank", F.round("final_score", 9).alias("final_score"))
    rows = R.assemble(hits, documents_corpus(spark, sf_dir), ["title", "portal", "source_doc_id"], found.small)
    return rows.select("qid", "grant_id", "rank", "final_score", "title", "portal", "source_doc_id")


@query(
    "candidate_flatten",
    f"""WITH c AS ({DOCUMENTS_SQL}), q AS ({QUERIES_SQL}), {_dense_leg('dense', 'q')}
    SELECT d.qid, d.grant_id, CAST(d.rank AS INTEGER) AS rank, c.title, c.portal, c.summary,
      CASE WHEN length(trim(c.body, ' ' || chr(10))) > 600 THEN trim(c.body, ' ' || chr(10))[:600] || '…' ELSE trim(c.body, ' ' || chr(10)) END AS body_excerpt
    FROM dense d JOIN c USING (grant_id) WHERE d.rank < 8""",
)
def candidates(spark, sf_dir):
    found = _retrieved(spark, sf_dir, R.DENSE)
    flat = R.flatten_candidates(found.hits, documents_corpus(spark, sf_dir), found.small)
    return flat.select("qid", "grant_id", "rank", "title", "portal", "summary", "body_excerpt")


@query(
    "fact_filters",
    """SELECT c_custkey AS qid, CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN 'EU' ELSE 'DE' END END AS country FROM customer""",
)
def fact_filters(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    asked = customers.select(F.col("c_custkey").alias("qid"), F.col("c_name").alias("query"))
    facts = customers.select(
        F.col("c_custkey").alias("qid"),
        F.when(F.col("c_acctbal") >= 0, F.when(F.col("c_mktsegment") == "MACHINERY", "eu").otherwise("de")).alias("country"),
        F.col("c_mktsegment").alias("sector"),
    )
    return R.apply_fact_filters(asked, facts).select("qid", "country")


# --- expansion -----------------------------------------------------------------------


@query(
    "vector_mean_pool",
    f"""WITH m AS (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS dim,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, dim),
      n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY label)
    SELECT label, dim, round(x / norm, 9) AS x FROM m JOIN n USING (label)""",
)
def vector_mean_pool(spark, sf_dir):
    pooled = R.mean_pool(table(spark, sf_dir, "embeddings"), "label")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), F.round("x", 9).alias("x")
    )


# Every vector is dealt to one query of its label as a hypothetical, in id order;
# queries of label 0 get none and fall back to their own vector.
NUMBERED_SQL = """
qn AS (SELECT qid, label, row_number() OVER (PARTITION BY label ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM q)
"""
_HYPO_SQL = f"""{NUMBERED_SQL},
hy AS (SELECT qn.qid, e.vec_id AS pos, e.embedding FROM qn JOIN embeddings e ON e.label = qn.label AND e.vec_id % qn.n = qn.i AND e.vec_id <> qn.qid WHERE qn.label > 0),
hx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rn FROM hy) WHERE rn <= 3),
hm AS (SELECT qid, dim, avg(x) AS x FROM (SELECT qid, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM hx) GROUP BY qid, dim),
hp AS (SELECT qid, list(x ORDER BY dim) AS pooled FROM hm GROUP BY qid),
hq AS (SELECT q.qid, coalesce(hp.pooled, CAST(q.embedding AS DOUBLE[])) AS embedding, hp.pooled IS NOT NULL AS used_hyde FROM q LEFT JOIN hp USING (qid))
"""


def deal_to_queries(rows, queries, id_col):
    """Each row goes to one query of its label, so the result is as long as `rows`."""
    sizes = queries.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    numbered = blocked_rank(queries.select("qid", "label"), ["label"], [F.col("qid")], F.floor(F.col("qid") / 1000), "_i")
    turn = F.pmod(F.col(id_col), F.col("_n"))
    return rows.join(sizes, "label").withColumn("_i", turn).join(numbered, ["label", "_i"]).drop("_n", "_i")


def hypothetical_rows(spark, sf_dir, q=None):
    q = search_queries(spark, sf_dir) if q is None else q
    dealt = deal_to_queries(table(spark, sf_dir, "embeddings").filter(F.col("label") > 0), q, "vec_id")
    return dealt.filter(F.col("vec_id") != F.col("qid")).select("qid", F.col("vec_id").alias("pos"), "embedding")


@query(
    "query_expansion",
    f"""WITH c AS ({DOCUMENTS_SQL}), q AS ({QUERIES_SQL}), {_HYPO_SQL}, {_dense_leg('dense', 'hq')}
    SELECT d.qid, d.grant_id, round(d.similarity, 6) AS similarity, CAST(d.rank AS INTEGER) AS rank, hq.used_hyde
    FROM dense d JOIN hq USING (qid) WHERE d.rank < 10""",
)
def query_expansion(spark, sf_dir):
    asked = R.expand_queries(search_queries(spark, sf_dir), hypothetical_rows(spark, sf_dir))
    hits = dense_top_k(asked, documents_corpus(spark, sf_dir), 10)
    return hits.join(asked.select("qid", "used_hyde"), "qid").withColumn("similarity", F.round("similarity", 6))


# Replies of three shapes: a JSON object, a JSON array, bullet lines.
@query(
    "hypothetical_parse",
    """WITH t AS (SELECT conv_id, turn, role, text FROM conversations),
    d AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN [text, role || ' ' || turn] WHEN 'system' THEN [role, text]
      ELSE list_transform(list_filter(regexp_split_to_array(text, '[\\n\\r]'), lambda s: length(trim('* ' || s)) > 20), lambda s: trim(trim(s), '-•*')) END AS ds FROM t)
    SELECT conv_id, turn, unnest(range(0, len(ds))) AS pos, trim(unnest(ds)) AS description FROM d""",
)
def hypothetical_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    text, role = F.col("text"), F.col("role")
    as_object = F.to_json(F.struct(F.array(text, F.concat(role, F.lit(" "), F.col("turn").cast("string"))).alias("descriptions")))
    reply = (
        F.when(role == "user", F.concat(F.lit("```json\n"), as_object, F.lit("\n```")))
        .when(role == "system", F.to_json(F.array(role, text)))
        .otherwise(F.concat(F.lit("- "), F.regexp_replace(text, "\n", "\n* ")))
    )
    found = rows.select("conv_id", "turn", F.posexplode(hypothetical_descriptions(reply)).alias("pos", "description"))
    return found.withColumn("pos", F.col("pos").cast("bigint"))


# --- semantic cache --------------------------------------------------------------------

# Every document vector was cached at some moment of the two days before `now`;
# two scopes keep filtered and unfiltered answers apart.
_NOW = "2024-01-03 00:00:00"
_CACHE_SQL = f"""
entries AS (SELECT vec_id AS id, 'query ' || vec_id AS query, embedding, CASE WHEN label < 5 THEN 'DE' END AS country,
  TIMESTAMP '{_NOW}' - to_minutes(CAST(label * 200 + 1 AS BIGINT)) - to_seconds(CAST(vec_id AS DOUBLE)) AS cached_at FROM embeddings)
"""


def _key_sql(v: str) -> str:
    byte = f"CAST(floor(CAST(trunc((CAST(x AS DOUBLE) + 1.0) * 32767) AS BIGINT) % 65536 / 256) AS BIGINT)"
    return f"left(sha256(unhex(array_to_string(list_transform({v}[1:32], lambda x: lpad(to_hex({byte}), 2, '0')), ''))), 24)"


def _entries(spark, sf_dir):
    label, key = F.col("label"), F.col("vec_id")
    at = F.timestamp_micros(
        F.unix_micros(F.lit(_NOW).cast("timestamp")) - ((label * 200 + 1) * 60 + key).cast("bigint") * 1_000_000
    )
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("query "), key.cast("string")).alias("query"),
        "embedding",
        F.when(label < 5, "DE").alias("country"),
        at.alias("cached_at"),
    )


def _now():
    return F.lit(_NOW).cast("timestamp")


def _cache_table(spark, sf_dir):
    fresh = _entries(spark, sf_dir)
    empty = fresh.withColumn("key", F.lit("")).filter(F.lit(False))
    return K.store(empty, fresh, _now())


_STORED_SQL = f"""{_CACHE_SQL}, keyed AS (SELECT *, {_key_sql("embedding")} AS key FROM entries),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, country ORDER BY cached_at DESC, query DESC) AS rn FROM keyed) WHERE rn = 1),
held AS (SELECT * FROM latest WHERE cached_at > TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR ORDER BY cached_at DESC, key LIMIT 200)"""


@query("cache_keys", f"SELECT vec_id, {_key_sql('embedding')} AS key FROM embeddings")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", K.cache_key(F.col("embedding")).alias("key"))


@query("cache_store", f"WITH {_STORED_SQL} SELECT key, query, country, cached_at FROM held")
def cache_store(spark, sf_dir):
    return _cache_table(spark, sf_dir).select("key", "query", "country", "cached_at")


@query(
    "cache_lookup",
    f"""WITH {_STORED_SQL}, s AS (SELECT e.vec_id AS qid, held.key, held.query AS cached_for_query, held.cached_at,
        round({_dot_sql("e.embedding", "held.embedding")}, 9) AS similarity
      FROM (SELECT *, CASE WHEN label < 5 THEN 'DE' END AS country FROM embeddings) e JOIN held ON e.country IS NOT DISTINCT FROM held.country),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, cached_at DESC, key) AS rn FROM s WHERE similarity >= 0.5)
    SELECT qid, key, cached_for_query, round(similarity, 6) AS similarity FROM r WHERE rn = 1""",
)
def cache_lookup(spark, sf_dir):
    """At a threshold low enough for near neighbours to count, not just copies."""
    asked = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), "embedding", F.when(F.col("label") < 5, "DE").alias("country")
    )
    found = K.lookup(asked, _cache_table(spark, sf_dir), _now(), min_similarity=0.5)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(
    "cache_eligibility",
    """SELECT event_id, event_type = 'view' AND value < 50 AS eligible FROM events""",
)
def cache_eligibility(spark, sf_dir):
    mode = F.when(F.col("event_type") == "view", R.HYBRID_RERANK).when(F.col("event_type") == "click", R.HYBRID).otherwise(R.DENSE)
    return table(spark, sf_dir, "events").select("event_id", K.eligible(mode, F.col("value") >= 50).alias("eligible"))


@query(
    "cache_rehydrate",
    f"""WITH c AS ({DOCUMENTS_SQL}), q AS ({QUERIES_SQL}), {_dense_leg('dense', 'q')}
    SELECT 'q' || d.qid AS key, CAST(d.rank AS INTEGER) AS position, d.grant_id, round(d.similarity, 6) AS final_score, c.title
    FROM dense d JOIN c USING (grant_id) WHERE d.rank < 10 AND c.n_chars < 5000""",
)
def cache_rehydrate(spark, sf_dir):
    """Hits stored per query, then joined to a corpus that has lost its long documents."""
    corpus = documents_corpus(spark, sf_dir)
    found = _retrieved(spark, sf_dir, R.DENSE)
    hits = found.hits
    page = F.sort_array(F.collect_list(F.struct("rank", "grant_id", F.round("final_score", 6).alias("final_score"))))
    entries = hits.groupBy(F.concat(F.lit("q"), F.col("qid").cast("string")).alias("key")).agg(page.alias("hits"))
    rows = K.rehydrate(entries, corpus.filter(F.col("n_chars") < 5000), ["title"], found.small)
    return rows.select("key", F.col("position").cast("int").alias("position"), "grant_id", "final_score", "title")


