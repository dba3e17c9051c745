"""Queries of the operators for training data, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import canonical, clusters, leaks, packing, pii, pii_training, topn, vectors
from strandloom.tables import col, is_missing, read

# ---- p1 ---------------------------------------------------------------------


def _p1_matched(spark: SparkSession, d: str) -> DataFrame:
    entries = canonical.reference_entries(read(spark, d, "tissue_terms"), "term_id", "term", "synonyms")
    samples = read(spark, d, "osdr_samples").select(F.lit("osdr_samples").alias("src"), F.col("row_id").cast("string").alias("rec_key"), col("study.characteristics.material type").alias("value"))
    meta = read(spark, d, "osdr_metadata").select(F.lit("osdr_metadata").alias("src"), F.col("sample_key").alias("rec_key"), F.col("tissue").alias("value"))
    return canonical.match_values(samples.unionByName(meta), "value", entries)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1_matched(spark, d).select("src", "rec_key", "term_id").distinct()


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched(_p1_matched(spark, d), "value")


# ---- p6 ---------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "hits_df").select("hit_id", "sample_key", "score", F.when(~is_missing(F.col("gse")), F.col("gse")).alias("gse"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in ("sample_key", "gse")])
    rows = hits.filter(F.col("score").isNotNull() & ~F.isnan("score")).select(F.explode(kinds).alias("g"), "score", F.col("hit_id").alias("id")).select("g.kind", "g.key", "score", "id")
    return topn.top_n(rows, 5).select(F.col("kind").alias("group_kind"), F.col("key").alias("group_key"), F.col("id").alias("hit_id"))


# ---- p5 ---------------------------------------------------------------------

DIM = 512


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.similar(read(spark, d, "osdr_query_embeddings"), "sample_key", "embedding", read(spark, d, "sample_embeddings"), "global_index", "embedding", DIM)
    return near.select(F.col("q").alias("sample_key"), F.col("i").alias("global_index")).distinct()


# ---- p7 ---------------------------------------------------------------------


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    members, described = clusters.cluster(read(spark, d, "osdr_query_embeddings"), "sample_key", "embedding", DIM)
    return members.join(described, "cluster_key").select(F.col("key").alias("sample_key"), "cluster_key", "typical_key").distinct()


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    """cluster_key, size, typical_key, tissue, n_samples: a row for each reference tissue of a cluster's samples ('' where none is known)."""
    members, described = clusters.cluster(read(spark, d, "osdr_query_embeddings"), "sample_key", "embedding", DIM)
    terms = read(spark, d, "tissue_terms")
    meta = read(spark, d, "osdr_metadata").select(F.col("sample_key").alias("key"), "tissue").distinct()
    meant = canonical.match_values(meta, "tissue", canonical.reference_entries(terms, "term_id", "term", "synonyms"))
    named = meant.join(terms.select("term_id", "term"), "term_id").select("key", "term").distinct()
    per = members.join(named, "key", "left").groupBy("cluster_key", F.coalesce("term", F.lit("")).alias("tissue")).agg(F.count(F.lit(1)).alias("n_samples"))
    return described.join(per, "cluster_key").select("cluster_key", "size", "typical_key", "tissue", "n_samples")


def p7_parts(spark: SparkSession, d: str) -> DataFrame:
    """sample_key, cluster_key, medoid_key: clusters that hold together only through others, split around their members of highest degree."""
    df = read(spark, d, "osdr_query_embeddings")
    members, _ = clusters.cluster(df, "sample_key", "embedding", DIM)
    return clusters.split_loose(df, "sample_key", "embedding", DIM, members).select(F.col("key").alias("sample_key"), "cluster_key", "medoid_key")


# ---- p8 ---------------------------------------------------------------------


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "piece", "tokens", "container")


# ---- p9 ---------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """item_id, n_docs of the items that leaked."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


# ---- p10 --------------------------------------------------------------------


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(read(spark, d, "documents"), "doc_id", "text", pii_training.weights()).distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(read(spark, d, "documents"), "doc_id", "text", pii_training.weights())


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p5_found, p6_found, p7_found, p7_clusters, p7_parts, p8_assignment, p9_found, p9_items, p10_found, p10_redacted)}

_VALID = "embedding is not null and len(embedding) = 512 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_UNIT = "list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[])))"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)).replace("'", "''")  # full-width forms of the ASCII signs
_ASCII = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_WORDS = f"regexp_extract_all(lower(replace(replace(translate(nfc_normalize(text), '{_WIDE}', '{_ASCII}'), 'ﬁ', 'fi'), 'ﬂ', 'fl')), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = f"""with d as (select doc_id, {_WORDS} as w from documents where text is not null), i as (select item_id, {_WORDS} as w from eval_items where text is not null),
dg as (select distinct doc_id, array_to_string(w[p:p + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as p from d)),
ig as (select distinct item_id, array_to_string(w[p:p + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as p from i)),
f as (select distinct doc_id, item_id from dg join ig using (g))"""
SQL = {
    "p9_found": f"{_GRAMS} select doc_id, item_id from f",
    "p9_items": f"{_GRAMS} select item_id, count(*) as n_docs from f group by 1",
    "p5_found": f"""
with q as (select distinct sample_key, embedding from osdr_query_embeddings where {_VALID}), qu as (select sample_key, row_number() over () as n, {_UNIT} as v from q),
i as (select global_index, {_UNIT} as v from sample_embeddings where {_VALID}),
p as (select sample_key, n, global_index, list_dot_product(qu.v, i.v) as c from qu join i on true)
select distinct sample_key, global_index from (select * from p where c >= 0.9 - 1e-9 qualify row_number() over (partition by n order by round(c, 9) desc, global_index) <= 10)""",
    "p7_found": f"""
with recursive q as (select sample_key, {_UNIT} as v from (select sample_key, min(embedding) as embedding from osdr_query_embeddings where {_VALID} group by 1)),
e as (select a.sample_key as a, b.sample_key as b, list_dot_product(a.v, b.v) as c from q a join q b on a.sample_key <> b.sample_key),
r as (select sample_key as a, sample_key as b from q union select r.a, e.b from r join e on r.b = e.a and e.c >= 0.9 - 1e-9),
m as (select a as sample_key, min(b) as cluster_key, count(*) as n from r group by 1),
s as (select m.sample_key, m.cluster_key, round(avg(e.c), 9) as mean from m join m o on o.cluster_key = m.cluster_key and o.sample_key <> m.sample_key join e on e.a = m.sample_key and e.b = o.sample_key where m.n >= 3 group by 1, 2)
select sample_key, cluster_key, first_value(sample_key) over (partition by cluster_key order by mean desc, sample_key) as typical_key from s""",
    "p6_found": """
with h as (select distinct hit_id, sample_key, score, gse from hits_df where score is not null and not isnan(score)),
g as (select 'sample_key' as group_kind, sample_key as group_key, score, hit_id from h where sample_key is not null
  union all select 'gse', gse, score, hit_id from h where lower(trim(gse, e' \\t\\n\\r')) not in ('', 'na', 'n/a', 'nan', 'none')),
u as (select distinct * from g)
select group_kind, group_key, hit_id from u qualify row_number() over (partition by group_kind, group_key order by score desc, hit_id) <= 5""",
}
