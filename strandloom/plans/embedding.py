"""Vector queries: exact retrieval, neighbours, PCA, layouts, quality scores and gates."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import vec
from strandloom.operators import encoder, layout, pca
from strandloom.operators.knn import knn, nearer, scores
from strandloom.plans.registry import Registry
from strandloom.session import cut
from strandloom.tables import read

R = Registry()
query = R.query
DIM = 64
V = "embedding::double[]"
UNIT = f"u as (select vec_id, label, list_transform({V}, lambda x: x / sqrt(list_dot_product({V}, {V}))) as v from embeddings)"
PAIRS = f"{UNIT}, p as (select q.vec_id as qid, x.vec_id as id, q.label as qlabel, x.label as label, list_dot_product(q.v, x.v) as score from u q join u x on true where q.vec_id % 100 = 0)"


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return embeddings(spark, d).filter("vec_id % 100 = 0")


def neighbours(spark: SparkSession, d: str, k: int = 10, metric: str = "cosine", exclude_self: bool = False) -> DataFrame:
    return knn(asked(spark, d), "vec_id", "embedding", embeddings(spark, d), "vec_id", "embedding", DIM, k, metric, exclude_self)


def _topk(k: int, where: str = "true") -> str:
    return f"t as (select qid, id, qlabel, label, score, row_number() over (partition by qid order by round(score, 12) desc, id) as rank from p where {where} qualify rank <= {k})"


@query(f"with {PAIRS}, {_topk(10)} select qid, id, round(score, 6) as score, rank from t")
def knn_cosine(spark, d):
    return neighbours(spark, d).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"with {PAIRS}, {_topk(10, 'qid <> id')} select qid, id, round(score, 6) as score, rank from t")
def knn_self_exclude(spark, d):
    return neighbours(spark, d, exclude_self=True).select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"select x.vec_id as id, round(list_dot_product(q.embedding::double[], x.embedding::double[]), 6) as score from embeddings q join embeddings x on q.vec_id = 0 order by list_dot_product(q.embedding::double[], x.embedding::double[]) desc, id limit 7")
def topk_dot(spark, d):
    q = embeddings(spark, d).filter("vec_id = 0")
    return knn(q, "vec_id", "embedding", embeddings(spark, d), "vec_id", "embedding", DIM, 7, "dot").select("id", F.round("score", 6).alias("score"))


@query(f"with {PAIRS} select id, round(score, 6) as score from p where qid = 0 order by p.score desc, id limit 5")
def topk_single_query(spark, d):
    """One query: normalised once, then one dot product per row and a limit that keeps k rows a task."""
    q = embeddings(spark, d).filter("vec_id = 0").limit(1).select(vec.normalized(F.col("embedding"))).scalar()
    rows = embeddings(spark, d).select(F.col("vec_id").alias("id"), vec.normalized(F.col("embedding")).alias("v"), q.alias("q"))
    return rows.select("id", vec.dot(F.col("v"), F.col("q")).alias("s")).orderBy(F.desc("s"), "id").limit(5).select("id", F.round("s", 6).alias("score"))


@query(f"with {PAIRS}, {_topk(10)} select qid, id, round(score, 6) as score, rank, label::bigint as label from t")
def topk_annotated(spark, d):
    hits = neighbours(spark, d)
    return hits.join(embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label")), "id").select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "label")


@query(f"with {PAIRS}, {_topk(5)} select qid, id, rank, case when score >= 0.9 then 'near' else 'far' end as band, label::bigint as label, 'cached' as mode from t")
def search_hits(spark, d):
    """The retrieval path: stored vectors are used where the query has one."""
    from strandloom.plans.retrieval import search

    return search(asked(spark, d).select("vec_id", "embedding"), embeddings(spark, d), 5, DIM).join(
        embeddings(spark, d).select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label")), "id"
    ).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.when(F.col("score") >= 0.9, "near").otherwise("far").alias("band"), "label", "mode")


@query("select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 4) as sq from embeddings where vec_id = 7")
def query_vector_lookup(spark, d):
    return embeddings(spark, d).filter("vec_id = 7").select("vec_id", F.round(vec.dot(F.col("embedding"), F.col("embedding")), 4).alias("sq"))


@query(f"with {UNIT} select vec_id, round(sqrt(list_dot_product(v, v)), 6) as norm, round(v[1], 6) as first from u")
def l2_normalize(spark, d):
    return embeddings(spark, d).select("vec_id", vec.normalized(F.col("embedding")).alias("v")).select("vec_id", F.round(vec.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query(f"with {PAIRS} select qid, id, round(score, 6) as cosine, round(1 - score, 6) as distance from p")
def cosine_pairs(spark, d):
    p = scores(asked(spark, d), "vec_id", "embedding", embeddings(spark, d), "vec_id", "embedding", DIM, None)
    return p.select("qid", "id", F.round("score", 6).alias("cosine"), F.round(1 - F.col("score"), 6).alias("distance"))


@query("select x.vec_id as id, row_number() over (partition by q.vec_id order by (q.embedding[1]::double - x.embedding[1]::double)**2 + (q.embedding[2]::double - x.embedding[2]::double)**2, x.vec_id) as rank, q.vec_id as qid from embeddings q join embeddings x on q.vec_id % 100 = 0 and q.vec_id <> x.vec_id qualify rank <= 15")
def knn_euclidean(spark, d):
    flat = lambda df: df.select("vec_id", F.slice("embedding", 1, 2).alias("xy"))
    out = knn(flat(asked(spark, d)), "vec_id", "xy", flat(embeddings(spark, d)), "vec_id", "xy", 2, 15, "euclidean", True)
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"))


@query(f"with {PAIRS}, {_topk(15, 'qid <> id')}" + """,
 f as (select q.vec_id as qid, x.vec_id as id, row_number() over (partition by q.vec_id order by (q.embedding[1]::double - x.embedding[1]::double)**2 + (q.embedding[2]::double - x.embedding[2]::double)**2, x.vec_id) as r
  from embeddings q join embeddings x on q.vec_id % 100 = 0 and q.vec_id <> x.vec_id qualify r <= 15)
 select t.qid, round(count(f.id) / 15.0, 6) as recall from t left join f on f.qid = t.qid and f.id = t.id group by 1""")
def knn_recall(spark, d):
    true = neighbours(spark, d, 15, exclude_self=True).groupBy("qid").agg(F.collect_list("id").alias("a"))
    flat = knn_euclidean(spark, d).groupBy("qid").agg(F.collect_list("id").alias("b"))
    return true.join(flat, "qid", "left").select("qid", F.round(F.size(F.array_intersect("a", F.coalesce("b", F.array().cast("array<bigint>")))) / 15.0, 6).alias("recall"))


@query(f"with {PAIRS}, {_topk(25, 'qid <> id')} select round(avg((qlabel = label)::int), 6) as purity, count(*) as n_edges from t where qlabel <> 9 and label <> 9")
def label_purity(spark, d):
    """Share of neighbours with the query's label, over known labels (9 stands for unknown); no known edge gives null."""
    e = labelled_edges(spark, d, 25).filter("qlabel <> 9 and label <> 9")
    return e.agg(F.round(F.avg((F.col("qlabel") == F.col("label")).cast("int")), 6).alias("purity"), F.count(F.lit(1)).alias("n_edges"))


def labelled_edges(spark: SparkSession, d: str, k: int) -> DataFrame:
    lab = embeddings(spark, d).select("vec_id", "label")
    e = neighbours(spark, d, k, exclude_self=True)
    return e.join(lab.select(F.col("vec_id").alias("id"), "label"), "id").join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel")), "qid")


@query(f"with {PAIRS}, {_topk(10, 'qid <> id')} select qlabel::bigint as qlabel, label::bigint as label, count(*) as n from t group by 1, 2")
def neighbour_label_pairs(spark, d):
    return labelled_edges(spark, d, 10).groupBy(F.col("qlabel").cast("long").alias("qlabel"), F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PAIRS}, {_topk(10, 'qid <> id')} select (qid % 7 = id % 7) as same_study, (qlabel = label) as same_tissue, count(*) as n from t group by 1, 2")
def mixing_contingency(spark, d):
    e = labelled_edges(spark, d, 10)
    return e.groupBy((F.col("qid") % 7 == F.col("id") % 7).alias("same_study"), (F.col("qlabel") == F.col("label")).alias("same_tissue")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {PAIRS}, {_topk(10, 'qid <> id')}, s as (select vec_id % 7 as study, count(*) as n from embeddings group by 1), t0 as (select count(*) as n from embeddings),
 chance as (select sum(s.n * (s.n - 1)) / max(t0.n) / max(t0.n - 1) as same from s cross join t0), seen as (select avg((qid % 7 = id % 7)::int) as same from t)
 select round(seen.same, 6) as observed, round(chance.same, 6) as expected, round(seen.same / chance.same, 4) as enrichment from seen cross join chance""")
def mixing_enrichment(spark, d):
    """Observed share of neighbours from the same study over its chance, from counts per study."""
    seen = labelled_edges(spark, d, 10).agg(F.avg((F.col("qid") % 7 == F.col("id") % 7).cast("int")).alias("o"))
    s = embeddings(spark, d).groupBy((F.col("vec_id") % 7).alias("study")).agg(F.count(F.lit(1)).alias("n"))
    chance = s.agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n") / (F.sum("n") - 1)).alias("e"))
    return seen.withColumn("e", chance.scalar()).select(F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(F.col("o") / F.col("e"), 4).alias("enrichment"))


@query(f"""with {PAIRS}, {_topk(10, 'qid <> id')}, c as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings),
 h as (select t.qid, t.id, t.rank, q.x as qx, q.y as qy, (x.x - q.x) * (x.x - q.x) + (x.y - q.y) * (x.y - q.y) as d2 from t join c q on q.vec_id = t.qid join c x on x.vec_id = t.id)
 select h.qid, h.id, h.rank, (select count(*) from c where (c.x - h.qx) * (c.x - h.qx) + (c.y - h.qy) * (c.y - h.qy) < h.d2) as map_rank from h""")
def map_rank(spark, d):
    """For every hit of every query its rank by cosine, and how many of all vectors are strictly nearer to the query on the map (the query itself counts)."""
    c = embeddings(spark, d).select("vec_id", F.slice("embedding", 1, 2).alias("xy"))
    hits = neighbours(spark, d, exclude_self=True).select("qid", "id", F.col("rank").cast("long").alias("rank"))
    hits = cut(hits, "hits")
    at = lambda name, xy: c.select(F.col("vec_id").cast("long").alias(name), F.col("xy").alias(xy))
    pairs = hits.join(at("qid", "q"), "qid").join(at("id", "v"), "id")
    n = nearer(pairs, c, "vec_id", "xy", 2)
    return hits.join(n, ["qid", "id"]).select("qid", "id", "rank", F.col("n").alias("map_rank"))


@query("""select count(*) as n, round(min(n0), 6) as low, round(avg(n0), 6) as mean, round(max(n0), 6) as high from (select sqrt(list_dot_product(embedding::double[], embedding::double[])) as n0 from sample_embeddings where embedding is not null)""")
def norm_stats(spark, d):
    n = read(spark, d, "sample_embeddings").filter("embedding is not null").select(vec.norm(F.col("embedding")).alias("n0"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("n0"), 6).alias("low"), F.round(F.avg("n0"), 6).alias("mean"), F.round(F.max("n0"), 6).alias("high"))


DIMS = "e as (select vec_id, unnest(range(1, 65)) as dim, unnest(embedding::double[]) as x from embeddings)"


def by_dim(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x")).select((F.col("dim") + 1).cast("long").alias("dim"), "x")


@query(f"with {DIMS} select dim, round(avg(x), 6) as mean from e group by 1")
def centroid(spark, d):
    return by_dim(embeddings(spark, d)).groupBy("dim").agg(F.round(F.avg("x"), 6).alias("mean"))


@query(f"with {DIMS} select dim, round(stddev_pop(x), 6) as spread from e group by 1")
def axis_spread(spark, d):
    return by_dim(embeddings(spark, d)).groupBy("dim").agg(F.round(F.stddev_pop("x"), 6).alias("spread"))


_USABLE = "embedding is not null and len(embedding) = 512 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"


@query(f"""with v as (select true as asked, embedding from osdr_query_embeddings where {_USABLE} union all select false, embedding from sample_embeddings where {_USABLE}),
 e as (select asked, unnest(range(1, 513)) as dim, unnest(embedding::double[]) as x from v), a as (select dim, stddev_pop(x) as s from e group by 1), q as (select dim, stddev_pop(x) as s from e where asked group by 1)
 select round((select sqrt(sum(s * s)) from q) / (select sqrt(sum(s * s)) from a), 6) as ratio""")
def spread_ratio(spark, d):
    """Spread of the query vectors over that of all vectors; near 0 they would have collapsed."""
    e = F.col("embedding")
    ok = e.isNotNull() & (F.size(e) == 512) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = lambda name, asked_for: read(spark, d, name).filter(ok).select(F.lit(asked_for).alias("asked"), F.posexplode(e.cast("array<double>")).alias("dim", "x"))
    every = part("osdr_query_embeddings", True).unionByName(part("sample_embeddings", False))
    s = every.groupBy("dim").agg(F.stddev_pop("x").alias("a"), F.stddev_pop(F.when(F.col("asked"), F.col("x"))).alias("q"))
    return s.agg(F.round(F.sqrt(F.sum(F.col("q") * F.col("q"))) / F.sqrt(F.sum(F.col("a") * F.col("a"))), 6).alias("ratio"))


@query(f"with {DIMS}, m as (select dim, avg(x) as m from e group by 1) select a.dim as i, b.dim as j, round(sum((a.x - ma.m) * (b.x - mb.m)) / (count(*) - 1), 6) as cov from e a join e b using (vec_id) join m ma on ma.dim = a.dim join m mb on mb.dim = b.dim group by 1, 2")
def pca_covariance(spark, d):
    n, s, g = pca.moments(embeddings(spark, d), "embedding", DIM)
    cov = (g - np.outer(s, s) / n) / max(n - 1, 1)
    rows = [(int(i + 1), int(j + 1), float(cov[i, j])) for i in range(DIM) for j in range(DIM)]
    return spark.createDataFrame(rows, "i long, j long, cov double").withColumn("cov", F.round("cov", 6))


@query()
def pca_fit(spark, d):
    _, comp, share = pca.fit(*pca.moments(embeddings(spark, d), "embedding", DIM))
    return spark.createDataFrame([(k + 1, j + 1, float(comp[k, j])) for k in range(3) for j in range(DIM)], "component int, dim int, weight double")


@query()
def pca_spectrum(spark, d):
    _, _, share = pca.fit(*pca.moments(embeddings(spark, d), "embedding", DIM))
    return spark.createDataFrame([(k + 1, float(s), float(c)) for k, (s, c) in enumerate(zip(share, np.cumsum(share)))], "component int, share double, cumulative double")


@query()
def pca_coords(spark, d):
    mean, comp, _ = pca.fit(*pca.moments(embeddings(spark, d), "embedding", DIM))
    return pca.transform(embeddings(spark, d), ["vec_id"], "embedding", mean, comp[:3])


@query("select vec_id, round(embedding[1]::double, 6) as x, round(embedding[2]::double, 6) as y, 'first' as method from embeddings")
def coords_read(spark, d):
    """Coordinates of a method that exists; one that does not gives an empty table of the same shape."""
    there = {"first": embeddings(spark, d).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"), F.round(F.col("embedding")[1].cast("double"), 6).alias("y"), F.lit("first").alias("method"))}
    return there["first"].unionByName(there.get("other", there["first"].limit(0)))


@query("with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings where vec_id % 100 = 0) select round(min(x) - greatest(0.6 * (max(x) - min(x)), 0.35), 6) as x0, round(max(x) + greatest(0.6 * (max(x) - min(x)), 0.35), 6) as x1, round(min(y) - greatest(0.6 * (max(y) - min(y)), 0.35), 6) as y0, round(max(y) + greatest(0.6 * (max(y) - min(y)), 0.35), 6) as y1 from p")
def retrieval_frame(spark, d):
    p = asked(spark, d).select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    pad = lambda c: F.greatest(0.6 * (F.max(c) - F.min(c)), F.lit(0.35))
    return p.agg(*[F.round(e, 6).alias(n) for n, e in (("x0", F.min("x") - pad("x")), ("x1", F.max("x") + pad("x")), ("y0", F.min("y") - pad("y")), ("y1", F.max("y") + pad("y")))])


@query("select label::bigint as label, count(*) as n, round(avg(embedding[1]::double), 6) as first from embeddings where vec_id % 100 = 0 group by 1")
def sample_vectors(spark, d):
    ids = asked(spark, d).select("vec_id")
    return embeddings(spark, d).join(ids, "vec_id", "left_semi").groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("first"))


@query("""select count(*) as n_rows, count(*) filter (where embedding is null) as n_null, count(*) filter (where embedding is not null and len(embedding) <> 512) as n_odd,
 count(*) filter (where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0) as n_broken from osdr_query_embeddings""")
def finite_check(spark, d):
    e = F.col("embedding")
    broken = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return read(spark, d, "osdr_query_embeddings").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(e.isNull()).alias("n_null"), F.count_if(e.isNotNull() & (F.size(e) != 512)).alias("n_odd"), F.count_if(F.coalesce(broken, F.lit(False))).alias("n_broken"))


@query(f"""with {DIMS}, sp as (select min(s) as least from (select stddev_pop(x) as s from e group by dim)), c as (select (select count(*) from sample_locations)::double as a, (select count(*) from sample_embeddings)::double as b)
 select 'rows agree' as check, a as value, b as threshold, case when a = b then 'OK' else 'FAIL' end as status from c union all
 select 'axes spread', round(least, 6), 0.0001, case when least > 0.0001 then 'OK' else 'FAIL' end from sp union all
 select 'null vectors', count(*) filter (where embedding is null)::double, 0, case when count(*) filter (where embedding is null) = 0 then 'OK' else 'WARN' end from sample_embeddings""")
def validate_structure(spark, d):
    """One row a gate: check, value, threshold, status."""
    a = read(spark, d, "sample_locations").agg(F.count(F.lit(1)).cast("double").alias("value"))
    b = read(spark, d, "sample_embeddings").agg(F.count(F.lit(1)).cast("double").alias("threshold"), F.count_if(F.col("embedding").isNull()).cast("double").alias("nulls"))
    rows = a.withColumn("threshold", b.select("threshold").scalar()).select(F.lit("rows agree").alias("check"), "value", "threshold", F.when(F.col("value") == F.col("threshold"), "OK").otherwise("FAIL").alias("status"))
    s = axis_spread(spark, d).agg(F.min("spread").alias("value")).select(F.lit("axes spread").alias("check"), "value", F.lit(0.0001).alias("threshold"), F.when(F.col("value") > 0.0001, "OK").otherwise("FAIL").alias("status"))
    n = b.select(F.lit("null vectors").alias("check"), F.col("nulls").alias("value"), F.lit(0.0).alias("threshold"), F.when(F.col("nulls") == 0, "OK").otherwise("WARN").alias("status"))
    return rows.unionByName(s).unionByName(n)


@query(f"with {PAIRS}, {_topk(25, 'qid <> id')}, pu as (select avg((qlabel = label)::int) as p from t), nul as (select sum(n * (n - 1)) / sum(n) / (sum(n) - 1) as z from (select count(*) as n from embeddings group by label)) select round((p - z) / (1.0 - z), 4) as share from pu cross join nul")
def recoverable_share(spark, d):
    """(purity - chance) / (ceiling - chance), with a ceiling of 1; null where the span is no more than 1e-6."""
    p = labelled_edges(spark, d, 25).agg(F.avg((F.col("qlabel") == F.col("label")).cast("int")).alias("p"))
    n = embeddings(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n") / (F.sum("n") - 1)).alias("z"))
    return p.withColumn("z", n.scalar()).select(F.round(F.when(1 - F.col("z") > 1e-6, (F.col("p") - F.col("z")) / (1 - F.col("z"))), 4).alias("share"))


@query("""with a as (select label, avg(embedding[1]::double) as old, avg(embedding[2]::double) as new from embeddings group by 1) select label::bigint as label, round((new - old) / greatest(old, 1e-9), 4) as change,
 case when (new - old) / greatest(old, 1e-9) < -0.02 then 'regression' else 'fine' end as verdict from a where old > 0.005""")
def compare_builds(spark, d):
    a = embeddings(spark, d).groupBy(F.col("label").cast("long").alias("label")).agg(F.avg(F.col("embedding")[0].cast("double")).alias("old"), F.avg(F.col("embedding")[1].cast("double")).alias("new")).filter("old > 0.005")
    c = (F.col("new") - F.col("old")) / F.greatest(F.col("old"), F.lit(1e-9))
    return a.select("label", F.round(c, 4).alias("change"), F.when(c < -0.02, "regression").otherwise("fine").alias("verdict"))


# ---- layouts: rows only ---------------------------------------------------------------------


def graph(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Exact neighbour graph of all vectors, in blocks of queries."""
    e = embeddings(spark, d)
    return knn(e, "vec_id", "embedding", e, "vec_id", "embedding", DIM, k, "cosine", True)


@query(f"""with {UNIT}, p as (select q.vec_id as qid, x.vec_id as id, list_dot_product(q.v, x.v) as score from u q join u x on q.vec_id <> x.vec_id),
 t as (select qid, id, score, row_number() over (partition by qid order by round(score, 12) desc, id)::int as rank from p qualify rank <= 15) select qid, id, rank, round(score, 6) as score from t""")
def knn_graph(spark, d):
    return graph(spark, d, 15).select("qid", "id", "rank", F.round("score", 6).alias("score"))


LANDMARKS = layout.CAP


def _laid_out(spark: SparkSession, d: str, k: int, make) -> DataFrame:
    """Places of all vectors: landmarks by ``make(edges, vectors by id)``, the others among them."""
    e = embeddings(spark, d)
    some = cut(layout.landmarks(e.select("vec_id", "embedding"), "vec_id", LANDMARKS), "landmarks")
    edges = knn(some, "vec_id", "embedding", some, "vec_id", "embedding", DIM, k, "cosine", True)
    v = some.toPandas().set_index("vec_id")["embedding"]  # LANDMARKS rows
    ids, y = make(edges, v)
    return layout.place(e, "vec_id", "embedding", DIM, ids, np.array(v.loc[ids].tolist()), y)


def _components(v, ids: np.ndarray, dims: int) -> np.ndarray:
    x = np.array(v.loc[ids].tolist())
    _, comp, _ = pca.fit(len(x), x.sum(0), x.T @ x)
    return (x - x.mean(0)) @ comp[:dims].T


@query()
def spectral_init(spark, d):
    def make(edges, v):
        ids, i, j, w = layout.edge_arrays(layout.fuzzy_weights(edges), "weight")
        return ids, layout.spectral(len(ids), i, j, w, 2)

    return _laid_out(spark, d, 15, make)


@query()
def pca_init(spark, d):
    """Start of a layout from principal components, scaled to 10 and jittered."""
    return _laid_out(spark, d, 1, lambda edges, v: (np.array(v.index), layout.init_from_pca(_components(v, np.array(v.index), 2))))


def _umap(dims: int):
    def make(edges, v):
        ids, i, j, w = layout.edge_arrays(layout.fuzzy_weights(edges), "weight")
        return ids, layout.umap(len(ids), i, j, w, dims)

    return make


@query()
def umap_layout(spark, d):
    return _laid_out(spark, d, 15, _umap(2))


@query()
def umap_layout_3d(spark, d):
    return _laid_out(spark, d, 15, _umap(3))


@query()
def tsne_affinities(spark, d):
    return layout.affinities(graph(spark, d, 30), 10.0).select("qid", "id", F.round("p", 9).alias("p"))


def _tsne(dims: int):
    def make(edges, v):
        ids, i, j, p = layout.edge_arrays(layout.affinities(edges, 10.0), "p")
        return ids, layout.tsne(len(ids), i, j, p, _components(v, ids, dims))

    return make


@query()
def tsne_layout(spark, d):
    return _laid_out(spark, d, 30, _tsne(2))


@query()
def tsne_layout_3d(spark, d):
    return _laid_out(spark, d, 30, _tsne(3))


@query()
def encode_samples(spark, d):
    """Vectors of a small seeded transformer from aligned expression rows."""
    rows = embeddings(spark, d).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.log1p(F.greatest(x, F.lit(0.0)))).alias("x"))
    out = encoder.encode_table(rows, "vec_id", "x", encoder.seeded_weights(DIM), l2=True)
    return out.select("vec_id", "embedding")


QUERIES, SQL = R.QUERIES, R.SQL
