"""Small operators of the serving and validation paths, each with its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.knn import knn
from strandloom.operators.positions import positions
from strandloom.plans.analytic import _LAB, LEGEND, legend, tissue_labels
from strandloom.plans.embedding import PAIRS, _topk, asked, embeddings, labelled_edges, neighbours
from strandloom.plans.registry import Registry
from strandloom.plans.relational import samples
from strandloom.tables import read

R = Registry()
query = R.query
RESIDUAL = ("Other", "Unknown", "unknown", "nan", "None", "")  # fixed values
FIELDS = ("tissue", "series_id", "title", "source_name")

# ---- predicates and projections ------------------------------------------------------


@query("""select row_id from osdr_samples where length(trim("id.sample name")) > 0""")
def nonempty_names(spark, d):
    return samples(spark, d).filter(F.length(F.trim("sample_name")) > 0).select("row_id")


@query("select accession, title from osdr_studies where accession = (select min(accession) from osdr_studies)")
def study_by_id(spark, d):
    s = read(spark, d, "osdr_studies").select("accession", "title")
    return s.filter(F.col("accession") == s.agg(F.min("accession")).scalar())


def one_row(df: DataFrame, column: str, value: object) -> DataFrame:
    """The rows of an id; an unknown one raises."""
    found = df.filter(F.col(f"`{column}`") == F.lit(value))
    if found.isEmpty():
        raise ValueError(f"no row with {column} = {value}")
    return found


@query("select distinct hit_id, gse, '' as title, '' as summary, '' as pmid from hits_df")
def blank_enrichment(spark, d):
    blank = F.lit("")
    return read(spark, d, "hits_df").select("hit_id", "gse", blank.alias("title"), blank.alias("summary"), blank.alias("pmid")).distinct()


@query("""select row_id from osdr_samples where "id.accession" in (select "id.accession" from osdr_samples group by 1 having count(*) >= 10)""")
def in_large_studies(spark, d):
    s = samples(spark, d)
    large = s.groupBy("study").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("study")
    return s.join(large, "study", "left_semi").select("row_id")


@query("select global_index, geo_accession from sample_locations where global_index < 100")
def index_cap(spark, d):
    """A row cap by index, which is the same on every run."""
    return read(spark, d, "sample_locations").filter("global_index < 100").select("global_index", "geo_accession")


@query("select distinct hit_id, archs4_index from hits_df where archs4_index >= 0 and archs4_index < (select max(global_index) + 1 from sample_locations)")
def hit_range_guard(spark, d):
    n = read(spark, d, "sample_locations").agg(F.max("global_index") + 1).scalar()
    return read(spark, d, "hits_df").filter((F.col("archs4_index") >= 0) & (F.col("archs4_index") < n)).select("hit_id", "archs4_index").distinct()


@query("select global_index, species_id::tinyint::bigint as species, shard_idx::smallint::bigint as shard, round((global_index / 7.0)::float::double, 3) as single from sample_locations")
def narrow_casts(spark, d):
    c = F.col
    return read(spark, d, "sample_locations").select("global_index", c("species_id").cast("byte").cast("long").alias("species"), c("shard_idx").cast("short").cast("long").alias("shard"), F.round((c("global_index") / 7.0).cast("float").cast("double"), 3).alias("single"))


def is_residual(c):
    return c.isNull() | c.isin(*RESIDUAL)


@query("select global_index, max(tissue is null or tissue in ('Other', 'Unknown', 'unknown', 'nan', 'None', '')) as residual from archs4_metadata group by 1")
def residual_flags(spark, d):
    return read(spark, d, "archs4_metadata").groupBy(F.col("global_index").cast("long").alias("global_index")).agg(F.max(is_residual(F.col("tissue"))).alias("residual"))


@query("select label, count(*) as n from (select distinct global_index, trim(tissue) as label from archs4_metadata) where label not in ('Unknown', 'Other', '') group by 1")
def named_buckets(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", F.trim("tissue").alias("label")).distinct()
    return m.filter(~F.col("label").isin("Unknown", "Other", "")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- joins ---------------------------------------------------------------------------


@query("select m.global_index::bigint as global_index, coalesce(l.species_id, 0)::bigint as species from (select distinct global_index from archs4_metadata) m left join sample_locations l using (global_index)")
def species_default(spark, d):
    m = read(spark, d, "archs4_metadata").select(F.col("global_index").cast("long").alias("global_index")).distinct()
    return m.join(read(spark, d, "sample_locations").select("global_index", "species_id"), "global_index", "left").select("global_index", F.coalesce("species_id", F.lit(0)).cast("long").alias("species"))


@query("select sample_key, (select count(*) from sample_locations) + row_number() over (order by sample_key) - 1 as point from (select distinct sample_key from osdr_query_embeddings where sample_key is not null)")
def query_points(spark, d):
    """Points of the queries behind those of the index, by key."""
    keys = read(spark, d, "osdr_query_embeddings").filter("sample_key is not null").select("sample_key").distinct()
    n = read(spark, d, "sample_locations").agg(F.count(F.lit(1))).scalar()
    return positions(keys, [F.col("sample_key")]).withColumn("n", n).select("sample_key", (F.col("n") + F.col("position") - 1).alias("point"))


@query("select a.place, a.geo_accession, b.global_index from (select row_number() over (order by global_index) as place, geo_accession from sample_locations) a join (select row_number() over (order by global_index) as place, global_index from sample_embeddings) b using (place)")
def zip_rows(spark, d):
    """Rows at the same place of two tables of the same length; other lengths raise."""
    return zipped(read(spark, d, "sample_locations").select(F.col("global_index").alias("a"), "geo_accession"), "a", read(spark, d, "sample_embeddings").select("global_index"), "global_index").select("place", "geo_accession", "global_index")


def zipped(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows cannot be paired with {m}")
    return positions(left, [F.col(left_order)], "place").join(positions(right, [F.col(right_order)], "place"), "place")


@query("select coalesce((select max(\"id.accession\") from osdr_samples where concat_ws('|', \"id.accession\", trim(\"id.sample name\")) = (select max(sample_key) from osdr_metadata)), (select min(\"id.accession\") from osdr_samples)) as study, 'asked' as how union all select min(\"id.accession\"), 'none' from osdr_samples")
def initial_study(spark, d):
    """The study of the sample that is asked for, else the first one."""
    s = samples(spark, d)
    key = read(spark, d, "osdr_metadata").agg(F.max("sample_key")).scalar()
    first = s.agg(F.min("study").alias("study"))
    asked_for = s.filter(F.col("sample_key") == key).agg(F.max("study").alias("study"))
    return asked_for.select(F.coalesce("study", first.scalar()).alias("study"), F.lit("asked").alias("how")).unionByName(first.withColumn("how", F.lit("none")))


# ---- orders --------------------------------------------------------------------------


@query("select hit_id, row_number() over (order by score desc, hit_id) as place from (select hit_id, max(score) as score from hits_df where score is not null and not isnan(score) group by 1)")
def hits_by_score(spark, d):
    h = read(spark, d, "hits_df").filter("score is not null and not isnan(score)").groupBy("hit_id").agg(F.max("score").alias("score"))
    return positions(h, [F.desc("score"), F.col("hit_id")], "place").select("hit_id", "place")


@query("select gse, title from geo_records order by gse limit 5")
def first_examples(spark, d):
    return read(spark, d, "geo_records").select("gse", "title").orderBy("gse").limit(5)


@query("select global_index, row_number() over (order by global_index) as place from sample_embeddings")
def global_order(spark, d):
    return positions(read(spark, d, "sample_embeddings").select("global_index"), [F.col("global_index")], "place")


@query(f"with {_LAB}, {LEGEND} select shown, row_number() over (order by not (shown in ('Other', 'Unknown', 'unknown', 'nan', 'None', '', 'not covered')), slot) as place from slots")
def drawing_order(spark, d):
    """Residual categories are drawn first, underneath the others."""
    under = F.col("shown").isin(*RESIDUAL, "not covered")
    w = Window.orderBy(~under, "slot")  # over the few rows of a legend
    return legend(tissue_labels(spark, d).select("label")).select("shown", F.row_number().over(w).cast("long").alias("place"))


_COVER = " union all ".join(f"select '{f}' as field, {i} as i, count(*) filter (where trim({f}) <> '') = count(*) as whole from archs4_metadata" for i, f in enumerate(FIELDS))


@query(f"select field, whole, row_number() over (order by not whole, i) as place from ({_COVER})")
def menu_order(spark, d):
    """Fields that cover the whole map come first; otherwise their order stays."""
    m = read(spark, d, "archs4_metadata")
    whole = m.agg(*[(F.count_if(F.trim(f) != "") == F.count(F.lit(1))).alias(f) for f in FIELDS])
    rows = whole.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("i"), F.col(f).alias("whole")) for i, f in enumerate(FIELDS)])).alias("x")).select("x.*")
    return rows.select("field", "whole", F.row_number().over(Window.orderBy(~F.col("whole"), "i")).cast("long").alias("place"))


@query("select tissue, row_number() over (order by min(hit_id), tissue) as place from hits_df where tissue is not null group by 1")
def ordered_distinct(spark, d):
    """Distinct values in the order of their first appearance."""
    first = read(spark, d, "hits_df").filter("tissue is not null").groupBy("tissue").agg(F.min("hit_id").alias("first"))
    return positions(first, [F.col("first"), F.col("tissue")], "place").select("tissue", "place")


# ---- text ----------------------------------------------------------------------------


@query("""select row_id, trim("study.characteristics.organism") as trimmed, lower("study.characteristics.organism") as lower, upper("study.characteristics.organism") as upper from osdr_samples""")
def case_forms(spark, d):
    return samples(spark, d).select("row_id", F.trim("organism").alias("trimmed"), F.lower("organism").alias("lower"), F.upper("organism").alias("upper"))


@query("select global_index, array_to_string(list_filter([trim(title), trim(source_name), trim(tissue)], lambda x: x is not null and x <> ''), ';') as joined from (select distinct global_index, title, source_name, tissue from archs4_metadata)")
def joined_values(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", "title", "source_name", "tissue").distinct()
    kept = F.filter(F.array(*[F.trim(c) for c in ("title", "source_name", "tissue")]), lambda x: x.isNotNull() & (x != ""))
    return m.select("global_index", F.array_join(kept, ";").alias("joined"))


@query("select accession, unnest(range(1, len(p) + 1)) as place, unnest(p) as part, unnest(list_transform(range(1, len(p) + 1), lambda i: i % 2 = 0)) as bold from (select accession, string_split(accession || ' **' || title || '** ' || accession, '**') as p from osdr_studies)")
def bold_parts(spark, d):
    """Text between double asterisks is bold."""
    s = read(spark, d, "osdr_studies").select("accession", F.concat(F.col("accession"), F.lit(" **"), F.col("title"), F.lit("** "), F.col("accession")).alias("t"))
    p = s.filter("t is not null").select("accession", F.posexplode(F.split("t", r"\*\*")).alias("i", "part"))
    return p.select("accession", (F.col("i") + 1).cast("long").alias("place"), "part", (F.col("i") % 2 == 1).alias("bold"))


@query("select gse, array_to_string(list_filter([trim(geo_summary), trim(geo_design)], lambda x: x is not null and x <> ''), e'\\n\\n') as text from geo_records")
def list_text(spark, d):
    kept = F.filter(F.array(F.trim("geo_summary"), F.trim("geo_design")), lambda x: x.isNotNull() & (x != ""))
    return read(spark, d, "geo_records").select("gse", F.array_join(kept, "\n\n").alias("text"))


@query("select doc_id, strftime(added_at, '%Y-%m-%dT%H:%M:%S') as stamp from documents where added_at is not null")
def stamps(spark, d):
    return read(spark, d, "documents").filter("added_at is not null").select("doc_id", F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"))


# ---- vectors -------------------------------------------------------------------------


@query(f"with {PAIRS}, {_topk(11)}, o as (select qid, id, rank from t where qid <> id) select qid, id, row_number() over (partition by qid order by rank) as place from o qualify place <= 10")
def own_row_dropped(spark, d):
    """Eleven neighbours with the row itself, which is then left out wherever it stands."""
    hits = neighbours(spark, d, 11).filter("qid <> id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))  # eleven rows a query
    return hits.select("qid", "id", place.cast("long").alias("place")).filter("place <= 10")


@query("select vec_id, list_position(a, list_max(a))::bigint as dim, case when embedding[list_position(a, list_max(a))] < 0 then -1 else 1 end as sign from (select vec_id, embedding, list_transform(embedding::double[], lambda x: abs(x)) as a from embeddings)")
def largest_entry(spark, d):
    """The first entry of largest size and its sign."""
    e = embeddings(spark, d).select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("a", F.transform("e", F.abs))
    at = F.array_position("a", F.array_max("a"))
    return e.select("vec_id", at.alias("dim"), F.when(F.element_at("e", at.cast("int")) < 0, -1).otherwise(1).alias("sign"))


@query("select q.vec_id as qid, x.vec_id as id, round((q.embedding[1]::double - x.embedding[1]::double)**2 + (q.embedding[2]::double - x.embedding[2]::double)**2, 6) as d2 from embeddings q join embeddings x on q.vec_id % 100 = 0")
def squared_distances(spark, d):
    from strandloom.operators.knn import scores

    flat = lambda df: df.select("vec_id", F.slice("embedding", 1, 2).alias("xy"))
    s = scores(flat(asked(spark, d)), "vec_id", "xy", flat(embeddings(spark, d)), "vec_id", "xy", 2, None, "euclidean")
    return s.select("qid", "id", F.round(-F.col("score"), 6).alias("d2"))


# ---- validation ----------------------------------------------------------------------

_FLAT = """f as (select q.vec_id as qid, x.vec_id as id, q.label as qlabel, x.label as label, row_number() over (partition by q.vec_id order by round((q.embedding[1]::double - x.embedding[1]::double)**2 + (q.embedding[2]::double - x.embedding[2]::double)**2, 12), x.vec_id) as r
 from embeddings q join embeddings x on q.vec_id % 100 = 0 and q.vec_id <> x.vec_id qualify r <= 25)"""


@query(f"with {PAIRS}, {_topk(25, 'qid <> id')}, {_FLAT}, c as (select avg((qlabel = label)::int) as c from t), m as (select avg((qlabel = label)::int) as m from f), z as (select sum(n * (n - 1)) / sum(n) / (sum(n) - 1) as z from (select count(*) as n from embeddings group by label)) select round(m, 6) as purity, round(c, 6) as ceiling, round(z, 6) as chance, case when c - z > 1e-6 then round((m - z) / (c - z), 4) end as share from c cross join m cross join z")
def recoverable_measured(spark, d):
    """Share of the recoverable label purity that a flat map keeps: its ceiling is the purity measured in the full space."""
    flat = lambda df: df.select("vec_id", F.slice("embedding", 1, 2).alias("xy"))
    lab = embeddings(spark, d).select("vec_id", "label")
    on_map = knn(flat(asked(spark, d)), "vec_id", "xy", flat(embeddings(spark, d)), "vec_id", "xy", 2, 25, "euclidean", True)
    on_map = on_map.join(lab.select(F.col("vec_id").alias("id"), "label"), "id").join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("qlabel")), "qid")
    same = lambda e, name: e.agg(F.avg((F.col("qlabel") == F.col("label")).cast("int")).alias(name))
    z = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n") / (F.sum("n") - 1)).alias("z"))
    row = same(on_map, "m").withColumn("c", same(labelled_edges(spark, d, 25), "c").scalar()).withColumn("z", z.scalar())
    span = F.col("c") - F.col("z")
    return row.select(F.round("m", 6).alias("purity"), F.round("c", 6).alias("ceiling"), F.round("z", 6).alias("chance"), F.when(span > 1e-6, F.round((F.col("m") - F.col("z")) / span, 4)).alias("share"))


_GOOD = "embedding is not null and len(embedding) = 512 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SERIES = f"""v as (select global_index, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from sample_embeddings where {_GOOD}),
 p as (select q.global_index as qid, x.global_index as id, list_dot_product(q.v, x.v) as s from v q join v x on q.global_index % 100 = 0 and q.global_index <> x.global_index),
 t as (select qid, id from p qualify row_number() over (partition by qid order by round(s, 12) desc, id) <= 10),
 m as (select global_index, min(series_id) as series, min(nullif(trim(tissue), '')) as tissue from archs4_metadata group by 1)"""


@query(f"with {_SERIES} select a.series is not distinct from b.series as same_study, a.tissue is not distinct from b.tissue as same_tissue, count(*) as n from t join m a on a.global_index = t.qid join m b on b.global_index = t.id group by 1, 2")
def mixing_series(spark, d):
    """Neighbours in the full space by whether they share the series and the tissue."""
    e = read(spark, d, "sample_embeddings").filter("embedding is not null")
    n = knn(e.filter("global_index % 100 = 0"), "global_index", "embedding", e, "global_index", "embedding", 512, 10, "cosine", True)
    m = read(spark, d, "archs4_metadata").groupBy(F.col("global_index").cast("long").alias("global_index")).agg(F.min("series_id").alias("series"), F.min(F.nullif(F.trim("tissue"), F.lit(""))).alias("tissue"))
    side = lambda name: m.select(F.col("global_index").alias(name), F.col("series").alias(name + "_series"), F.col("tissue").alias(name + "_tissue"))
    j = n.join(side("qid"), "qid").join(side("id"), "id")
    return j.groupBy(F.col("qid_series").eqNullSafe(F.col("id_series")).alias("same_study"), F.col("qid_tissue").eqNullSafe(F.col("id_tissue")).alias("same_tissue")).agg(F.count(F.lit(1)).alias("n"))


@query("""select 'contiguous' as check, count(*)::double as value, (max(global_index) - min(global_index) + 1)::double as threshold, case when count(*) = max(global_index) - min(global_index) + 1 then 'OK' else 'FAIL' end as status from sample_locations
 union all select 'shard ' || shard_idx, count(*)::double, (max(row_in_shard) + 1)::double, case when count(*) = max(row_in_shard) + 1 then 'OK' else 'FAIL' end from sample_locations group by shard_idx""")
def block_gates(spark, d):
    """Indices without a gap, and as many rows in each shard as its last row says."""
    loc = read(spark, d, "sample_locations")
    status = F.when(F.col("value") == F.col("threshold"), "OK").otherwise("FAIL").alias("status")
    whole = loc.agg(F.count(F.lit(1)).cast("double").alias("value"), (F.max("global_index") - F.min("global_index") + 1).cast("double").alias("threshold")).select(F.lit("contiguous").alias("check"), "value", "threshold", status)
    per = loc.groupBy("shard_idx").agg(F.count(F.lit(1)).cast("double").alias("value"), (F.max("row_in_shard") + 1).cast("double").alias("threshold"))
    return whole.unionByName(per.select(F.concat(F.lit("shard "), F.col("shard_idx").cast("string")).alias("check"), "value", "threshold", status))


QUERIES, SQL = R.QUERIES, R.SQL

