"""Aggregations, windows, samples, expression ETL and map views over the project tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import cases, rules, vec
from strandloom.operators import expression, sampling
from strandloom.operators.positions import positions
from strandloom.plans.registry import Registry
from strandloom.plans.relational import samples
from strandloom.tables import read

R = Registry()
query = R.query
TOP = 11  # categories that keep their own colour
SEED = 42

# ---- counts and groups ------------------------------------------------------------


@query("select count(*) filter (where dataset = 0) as n_index, count(*) filter (where dataset = 1) as n_query, count(*) as n_all from (select 0 as dataset from sample_embeddings union all select 1 from osdr_query_embeddings)")
def corpus_counts(spark, d):
    a = read(spark, d, "sample_embeddings").select(F.lit(0).alias("ds"))
    b = read(spark, d, "osdr_query_embeddings").select(F.lit(1).alias("ds"))
    return a.unionByName(b).agg(F.count_if(F.col("ds") == 0).alias("n_index"), F.count_if(F.col("ds") == 1).alias("n_query"), F.count(F.lit(1)).alias("n_all"))


@query("select tissue as label, count(*) as n from hits_df group by 1")
def category_counts(spark, d):
    return read(spark, d, "hits_df").groupBy(F.col("tissue").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select count(distinct series_id) as n_series, count(distinct geo_accession) as n_samples from archs4_metadata")
def distinct_series(spark, d):
    return read(spark, d, "archs4_metadata").agg(F.countDistinct("series_id").alias("n_series"), F.countDistinct("geo_accession").alias("n_samples"))


PROFILE = """profile as (select study, count(*) as n, count(distinct tissue) as n_tissues, coalesce(bool_or(contains(lower(spaceflight), 'flight')), false) as has_flight
 from (select "id.accession" as study, "study.characteristics.material type" as tissue, "study.factor value.spaceflight" as spaceflight from osdr_samples) group by 1)"""


def profile(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy("study").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("tissue").alias("n_tissues"), F.coalesce(F.bool_or(F.lower("spaceflight").contains("flight")), F.lit(False)).alias("has_flight"))


@query(f"with {PROFILE} select * from profile")
def study_profile(spark, d):
    return profile(spark, d)


@query(f"""with {PROFILE} select study, n, before from (select study, n, coalesce(sum(n) over (order by has_flight desc, n_tissues desc, n desc, study rows between unbounded preceding and 1 preceding), 0)::bigint as before from profile) where before < 150""")
def greedy_whole_studies(spark, d):
    """Whole studies until 150 samples are reached.

    One row a study; the running sum runs over those that can still be taken: a
    study stands among the first 150 in order, as each has a sample at least.
    """
    first = profile(spark, d).orderBy(F.desc("has_flight"), F.desc("n_tissues"), F.desc("n"), "study").limit(150)
    w = Window.orderBy(F.desc("has_flight"), F.desc("n_tissues"), F.desc("n"), "study").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter("before < 150").select("study", "n", "before")


@query("select count(*) as n_rows, round(avg((m.geo_accession is not null)::int), 6) as matched, round(avg((coalesce(trim(m.tissue), '') <> '')::int), 6) as placed from sample_locations l left join (select geo_accession, max(tissue) as tissue from archs4_metadata group by 1) m using (geo_accession)")
def metadata_coverage(spark, d):
    m = read(spark, d, "archs4_metadata").groupBy("geo_accession").agg(F.max("tissue").alias("tissue"), F.lit(1).alias("there"))
    j = read(spark, d, "sample_locations").select("geo_accession").join(m, "geo_accession", "left")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return j.agg(F.count(F.lit(1)).alias("n_rows"), rate(F.col("there").isNotNull()).alias("matched"), rate(F.trim(F.coalesce("tissue", F.lit(""))) != "").alias("placed"))


@query("""select field, covered, total, round(covered * 100.0 / total, 6) as percent from (
 select 'species' as field, count(species_id) as covered, count(*) as total from sample_locations union all select 'tissue', count(nullif(trim(tissue), '')), count(*) from archs4_metadata
 union all select 'study', count(nullif(trim(series_id), '')), count(*) from archs4_metadata)""")
def coverage(spark, d):
    meta = read(spark, d, "archs4_metadata")
    loc = read(spark, d, "sample_locations").agg(F.count("species_id").alias("covered"), F.count(F.lit(1)).alias("total")).select(F.lit("species").alias("field"), "covered", "total")
    both = meta.agg(F.count(F.nullif(F.trim("tissue"), F.lit(""))).alias("t"), F.count(F.nullif(F.trim("series_id"), F.lit(""))).alias("s"), F.count(F.lit(1)).alias("total"))
    rest = both.select(F.explode(F.array(F.struct(F.lit("tissue").alias("field"), F.col("t").alias("covered"), "total"), F.struct(F.lit("study").alias("field"), F.col("s").alias("covered"), "total"))).alias("x")).select("x.*")
    return loc.unionByName(rest).withColumn("percent", F.round(F.col("covered") * 100.0 / F.col("total"), 6))


@query("""with m as (select distinct "id.accession" as study, trim("id.sample name") as name from osdr_samples), r as (select study, name, row_number() over (partition by study order by name) as k, count(*) over (partition by study) as n from m)
select study, max(n) as n, string_agg(name, ', ' order by name) filter (where k <= 8) as members from r group by 1""")
def study_detail(spark, d):
    m = samples(spark, d).select("study", F.trim("sample_name").alias("name")).distinct()
    n = m.groupBy("study").agg(F.count(F.lit(1)).alias("n"))
    # The first eight by a ranked window (its limit is applied before the shuffle), so no study is gathered whole.
    few = m.withColumn("k", F.row_number().over(Window.partitionBy("study").orderBy("name"))).filter("k <= 8")
    return n.join(few.groupBy("study").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ", ").alias("members")), "study").select("study", "n", "members")


@query("select distinct accession as study from osdr_studies where accession is not null")
def distinct_studies(spark, d):
    return read(spark, d, "osdr_studies").filter("accession is not null").select(F.col("accession").alias("study")).distinct()


@query("""with h as (select distinct hit_id, gsm, score from hits_df where score is not null and not isnan(score)) select gsm || ' (' || hit_id || ')' as label, round(score, 6) as score from h order by h.score desc, hit_id limit 20""")
def bar_rows(spark, d):
    h = read(spark, d, "hits_df").filter("score is not null and not isnan(score)").select("hit_id", "gsm", "score").distinct()
    return h.orderBy(F.desc("score"), "hit_id").limit(20).select(F.concat("gsm", F.lit(" ("), F.col("hit_id").cast("string"), F.lit(")")).alias("label"), F.round("score", 6).alias("score"))


@query("with h as (select sample_key, max(score) as s from hits_df where score is not null and not isnan(score) group by 1) select sample_key, round(s, 6) as score from h order by s desc, sample_key limit 1")
def select_best_query(spark, d):
    h = read(spark, d, "hits_df").filter("score is not null and not isnan(score)").groupBy("sample_key").agg(F.max("score").alias("s"))
    return h.orderBy(F.desc("s"), "sample_key").limit(1).select("sample_key", F.round("s", 6).alias("score"))


@query("select sha256(string_agg(trim(term), chr(10) order by term_id)) as digest, count(*) as n from tissue_terms")
def ordered_digest(spark, d):
    """Digest of the whole reference list in its order; the list is of fixed size."""
    t = read(spark, d, "tissue_terms").agg(F.array_sort(F.collect_list(F.struct("term_id", F.trim("term").alias("t")))).alias("x"), F.count(F.lit(1)).alias("n"))
    return t.select(F.sha2(F.array_join(F.transform("x", lambda s: s["t"]), "\n"), 256).alias("digest"), "n")


@query("select round(avg(nnz), 6) as mean_nnz from (select l_suppkey, count(distinct l_partkey) as nnz from lineitem where l_quantity > 0 group by 1)")
def nnz_per_row(spark, d):
    rows = read(spark, d, "lineitem").filter("l_quantity > 0").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("nnz"))
    return rows.agg(F.round(F.avg("nnz"), 6).alias("mean_nnz"))


# ---- expression ETL: lineitem as counts (supplier = sample, part = gene) -----------

COUNTS = "c as (select l_suppkey as sample, p_brand || '-' || (p_partkey % 50)::bigint as symbol, sum(l_quantity) as count from lineitem join part on l_partkey = p_partkey group by 1, 2)"
LENGTHS = "len as (select p_brand || '-' || (p_partkey % 50)::bigint as symbol, arg_min(p_size, p_partkey) as length from part where p_size > 0 group by 1)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("gene"), F.col("l_quantity").alias("count"))


def mapping(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 50).cast("string")).alias("symbol"), F.col("p_partkey").alias("line"), F.col("p_size").alias("length"))


def collapsed(spark: SparkSession, d: str) -> DataFrame:
    return expression.collapse(expression.map_symbols(counts(spark, d), mapping(spark, d)))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return expression.first_positive(mapping(spark, d).select("symbol", "length", "line"), "symbol", "length", "line")


@query("select l_orderkey, l_linenumber::bigint as line, p_brand || '-' || (p_partkey % 50)::bigint as symbol from lineitem join part on l_partkey = p_partkey")
def ortholog_map(spark, d):
    c = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("gene"))
    return expression.map_symbols(c, mapping(spark, d).select("gene", "symbol", F.col("line").alias("line"))).select("l_orderkey", "line", "symbol")


@query(f"with {COUNTS} select sample, symbol, round(count, 6) as count from c")
def collapse_duplicates(spark, d):
    return collapsed(spark, d).select("sample", "symbol", F.round("count", 6).alias("count"))


ALIGNED = f"{COUNTS}, g as (select distinct p_brand || '-' || (p_partkey % 50)::bigint as symbol from part where p_size <= 25), s as (select distinct sample from c), a as (select s.sample, g.symbol, coalesce(c.count, 0) as count from s cross join g left join c on c.sample = s.sample and c.symbol = g.symbol)"


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return expression.align(collapsed(spark, d), mapping(spark, d).filter("length <= 25"))


@query(f"with {ALIGNED} select sample, symbol, round(count, 6) as count from a")
def canonical_align(spark, d):
    return aligned(spark, d).select("sample", "symbol", F.round("count", 6).alias("count"))


def _tpm(rows: str) -> str:
    return f"""r as (select {rows}.sample, {rows}.symbol, case when length > 0 then {rows}.count / (length / 1000.0) else 0 end as rate from {rows} left join len using (symbol)),
 t as (select sample, symbol, case when sum(rate) over (partition by sample) > 0 then rate / sum(rate) over (partition by sample) * 1e6 else 0 end as tpm from r)"""


@query(f"with {COUNTS}, {LENGTHS}, {_tpm('c')} select sample, symbol, round(tpm, 4) as tpm from t")
def tpm_normalize(spark, d):
    return expression.tpm(collapsed(spark, d), lengths(spark, d)).select("sample", "symbol", F.round("tpm", 4).alias("tpm"))


@query(f"with {COUNTS}, {LENGTHS}, {_tpm('c')} select sample, symbol, round(ln(1 + greatest(tpm, 0)), 6) as value from t")
def log1p_tpm(spark, d):
    return expression.tpm(collapsed(spark, d), lengths(spark, d)).select("sample", "symbol", F.round(expression.log1p("tpm"), 6).alias("value"))


@query(f"with {ALIGNED}, {LENGTHS}, {_tpm('a')} select sample, symbol, round(ln(1 + greatest(tpm, 0)), 6) as value from t")
def expression_pipeline(spark, d):
    return expression.tpm(aligned(spark, d), lengths(spark, d)).select("sample", "symbol", F.round(expression.log1p("tpm"), 6).alias("value"))


@query("""with l as (select l_orderkey, l_linenumber::bigint as line, sum(l_quantity) as v from lineitem group by 1, 2)
select l_orderkey, line, round(sum(v) over (partition by l_orderkey order by line), 6) as prefix, round(sum(v) over (partition by l_orderkey order by line desc), 6) as suffix from l""")
def prefix_sum(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).agg(F.sum("l_quantity").alias("v"))
    return expression.prefix_sums(rows, "l_orderkey", "line", "v").select("l_orderkey", "line", F.round("prefix", 6).alias("prefix"), F.round("suffix", 6).alias("suffix"))


# ---- labels -----------------------------------------------------------------------

_META = "m as (select distinct global_index, characteristics, source_name, tissue from archs4_metadata)"


@query(f"""with s as (select row_id, {rules.sql_normalised('"study.characteristics.material type"')} as t from osdr_samples) select row_id, {rules.sql_canonical('t')} as bucket from s""")
def canonical_tissue(spark, d):
    return samples(spark, d).select("row_id", rules.canonical(F.col("tissue")).alias("bucket"))


def _coalesced_sql(cols: list[tuple[str, str]], keep: str, source: str) -> str:
    norm = ", ".join(f"{rules.sql_normalised(c)} as n{i}" for i, (c, _) in enumerate(cols))
    canon = ", ".join(f"{rules.sql_canonical(f'n{i}')} as b{i}" for i in range(len(cols)))
    weak = "('Cell line', 'Reference RNA', 'Cultured cells', 'Other', 'Unknown')"
    rank = "case {b} when 'Cell line' then 3 when 'Reference RNA' then 3 when 'Cultured cells' then 2 when 'Other' then 1 else 0 end"
    best = "greatest(" + ", ".join(f"({rank.format(b=f'b{i}')}) * 100 - {i}" for i in range(len(cols))) + ")"
    strong = " ".join(f"when b{i} not in {weak} then b{i}" for i in range(len(cols)))
    pick = " ".join(f"when ({rank.format(b=f'b{i}')}) * 100 - {i} = {best} then b{i}" for i in range(len(cols)))
    return f"n as (select {keep}, {norm} from {source}), b as (select {keep}, {canon} from n) select {keep}, case {strong} {pick} end as bucket from b"


@query(f"with {_META}, {_coalesced_sql([('tissue', ''), ('source_name', '')], 'global_index', '(select distinct global_index, tissue, source_name from m)')}")
def coalesce_tissue(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", "tissue", "source_name").distinct()
    return m.select("global_index", rules.coalesced(F.col("tissue"), F.col("source_name")).alias("bucket"))


_KEYS = ["tissue", "cell type", "source_name", "organ"]


@query(f"""with {_META}, k as (select distinct global_index, {', '.join(f"trim(regexp_extract(coalesce(characteristics, ''), '(?i)(?:^|[,;|]){k}:([^,;|]*)', 1)) as k{i}" for i, k in enumerate(_KEYS))}, source_name from m),
 {_coalesced_sql([(f'k{i}', '') for i in range(len(_KEYS))] + [('source_name', '')], 'global_index', 'k')}""")
def derive_tissue(spark, d):
    from strandloom.functions.text import keyed_value

    m = read(spark, d, "archs4_metadata").select("global_index", "characteristics", "source_name").distinct()
    fields = [keyed_value(F.col("characteristics"), k) for k in _KEYS] + [F.col("source_name")]
    return m.select("global_index", rules.coalesced(*fields).alias("bucket"))


@query("""with s as (select row_id, trim("study.characteristics.strain") as strain from osdr_samples), n as (select lower(strain) as k, strain, count(*) as n from s where strain is not null group by 1, 2),
 b as (select k, arg_min(strain, (-n, strain)) as best from n group by 1) select s.row_id, b.best as strain from s left join b on lower(s.strain) = b.k""")
def harmonize_categories(spark, d):
    s = samples(spark, d).select("row_id", F.trim("strain").alias("strain"))
    n = s.filter("strain is not null").groupBy(F.lower("strain").alias("k"), "strain").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("k").agg(F.min_by("strain", F.struct(-F.col("n"), F.col("strain"))).alias("best"))
    return s.join(best, F.lower(s["strain"]) == F.col("k"), "left").select("row_id", F.col("best").alias("strain"))


def plan_categories(labels: DataFrame) -> DataFrame:
    """label, n, slot, shown: the legend of a label column.

    The TOP most frequent telling labels keep their own name, the others share
    Other; residual labels stay in grey rows of their own, Unknown last.
    """
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    residual = F.col("label").isNull() | F.col("label").isin("Other", "Unknown", "unknown", "nan", "None", "")
    # A limit keeps TOP rows a task, so that labels in any number are never sorted in one place.
    top = n.filter(~F.coalesce(residual, F.lit(True))).orderBy(F.desc("n"), "label").limit(TOP).select(F.col("label").alias("top"))
    marked = n.withColumn("residual", residual).join(F.broadcast(top), F.col("label") == F.col("top"), "left")  # TOP rows
    shown = F.when(F.col("residual"), F.coalesce("label", F.lit("not covered"))).when(F.col("top").isNotNull(), F.col("label")).otherwise("Other")
    return marked.withColumn("shown", shown).drop("top")


LEGEND = f"""n as (select label, count(*) as n from lab group by 1), r as (select label, n, (label is null or label in ('Other', 'Unknown', 'unknown', 'nan', 'None', '')) as residual from n),
 q as (select *, row_number() over (partition by residual order by n desc, label nulls first) as r from r), plan as (select label, n, residual, r, case when residual then coalesce(label, 'not covered') when r <= {TOP} then label else 'Other' end as shown from q),
 legend as (select shown, sum(n)::bigint as n, bool_and(residual or shown = 'Other') as grey from plan group by 1),
 slots as (select shown, n, row_number() over (order by (shown in ('Unknown', 'not covered')), grey, n desc, shown) - 1 as slot from legend)"""


def legend(labels: DataFrame) -> DataFrame:
    """shown, n, slot of the legend: at most TOP rows and the few residual ones, so the last window is tiny."""
    p = plan_categories(labels)
    g = p.groupBy("shown").agg(F.sum("n").alias("n"), F.bool_and(F.col("residual") | (F.col("shown") == "Other")).alias("grey"))
    w = Window.orderBy(F.col("shown").isin("Unknown", "not covered"), "grey", F.desc("n"), "shown")
    return g.withColumn("slot", (F.row_number().over(w) - 1).cast("long")).select("shown", "n", "slot")


_LAB = "lab as (select distinct global_index, nullif(trim(tissue), '') as label from archs4_metadata)"


def tissue_labels(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "archs4_metadata").select("global_index", F.nullif(F.trim("tissue"), F.lit("")).alias("label")).distinct()


@query(f"with {_LAB}, {LEGEND} select shown, n, slot from slots")
def category_plan(spark, d):
    return legend(tissue_labels(spark, d).select("label"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    lab = tissue_labels(spark, d)
    p = plan_categories(lab.select("label")).select(F.col("label").alias("p_label"), "shown")
    # The legend and its labels are joined by size: Spark broadcasts them only below its threshold.
    j = lab.join(p, F.col("label").eqNullSafe(F.col("p_label"))).join(legend(lab.select("label")).select("shown", "slot"), "shown")
    return j.select("global_index", "label", "shown", F.when(F.col("label").isNull(), -1).otherwise(F.col("slot")).alias("slot"))


@query(f"with {_LAB}, {LEGEND} select l.global_index, case when l.label is null then -1 else s.slot end as slot from lab l join plan p on l.label is not distinct from p.label join slots s on s.shown = p.shown")
def display_codes(spark, d):
    return codes(spark, d).select("global_index", "slot")


@query("select l.global_index, nullif(trim(m.tissue), '') as tissue, case when l.species_id = 0 then 'Human' else 'Mouse' end as species from sample_locations l left join (select global_index, max(tissue) as tissue from archs4_metadata group by 1) m using (global_index)")
def colorby_labels(spark, d):
    m = read(spark, d, "archs4_metadata").groupBy(F.col("global_index").cast("long").alias("global_index")).agg(F.max("tissue").alias("tissue"))
    j = read(spark, d, "sample_locations").join(m, "global_index", "left")
    return j.select("global_index", F.nullif(F.trim("tissue"), F.lit("")).alias("tissue"), F.when(F.col("species_id") == 0, "Human").otherwise("Mouse").alias("species"))


@query("select sample_key, coalesce(habitat, 'Unknown') as value, 'Unknown' as missing_field from (select distinct sample_key, habitat from osdr_metadata)")
def field_values(spark, d):
    m = read(spark, d, "osdr_metadata")
    pick = lambda c: F.coalesce(F.col(c), F.lit("Unknown")) if c in m.columns else F.lit("Unknown")
    return m.select("sample_key", "habitat").distinct().select("sample_key", pick("habitat").alias("value"), pick("altitude").alias("missing_field"))


@query(f"""with m as (select distinct sample_key, tissue, spaceflight from osdr_metadata), n as (select sample_key, lower(trim(coalesce(spaceflight, ''))) as f, {rules.sql_normalised('tissue')} as t from m)
select sample_key, case when f in ('', 'nan', 'none', 'na', 'n/a', 'unknown') then 'Unknown' when contains(f, 'flight') and not contains(f, 'control') then 'Space Flight' when regexp_matches(f, 'control|basal|vivarium|ground|cohort') then 'Ground' else 'Unknown' end as status,
 {rules.sql_canonical('t')} as bucket from n""")
def query_labels(spark, d):
    m = read(spark, d, "osdr_metadata").select("sample_key", "tissue", "spaceflight").distinct()
    return m.select("sample_key", cases.flight_status(F.col("spaceflight")).alias("status"), rules.canonical(F.col("tissue")).alias("bucket"))


# ---- samples and views ------------------------------------------------------------------


@query(f"select vec_id from embeddings order by md5('{SEED}|' || vec_id), vec_id limit 100")
def uniform_sample(spark, d):
    return sampling.uniform(read(spark, d, "embeddings"), "vec_id", 100, SEED).select("vec_id")


STRATA = """sizes as (select label, count(*) as size from pool group by 1), quota as (select label, case when sum(size) over () <= {n} then size else least(greatest(1, round_even(size * {n}.0 / sum(size) over (), 0)::bigint), size) end as take from sizes),
 ranked as (select p.*, row_number() over (partition by label order by md5('42|' || vec_id), vec_id) as r from pool p), drawn as (select ranked.* from ranked join quota using (label) where r <= take)"""


@query(f"with pool as (select vec_id, label from embeddings), {STRATA.format(n=150)} select vec_id, label::bigint as label from drawn")
def stratified_sample(spark, d):
    return sampling.stratified(read(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), "vec_id", "label", 150, SEED).select("vec_id", "label")


_VIEW = "pool as (select vec_id, label from embeddings where embedding[1]::double between -0.2 and 0.2 and embedding[2]::double between -0.2 and 0.2)"


def viewport(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").filter(e[0].between(-0.2, 0.2) & e[1].between(-0.2, 0.2)).select("vec_id", F.col("label").cast("long").alias("label"), e[0].alias("x"), e[1].alias("y"))


@query(f"with {_VIEW}, {STRATA.format(n=120)} select vec_id, label::bigint as label from drawn")
def viewport_sample(spark, d):
    return sampling.stratified(viewport(spark, d), "vec_id", "label", 120, SEED).select("vec_id", "label")


@query(f"with {_VIEW}, {STRATA.format(n=120)} select vec_id from drawn order by md5('7|' || vec_id), vec_id limit 40")
def cap_3d(spark, d):
    return sampling.uniform(viewport_sample(spark, d), "vec_id", 40, 7).select("vec_id")


@query(f"with {_VIEW}, {STRATA.format(n=120)}, a as (select label, count(*) as n_all from embeddings group by 1) select label::bigint as label, n_all, count(*) as n_drawn from drawn join a using (label) group by 1, 2")
def legend_drawn_counts(spark, d):
    whole = read(spark, d, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n_all"))
    return viewport_sample(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n_drawn")).join(whole, "label").select("label", "n_all", "n_drawn")


@query(f"with {_VIEW}, {STRATA.format(n=120)} select 'category' as layer, vec_id, label::bigint as label from drawn where label < 5 union all select 'context', vec_id, label from drawn where label >= 5")
def map_view(spark, d):
    return viewport_sample(spark, d).select(F.when(F.col("label") < 5, "category").otherwise("context").alias("layer"), "vec_id", "label")


@query("""with a as (select vec_id, label, row_number() over (order by vec_id) as place from embeddings), b as (select label, row_number() over (order by md5('42|' || vec_id), vec_id) as place from embeddings)
 select a.place, a.vec_id, a.label::bigint as label, b.label::bigint as permuted from a join b using (place)""")
def permuted_labels(spark, d):
    """Every row by id, with its own label and the label at the same place of the shuffled order."""
    e = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    own = positions(e, [F.col("vec_id")], "place").select("place", "vec_id", "label")
    drawn = positions(e, [sampling.ticket(SEED, "vec_id"), F.col("vec_id")], "place").select("place", F.col("label").alias("permuted"))
    return own.join(drawn, "place").select("place", "vec_id", "label", "permuted")


@query("select shard_idx::bigint as shard, row_in_shard::bigint as line, coalesce((select count(*) from sample_locations b where b.shard_idx < a.shard_idx), 0) + row_number() over (partition by shard_idx order by row_in_shard) - 1 as position from sample_locations a")
def assign_global_index(spark, d):
    """Row number within the shard plus the counts of earlier shards (one row a shard)."""
    loc = read(spark, d, "sample_locations").select(F.col("shard_idx").cast("long").alias("shard"), F.col("row_in_shard").cast("long").alias("line"))
    sizes = loc.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    start = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "start")
    r = F.row_number().over(Window.partitionBy("shard").orderBy("line"))
    return loc.withColumn("r", r).join(start, "shard").select("shard", "line", (F.col("start") + F.col("r") - 1).alias("position"))


# ---- retrieval network and overlay over stored hits ----------------------------------------

_TOPHITS = """h as (select distinct hit_id, sample_key, gsm, score, gse, tissue, archs4_index from hits_df where score is not null and not isnan(score) and sample_key is not null),
 top as (select *, row_number() over (partition by sample_key order by score desc, hit_id) as r from h qualify r <= 5)"""


def top_hits(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    h = read(spark, d, "hits_df").filter("score is not null and not isnan(score) and sample_key is not null").select("hit_id", "sample_key", "gsm", "score", "gse", "tissue", "archs4_index").distinct()
    return h.withColumn("r", F.row_number().over(Window.partitionBy("sample_key").orderBy(F.desc("score"), "hit_id"))).filter(F.col("r") <= k)


_SERIES = "gse is not null and gse not in ('', 'nan') and trim(gse) <> ''"


@query(f"with {_TOPHITS} select sample_key as source, gsm as target, round(1.5 + least(greatest((score - 0.9) / 0.1, 0), 1) * 6.5, 6) as width from top union select gsm, gse, round(greatest(1, 0.7 * (1.5 + least(greatest((score - 0.9) / 0.1, 0), 1) * 6.5)), 6) from top where {_SERIES}")
def network_edges(spark, d):
    t = top_hits(spark, d)
    w = vec.edge_width(F.col("score"))
    a = t.select(F.col("sample_key").alias("source"), F.col("gsm").alias("target"), F.round(w, 6).alias("width"))
    b = t.filter(_SERIES).select("gsm", "gse", F.round(F.greatest(F.lit(1.0), 0.7 * w), 6))
    return a.union(b).distinct()


@query(f"""with {_TOPHITS} select sample_key, gsm, dense_rank() over (partition by sample_key order by coalesce(gse, '')) - 1 as slot, round(16 + greatest(0, (score - min(score) over (partition by sample_key)) * 20), 6) as size,
 round((count(*) over (partition by sample_key) - 1) / 2.0 * 1.4 - (r - 1) * 1.4, 6) as y, r as rank from top""")
def network_nodes(spark, d):
    w = Window.partitionBy("sample_key")
    slot = F.dense_rank().over(w.orderBy(F.coalesce("gse", F.lit("")))) - 1
    return top_hits(spark, d).select("sample_key", "gsm", slot.cast("long").alias("slot"), F.round(16 + F.greatest(F.lit(0.0), (F.col("score") - F.min("score").over(w)) * 20), 6).alias("size"),
                                     F.round((F.count(F.lit(1)).over(w) - 1) / 2.0 * 1.4 - (F.col("r") - 1) * 1.4, 6).alias("y"), F.col("r").cast("long").alias("rank"))


@query("select distinct hit_id, round(1.5 + least(greatest((score - 0.9) / (1.0 - 0.9), 0), 1) * 6.5, 6) as width from hits_df where score is not null and not isnan(score)")
def edge_width(spark, d):
    return read(spark, d, "hits_df").filter("score is not null and not isnan(score)").select("hit_id", F.round(vec.edge_width(F.col("score")), 6).alias("width")).distinct()


@query(f"with {_TOPHITS} select sample_key, count(*) as n_hits, count(*) filter (where archs4_index is not null) as n_located, case when count(*) filter (where archs4_index is not null) = 1 then '1 hit' else count(*) filter (where archs4_index is not null) || ' hits' end as message from top group by 1")
def locatable_hits(spark, d):
    g = top_hits(spark, d).groupBy("sample_key").agg(F.count(F.lit(1)).alias("n_hits"), F.count("archs4_index").alias("n_located"))
    return g.withColumn("message", F.when(F.col("n_located") == 1, "1 hit").otherwise(F.concat(F.col("n_located").cast("string"), F.lit(" hits"))))


@query(f"with {_TOPHITS} select t.sample_key, t.hit_id, t.r as rank, l.global_index as point, coalesce(m.tissue, '-') as label from top t join sample_locations l on t.archs4_index = l.global_index left join (select global_index, max(tissue) as tissue from archs4_metadata group by 1) m on m.global_index = l.global_index")
def retrieval_overlay(spark, d):
    m = read(spark, d, "archs4_metadata").groupBy(F.col("global_index").cast("long").alias("point")).agg(F.max("tissue").alias("t"))
    loc = read(spark, d, "sample_locations").select(F.col("global_index").alias("point"))
    return top_hits(spark, d).withColumn("point", F.col("archs4_index")).join(loc, "point").join(m, "point", "left").select("sample_key", "hit_id", F.col("r").cast("long").alias("rank"), "point", F.coalesce("t", F.lit("-")).alias("label"))


@query("select sample_key, coalesce(bucket, '-') as label from (select distinct q.sample_key, m.tissue as bucket from osdr_query_embeddings q left join (select sample_key, max(tissue) as tissue from osdr_metadata group by 1) m using (sample_key))")
def hover_rows(spark, d):
    m = read(spark, d, "osdr_metadata").groupBy("sample_key").agg(F.max("tissue").alias("t"))
    return read(spark, d, "osdr_query_embeddings").select("sample_key").distinct().join(m, "sample_key", "left").select("sample_key", F.coalesce("t", F.lit("-")).alias("label"))


QUERIES, SQL = R.QUERIES, R.SQL
