"""Scans, projections, filters, joins, set operations and deduplication over the project tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import cases, text
from strandloom.operators import dedupe
from strandloom.operators.positions import positions
from strandloom.plans.registry import Registry
from strandloom.tables import col, read

R = Registry()
query = R.query
TOKENS = "('', 'nan', 'none', 'na', 'n/a')"
KEY = 'concat_ws(\'|\', "id.accession", trim("id.sample name"))'


def samples(spark: SparkSession, d: str) -> DataFrame:
    """The sample sheet with plain column names."""
    return read(spark, d, "osdr_samples").select(
        "row_id", F.concat_ws("|", col("id.accession"), F.trim(col("id.sample name"))).alias("sample_key"), col("id.accession").alias("study"), col("id.sample name").alias("sample_name"),
        col("study.characteristics.organism").alias("organism"), col("study.characteristics.material type").alias("tissue"), col("study.characteristics.strain").alias("strain"),
        col("study.characteristics.sex").alias("sex"), col("study.factor value.spaceflight").alias("spaceflight"), col("study.factor value.genotype").alias("genotype"),
        col("study.parameter value.habitat").alias("habitat"), col("study.parameter value.duration").alias("duration"), col("study.parameter value.diet").alias("diet"), "counts_path", "ingested_at",
    )


def told(c: str):
    return F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c))).isin("", "nan", "none", "na", "n/a")


@query(f"""select row_id, {KEY} as sample_key, "id.accession" as study, "study.characteristics.material type" as tissue, "study.characteristics.strain" as strain,
 "study.factor value.spaceflight" as spaceflight, "study.parameter value.habitat" as habitat, '' as enrichment from osdr_samples""")
def scan_project(spark, d):
    return samples(spark, d).select("row_id", "sample_key", "study", "tissue", "strain", "spaceflight", "habitat", F.lit("").alias("enrichment"))


@query(f'select distinct {KEY} as sample_key from osdr_samples where length(trim("id.sample name")) > 0')
def sample_key(spark, d):
    return samples(spark, d).filter("length(trim(sample_name)) > 0").select("sample_key").distinct()


@query("""select row_id, "study.characteristics.organism" as organism from osdr_samples where contains(lower("study.characteristics.organism"), 'mus musculus')""")
def filter_contains_ci(spark, d):
    return samples(spark, d).filter(F.lower("organism").contains("mus musculus")).select("row_id", "organism")


@query(f"""select row_id, {KEY} as sample_key from osdr_samples where contains(lower("study.characteristics.organism"), 'mus')
 and lower(trim(counts_path)) not in {TOKENS} and lower(trim("study.factor value.spaceflight")) not in {TOKENS}""")
def filter_eligible(spark, d):
    return samples(spark, d).filter(F.lower("organism").contains("mus") & told("counts_path") & told("spaceflight")).select("row_id", "sample_key")


@query("select global_index, len(embedding) as dim from sample_embeddings where embedding is not null")
def scan_embeddings(spark, d):
    return read(spark, d, "sample_embeddings").filter("embedding is not null").select("global_index", F.size("embedding").cast("long").alias("dim"))


@query("select shard_file, count(*) as n_rows, min(row_in_shard)::bigint as first_row, max(row_in_shard)::bigint as last_row from sample_locations group by 1")
def shard_counts(spark, d):
    return read(spark, d, "sample_locations").groupBy("shard_file").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_in_shard").cast("long").alias("first_row"), F.max("row_in_shard").cast("long").alias("last_row"))


@query("""select l_orderkey, l_linenumber::bigint as line, sample, round(value, 6) as value from (
 select l_orderkey, l_linenumber, 'l_quantity' as sample, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice from lineitem
 union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem) where value is not null""")
def unpivot_counts(spark, d):
    from strandloom.operators.expression import unpivot

    wide = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_quantity", "l_extendedprice", "l_tax")
    return unpivot(wide, ["l_orderkey", "line"], ["l_quantity", "l_extendedprice", "l_tax"]).select("l_orderkey", "line", "sample", F.round("count", 6).alias("value"))


@query("""select hit_id, case when lower(trim(species)) like 'human%' then 0 when lower(trim(species)) like 'mouse%' then 1 end::bigint as code from hits_df""")
def species_code(spark, d):
    return read(spark, d, "hits_df").select("hit_id", cases.species_code(F.col("species")).cast("long").alias("code"))


@query("select global_index, case when species_id = 0 then 'Homo sapiens' else 'Mus musculus' end as species from sample_locations")
def species_label(spark, d):
    return read(spark, d, "sample_locations").select("global_index", cases.species_label(F.col("species_id")).alias("species"))


@query("""with s as (select row_id, lower(trim(coalesce("study.factor value.spaceflight", ''))) as t from osdr_samples)
select row_id, case when t in ('', 'nan', 'none', 'na', 'n/a', 'unknown') then 'Unknown' when contains(t, 'flight') and not contains(t, 'control') then 'Space Flight'
 when regexp_matches(t, 'control|basal|vivarium|ground|cohort') then 'Ground' else 'Unknown' end as status from s""")
def flight_status(spark, d):
    return samples(spark, d).select("row_id", cases.flight_status(F.col("spaceflight")).alias("status"))


@query("select hit_id, loaded_at, case when gse is null or gse in ('nan', 'None', '<NA>') then '' else gse end as gse from hits_df")
def blank_sentinels(spark, d):
    return read(spark, d, "hits_df").select("hit_id", "loaded_at", cases.blank_sentinels(F.col("gse")).alias("gse"))


@query(r"""select row_id, round(case when regexp_full_match(trim("study.parameter value.duration"), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then trim("study.parameter value.duration")::double else 0 end, 6) as number from osdr_samples""")
def numeric_coerce(spark, d):
    return samples(spark, d).select("row_id", F.round(cases.number_or_zero(F.col("duration")), 6).alias("number"))


@query("select vec_id from embeddings where embedding[1]::double between -0.05 and 0.1 and embedding[2]::double between -0.1 and 0.1")
def viewport_filter(spark, d):
    e = F.col("embedding").cast("array<double>")
    return read(spark, d, "embeddings").filter(e[0].between(-0.05, 0.1) & e[1].between(-0.1, 0.1)).select("vec_id")


def tiers(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("file", F.regexp_extract("counts_path", r"([^/\\]*)$", 1))
    vectors = read(spark, d, "osdr_query_embeddings").filter("embedding is not null").select("sample_key", F.lit(True).alias("has_vector")).distinct()
    columns = read(spark, d, "counts_columns").select(F.col("file_name").alias("file"), F.trim("sample_name").alias("name"), F.lit(True).alias("has_column")).distinct()
    j = s.withColumn("name", F.trim("sample_name")).join(vectors, "sample_key", "left").join(columns, ["file", "name"], "left")
    tier = cases.sample_tier(F.coalesce("has_vector", F.lit(False)), F.col("spaceflight"), F.col("counts_path"), F.coalesce("has_column", F.lit(False)))
    return j.select("row_id", "sample_key", "study", tier.alias("tier"))


TIERS = f"""tiers as (select s.row_id, {KEY} as sample_key, s."id.accession" as study, case when exists (select 1 from osdr_query_embeddings q where q.embedding is not null and q.sample_key = {KEY}) then 'cached'
 when "study.factor value.spaceflight" is null or lower(trim("study.factor value.spaceflight")) in {TOKENS} or counts_path is null or lower(trim(counts_path)) in {TOKENS} then 'unavailable'
 when exists (select 1 from counts_columns c where c.file_name = regexp_extract(s.counts_path, '([^/\\\\]*)$', 1) and trim(c.sample_name) = trim(s."id.sample name")) then 'subprocess' else 'unavailable' end as tier
 from osdr_samples s)"""


@query(f"with {TIERS} select row_id, tier from tiers")
def sample_tier(spark, d):
    return tiers(spark, d).select("row_id", "tier")


@query(f"with {TIERS} select study, count(*) filter (where tier <> 'unavailable') as n_eligible, count(*) as n_samples from tiers group by 1")
def eligible_count(spark, d):
    return tiers(spark, d).groupBy("study").agg(F.count_if(F.col("tier") != "unavailable").alias("n_eligible"), F.count(F.lit(1)).alias("n_samples"))


@query(f"with {TIERS} select study, bool_and(tier = 'unavailable') as all_unavailable from tiers group by 1")
def study_all_unavailable(spark, d):
    return tiers(spark, d).groupBy("study").agg(F.bool_and(F.col("tier") == "unavailable").alias("all_unavailable"))


@query(f"""with {TIERS}, k as (select sample_key, min(case tier when 'cached' then 0 when 'subprocess' then 1 else 2 end) as r, min(study) as study from tiers group by 1)
select study, sample_key, case r when 0 then 'cached' when 1 then 'subprocess' else 'unavailable' end as tier, (r < 2 and sample_key = min(case when r < 2 then sample_key end) over (partition by study)) as is_default from k""")
def picker_options(spark, d):
    rank = F.when(F.col("tier") == "cached", 0).when(F.col("tier") == "subprocess", 1).otherwise(2)
    k = tiers(spark, d).groupBy("sample_key").agg(F.min(rank).alias("r"), F.min("study").alias("study"))
    first = k.filter("r < 2").groupBy("study").agg(F.min("sample_key").alias("first"))
    tier = F.when(F.col("r") == 0, "cached").when(F.col("r") == 1, "subprocess").otherwise("unavailable")
    return k.join(first, "study", "left").select("study", "sample_key", tier.alias("tier"), F.when(F.col("r") < 2, F.col("sample_key") == F.col("first")).otherwise(False).alias("is_default"))


@query("select tissue as label, count(*) as n from hits_df where contains(lower(tissue), 'mus') group by 1")
def legend_search(spark, d):
    return read(spark, d, "hits_df").filter(F.lower("tissue").contains("mus")).groupBy(F.col("tissue").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""select h.hit_id, h.loaded_at, coalesce(g.title, '') as title, coalesce(g.geo_summary, 'none yet') as summary from hits_df h left join geo_records g on h.gse = g.gse""")
def conditional_update(spark, d):
    g = read(spark, d, "geo_records").select("gse", "title", "geo_summary")
    return read(spark, d, "hits_df").select("hit_id", "loaded_at", "gse").join(g, "gse", "left").select("hit_id", "loaded_at", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("geo_summary", F.lit("none yet")).alias("summary"))


@query("select h.hit_id, h.loaded_at, m.series_id, m.title from hits_df h left join (select geo_accession, min(series_id) as series_id, min(title) as title from archs4_metadata group by 1) m on h.gsm = m.geo_accession")
def hits_left_join(spark, d):
    m = read(spark, d, "archs4_metadata").groupBy("geo_accession").agg(F.min("series_id").alias("series_id"), F.min("title").alias("title"))
    return read(spark, d, "hits_df").select("hit_id", "loaded_at", F.col("gsm").alias("geo_accession")).join(m, "geo_accession", "left").select("hit_id", "loaded_at", "series_id", "title")


@query("""with m as (select distinct global_index, geo_accession, series_id, source_name, title from archs4_metadata)
select m.global_index, coalesce(nullif(trim(m.series_id), ''), '') as series, coalesce(nullif(trim(m.source_name), ''), g.title, '') as source, coalesce(nullif(trim(m.title), ''), g.geo_summary, '') as title
from m left join geo_records g on trim(split_part(m.series_id, ',', 1)) = g.gse""")
def enrich_blank_fill(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", "geo_accession", "series_id", "source_name", "title").distinct()
    g = read(spark, d, "geo_records").select("gse", F.col("title").alias("g_title"), "geo_summary")
    j = m.withColumn("gse", F.trim(F.element_at(F.split("series_id", ","), 1))).join(g, "gse", "left")
    keep = lambda c: F.nullif(F.trim(c), F.lit(""))
    return j.select("global_index", F.coalesce(keep("series_id"), F.lit("")).alias("series"), F.coalesce(keep("source_name"), "g_title", F.lit("")).alias("source"), F.coalesce(keep("title"), "geo_summary", F.lit("")).alias("title"))


@query("""with m as (select distinct global_index, series_id from archs4_metadata), g as (select gse, trim(split_part(pubmed_ids_ncbi, ';', 1)) as pmid from geo_records)
select m.global_index, g.gse, coalesce(g.pmid, '') as pmid, coalesce(l.n_docs, 0)::bigint as n_docs from m left join g on trim(split_part(m.series_id, ',', 1)) = g.gse
left join (select gse, count(*) as n_docs from documents where gse is not null group by 1) l on l.gse = g.gse""")
def two_hop_join(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", "series_id").distinct().select("global_index", F.trim(F.element_at(F.split("series_id", ","), 1)).alias("s"))
    g = read(spark, d, "geo_records").select("gse", F.trim(F.element_at(F.split("pubmed_ids_ncbi", ";"), 1)).alias("pmid"))
    n = read(spark, d, "documents").filter("gse is not null").groupBy(F.col("gse").alias("dg")).agg(F.count(F.lit(1)).alias("n_docs"))
    return m.join(g, F.col("s") == F.col("gse"), "left").join(n, F.col("gse") == F.col("dg"), "left").select("global_index", "gse", F.coalesce("pmid", F.lit("")).alias("pmid"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("select l.global_index, coalesce(m.title, '') as title from sample_locations l left join (select geo_accession, min(title) as title from archs4_metadata group by 1) m using (geo_accession)")
def reindex_left(spark, d):
    m = read(spark, d, "archs4_metadata").groupBy("geo_accession").agg(F.min("title").alias("title"))
    return read(spark, d, "sample_locations").select("global_index", "geo_accession").join(m, "geo_accession", "left").select("global_index", F.coalesce("title", F.lit("")).alias("title"))


@query('select row_id from osdr_samples s where exists (select 1 from counts_columns c where trim(c.sample_name) = trim(s."id.sample name"))')
def semi_join_available(spark, d):
    c = read(spark, d, "counts_columns").select(F.trim("sample_name").alias("name"))
    return samples(spark, d).select("row_id", F.trim("sample_name").alias("name")).join(c, "name", "left_semi").select("row_id")


@query('select row_id from osdr_samples s where not exists (select 1 from counts_columns c where trim(c.sample_name) = trim(s."id.sample name"))')
def anti_join_missing(spark, d):
    c = read(spark, d, "counts_columns").select(F.trim("sample_name").alias("name"))
    return samples(spark, d).select("row_id", F.trim("sample_name").alias("name")).join(c, "name", "left_anti").select("row_id")


@query("select p_brand, arg_min(p_size, p_partkey)::bigint as length from part where p_size > 10 group by 1")
def first_wins_lookup(spark, d):
    return read(spark, d, "part").filter("p_size > 10").groupBy("p_brand").agg(F.min_by("p_size", "p_partkey").cast("long").alias("length"))


@query("select hit_id, min(sample_key) as sample_key, min(loaded_at) as loaded_at from hits_df group by 1")
def dedupe_first(spark, d):
    h = read(spark, d, "hits_df").select("hit_id", "loaded_at", "sample_key")
    return dedupe.keep_first(h, ["hit_id"], [F.col("loaded_at")]).select("hit_id", "sample_key", "loaded_at")


@query("select hit_id, max(loaded_at) as loaded_at from hits_df group by 1")
def upsert_last(spark, d):
    return dedupe.keep_last(read(spark, d, "hits_df").select("hit_id", "loaded_at"), ["hit_id"], [F.col("loaded_at")]).select("hit_id", "loaded_at")


@query("""select 0::bigint as dataset, global_index::bigint as point from sample_embeddings where embedding is not null
union all select 1, (select max(global_index) from sample_embeddings) + row_number() over (order by sample_key) from (select distinct sample_key from osdr_query_embeddings where embedding is not null)""")
def union_corpora(spark, d):
    a = read(spark, d, "sample_embeddings").filter("embedding is not null").select(F.lit(0).cast("long").alias("dataset"), F.col("global_index").alias("point"))
    keys = read(spark, d, "osdr_query_embeddings").filter("embedding is not null").select("sample_key").distinct()
    last = read(spark, d, "sample_embeddings").agg(F.max("global_index")).scalar()
    b = positions(keys, [F.col("sample_key")]).select(F.lit(1).cast("long").alias("dataset"), (last + F.col("position")).alias("point"))
    return a.unionByName(b)


@query("select accession as study, title, null::varchar as summary from osdr_studies union all select gse, title, geo_summary from geo_records")
def union_missing_cols(spark, d):
    a = read(spark, d, "osdr_studies").select(F.col("accession").alias("study"), "title")
    b = read(spark, d, "geo_records").select(F.col("gse").alias("study"), "title", F.col("geo_summary").alias("summary"))
    return a.unionByName(b, allowMissingColumns=True)


@query("select sample_key from osdr_metadata except select sample_key from osdr_query_embeddings")
def except_ids(spark, d):
    return read(spark, d, "osdr_metadata").select("sample_key").subtract(read(spark, d, "osdr_query_embeddings").select("sample_key"))


@query("select sample_key from osdr_metadata intersect select sample_key from osdr_query_embeddings where embedding is not null")
def intersect_ids(spark, d):
    return read(spark, d, "osdr_metadata").select("sample_key").intersect(read(spark, d, "osdr_query_embeddings").filter("embedding is not null").select("sample_key"))


# ---- text and JSON ------------------------------------------------------------


@query("select distinct file_name, split_part(file_name, '.', 1) as gene from counts_columns")
def strip_version(spark, d):
    return read(spark, d, "counts_columns").select("file_name").distinct().select("file_name", text.strip_version(F.col("file_name")).alias("gene"))


@query(r"""with s as (select row_id, trim(regexp_replace(regexp_replace(coalesce("study.parameter value.habitat", ''), '\s+', ' ', 'g'), '\{(.+?)\}', '\1', 'g')) as t from osdr_samples)
select row_id, case when lower(t) in ('', 'nan', 'none', 'na', 'n/a') then 'Unknown' else t end as habitat from s""")
def harmonize_text(spark, d):
    return samples(spark, d).select("row_id", text.harmonize(F.col("habitat")).alias("habitat"))


@query(r"select doc_id, upper(regexp_extract(text, '(?i)(GSE\d+)', 1)) as found from documents")
def extract_gse(spark, d):
    return read(spark, d, "documents").select("doc_id", text.extract_gse(F.col("text")).alias("found"))


@query("""with m as (select distinct global_index, series_id from archs4_metadata) select global_index, case when lower(trim(split_part(coalesce(series_id, ''), ',', 1))) in ('null', 'nan', 'none') then '' else trim(split_part(coalesce(series_id, ''), ',', 1)) end as series from m""")
def first_series(spark, d):
    return read(spark, d, "archs4_metadata").select("global_index", "series_id").distinct().select("global_index", text.first_of_list(F.col("series_id")).alias("series"))


def _keyed(key: str) -> str:
    return f"trim(regexp_extract(coalesce(characteristics, ''), '(?i)(?:^|[,;|]){key}:([^,;|]*)', 1))"


@query(f"with m as (select distinct global_index, characteristics from archs4_metadata) select global_index, {_keyed('tissue')} as tissue, {_keyed('strain')} as strain, {_keyed('age')} as age from m")
def characteristics_value(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", "characteristics").distinct()
    return m.select("global_index", *[text.keyed_value(F.col("characteristics"), k).alias(k) for k in ("tissue", "strain", "age")])


@query("""with m as (select distinct global_index, source_name, title, geo_accession from archs4_metadata) select global_index, coalesce(nullif(trim(source_name), ''), nullif(trim(title), ''), geo_accession, '') as shown from m""")
def first_non_empty(spark, d):
    m = read(spark, d, "archs4_metadata").select("global_index", "source_name", "title", "geo_accession").distinct()
    return m.select("global_index", text.first_non_empty(F.col("source_name"), F.col("title"), F.col("geo_accession")).alias("shown"))


@query(r"select doc_id, coalesce(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x) <> '')[-1], '') as line from documents")
def last_line(spark, d):
    return read(spark, d, "documents").select("doc_id", text.last_line(F.col("text")).alias("line"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[^\x20-\x7E\n]', ' ', 'g'), ' {2,}', ' ', 'g'), '\n{3,}', e'\n\n', 'g')) as clean from documents")
def sanitize_ascii(spark, d):
    return read(spark, d, "documents").select("doc_id", text.sanitize_ascii(F.col("text")).alias("clean"))


@query("select doc_id, case when length(text) > 800 then left(text, 800) || '...' else text end as short from documents")
def truncate_text(spark, d):
    return read(spark, d, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query(r"select gse, 'geo/series/' || case when length(upper(gse)) > 6 then regexp_replace(upper(gse), '\d{3}$', 'nnn') else 'GSEnnn' end || '/' || upper(gse) as folder from geo_records")
def gse_url(spark, d):
    return read(spark, d, "geo_records").select("gse", text.gse_folder(F.col("gse")).alias("folder"))


@query("select distinct sample_key, split_part(sample_key, '|', 1) as study, substr(sample_key, strpos(sample_key, '|') + 1) as sample from osdr_metadata")
def split_key(spark, d):
    k = F.col("sample_key")
    return read(spark, d, "osdr_metadata").select("sample_key").distinct().select("sample_key", F.substring_index(k, "|", 1).alias("study"), F.expr("substr(sample_key, instr(sample_key, '|') + 1)").alias("sample"))


@query("select tissue as label, format('{:,}', count(*)) as shown from hits_df group by 1")
def format_values(spark, d):
    return read(spark, d, "hits_df").groupBy(F.col("tissue").alias("label")).agg(F.format_number(F.count(F.lit(1)), 0).alias("shown"))


@query("select distinct sample_key, '/?q=' || replace(replace(replace(sample_key, '|', '%7C'), ' ', '+'), '/', '%2F') as link, sample_key as decoded from osdr_metadata where contains(sample_key, '|')")
def url_parts(spark, d):
    k = read(spark, d, "osdr_metadata").filter(F.col("sample_key").contains("|")).select("sample_key").distinct()
    return k.withColumn("link", F.concat(F.lit("/?q="), F.url_encode("sample_key"))).withColumn("decoded", F.url_decode(F.parse_url(F.concat(F.lit("http://x"), F.col("link")), F.lit("QUERY"), F.lit("q"))))


@query("""select gse, 'Series ' || gse || ': ' || coalesce(title, '-') || chr(10) || coalesce(geo_summary, '-') || chr(10) || coalesce(geo_design, '-') as context from geo_records""")
def prompt_context(spark, d):
    """The context with the whole summary and the whole design."""
    part = lambda c: F.coalesce(c, F.lit("-"))
    return read(spark, d, "geo_records").select("gse", F.concat(F.lit("Series "), "gse", F.lit(": "), part("title"), F.lit("\n"), part("geo_summary"), F.lit("\n"), part("geo_design")).alias("context"))


@query("""select gse, trim(coalesce(geo_summary, '')) as summary, trim(coalesce(geo_design, '')) as design from geo_records""")
def soft_parse(spark, d):
    soft = F.concat(F.lit("^SERIES = "), "gse", F.lit("\n!Series_summary = "), F.regexp_replace(F.coalesce("geo_summary", F.lit("")), "\n", "\r"), F.lit("\n!Series_overall_design = "), F.regexp_replace(F.coalesce("geo_design", F.lit("")), "\n", "\r"))
    g = read(spark, d, "geo_records").select("gse", soft.alias("soft"))
    back = lambda tag: F.trim(F.regexp_replace(text.soft_values(F.col("soft"), tag), "\r", "\n"))
    return g.select("gse", back("!Series_summary").alias("summary"), back("!Series_overall_design").alias("design"))


@query("select event_id, (props->>'k')::bigint as k from events")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""select event_id, coalesce(nullif(trim(props->>'text'), ''), nullif(trim(props->>'k'), ''), '') as answer from events""")
def json_first_key(spark, d):
    from strandloom.functions.jsonx import first_key

    return read(spark, d, "events").select("event_id", first_key(F.col("props"), "text", "k").alias("answer"))


@query("""select global_index, '{"global_index":' || global_index || ',"shard_idx":' || shard_idx || ',"geo_accession":"' || geo_accession || '"}' as record from sample_locations""")
def to_json_rows(spark, d):
    return read(spark, d, "sample_locations").select("global_index", F.to_json(F.struct("global_index", "shard_idx", "geo_accession")).alias("record"))


@query("select global_index, len(embedding)::bigint as n, round(list_sum(embedding::double[]), 4) as total from sample_embeddings where embedding is not null")
def parse_vector(spark, d):
    from strandloom.functions.jsonx import parse_vector as parse

    v = read(spark, d, "sample_embeddings").filter("embedding is not null").select("global_index", parse(F.to_json(F.col("embedding").cast("array<double>"))).alias("v"))
    return v.select("global_index", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("select p_partkey, 2::bigint as n, round(p_size + p_retailprice, 6) as total from part")
def vector_from_columns(spark, d):
    wide = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("emb_0"), F.col("p_retailprice").alias("emb_1"))
    names = sorted((c for c in wide.columns if c.startswith("emb_")), key=lambda c: int(c[4:]))
    return wide.select("p_partkey", F.array(*names).alias("v")).select("p_partkey", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


QUERIES, SQL = R.QUERIES, R.SQL
