"""Queries p2, p3 and p4 and what belongs to them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import orphans as orp
from strandloom.operators import segment as seg
from strandloom.operators import units
from strandloom.session import cut
from strandloom.tables import col, is_missing, read, squeeze

DURATION = "study.parameter value.duration"


def _quantities(spark: SparkSession, d: str) -> DataFrame:
    samples = read(spark, d, "osdr_samples").select("row_id", col("id.accession").alias("accession"), "ingested_at", col(DURATION).alias("duration"))
    return units.with_quantities(samples, "duration", "accession", read(spark, d, "osdr_studies"), "accession", "description")


def _levelled(spark: SparkSession, d: str) -> DataFrame:
    """Every duration with the units it can have and the level of its study."""
    seconds = F.create_map(*[F.lit(x) for kv in units.UNIT_SECONDS.items() for x in kv])
    q = _quantities(spark, d).filter("q_num is not null").withColumn("number", F.col("q_num") / F.col("q_den"))
    q = q.withColumn("hours", F.when(F.col("q_unit_from") == "text", F.col("number") * F.try_element_at(seconds, F.col("q_unit")) / 3600))
    q = cut(q.select("row_id", "accession", "ingested_at", "q_num", "q_den", "q_units", "q_unit_from", "number", "hours"), "quantities")  # read several times, parsed once
    levels = units.source_levels(q, "accession", "hours")
    overall = q.filter("hours > 0").agg(F.avg(F.log("hours"))).scalar()
    return q.join(levels, F.col("accession") == F.col("lv_source"), "left").select(
        "row_id", "accession", "ingested_at", "q_num", "q_den", "q_units", "q_unit_from", "number", F.coalesce("lv", overall, F.lit(6.0)).alias("level"))


def _histories(q: DataFrame) -> DataFrame:
    """Durations with the unit that their study's history gives them, within the written and stated units."""
    return units.unit_history(q, "accession", ["ingested_at", "row_id"], "number", "level", fixed="q_units")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Hours of the durations whose unit is written or stated: number times the unit.

    Bare numbers go through the history of their study, which decides where the
    statement leaves several units open.  What is written with its own unit tells
    nothing of the unit of the bare numbers around it, only their level.
    """
    seconds = F.create_map(*[F.lit(x) for kv in units.UNIT_SECONDS.items() for x in kv])
    q = _levelled(spark, d)
    h = _histories(q.filter("q_unit_from = 'statement'")).select("row_id", "q_num", "q_den", "unit")
    h = h.unionByName(q.filter("q_unit_from = 'text'").select("row_id", "q_num", "q_den", F.col("q_units")[0].alias("unit")))
    h = h.withColumn("s", F.col("q_num") * F.try_element_at(seconds, F.col("unit")))
    return h.filter("s % (q_den * 3600) = 0").select("row_id", F.expr("s div (q_den * 3600)").alias("hours")).distinct()


def p2_unit_changes(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one unit in each study's history of durations."""
    return units.unit_changes(_histories(_levelled(spark, d)), "accession", ["ingested_at", "row_id"])


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = F.col("counts_path")
    refs = read(spark, d, "osdr_samples").filter(~is_missing(path)).select(
        "row_id", F.regexp_extract(path, r"([^/\\]*)$", 1).alias("file"), squeeze(col("id.sample name")).alias("sample"), "ingested_at"
    )
    return refs, read(spark, d, "counts_columns")


def p3_statuses(spark: SparkSession, d: str) -> DataFrame:
    """ref_field, row_id, period, status of every orphan reference."""
    refs, cols = _references(spark, d)
    out = None
    for field, ref_key, parent_key in (
        ("counts_path", ["file"], ["file_name"]),
        ("id.sample name", ["file", "sample"], ["file_name", "sample_name"]),
    ):
        marks = orp.parent_marks(cols, [F.col(c) for c in parent_key], F.col("loaded_at"), F.col("deleted_at"))
        part = orp.orphans(refs, "row_id", [F.col(c) for c in ref_key], F.col("ingested_at"), marks)
        part = part.select(F.lit(field).alias("ref_field"), F.col("ref_id").alias("row_id"), F.date_format("at", "yyyy-MM").alias("period"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_statuses(spark, d).select("ref_field", "row_id", "period").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3_statuses(spark, d).groupBy("ref_field", "period", "status").agg(F.count(F.lit(1)).alias("n_refs"))


#: delimiters of each packed field
PUBMED = dict(delimiters=";,|/ \t\n\r", glue="", bind=r"(?i)\bPM(?:ID|C):?$|:$")
TRAITS = dict(delimiters=";,|\t\n\r", glue=":=")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    geo, meta = read(spark, d, "geo_records"), read(spark, d, "archs4_metadata")
    out = None
    for field, df, key, text, how in (("pubmed_ids_ncbi", geo, "gse", "pubmed_ids_ncbi", PUBMED), ("characteristics", meta, "global_index", "characteristics", TRAITS)):
        part = seg.split_field(df, key, text, **how).withColumn("field", F.lit(field)).select("field", "rec_key", "pos", "item")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_unit_changes, p3_found, p3_report, p4_found)}

_LIVE = "c.loaded_at <= s.ingested_at and (c.deleted_at is null or c.deleted_at > s.ingested_at)"
_REFS = """with s as (
  select row_id, regexp_extract(counts_path, '([^/\\\\]*)$', 1) as file, trim("id.sample name", e' \\t\\n\\r') as sample, ingested_at
  from osdr_samples where counts_path is not null and lower(trim(counts_path, e' \\t\\n\\r')) not in ('', 'na', 'n/a', 'nan', 'none')),
o as (
  select 'counts_path' as ref_field, row_id, ingested_at, file, null as sample from s
  where not exists (select 1 from counts_columns c where c.file_name = s.file and {live})
  union all
  select 'id.sample name', row_id, ingested_at, file, sample from s
  where not exists (select 1 from counts_columns c where c.file_name = s.file and c.sample_name = s.sample and {live}))
""".format(live=_LIVE)
SQL = {
    "p3_found": _REFS + "select distinct ref_field, row_id, strftime(ingested_at, '%Y-%m') as period from o",
    "p3_report": _REFS + """select ref_field, period, status, count(*) as n_refs from (
  select ref_field, strftime(ingested_at, '%Y-%m') as period, case
    when exists (select 1 from counts_columns c where c.file_name = o.file and (o.ref_field = 'counts_path' or c.sample_name = o.sample)
      and c.loaded_at <= o.ingested_at and (c.deleted_at is null or c.deleted_at > c.loaded_at)) then 'deleted'
    when exists (select 1 from counts_columns c where c.file_name = o.file and (o.ref_field = 'counts_path' or c.sample_name = o.sample)
      and c.loaded_at > o.ingested_at and (c.deleted_at is null or c.deleted_at > c.loaded_at)) then 'late'
    else 'missing' end as status from o) group by all""",
    # Items are runs of quoted stretches and of characters that do not separate; quotes go, doubled ones become one.
    "p4_found": r"""
with c as (select distinct 'characteristics' as field, global_index::varchar as rec_key, characteristics as t, '(?:"(?:[^"]|"")*"|[^;,|\t\n\r"])+' as how from archs4_metadata
  union all select distinct 'pubmed_ids_ncbi', gse, regexp_replace(trim(pubmed_ids_ncbi, e' \t\n\r'), '^\[(.*)\]$', '\1', 's'), '(?:"(?:[^"]|"")*"|[^;,|/\s"])+' from geo_records),
p as (select field, rec_key, list_filter(list_transform(regexp_extract_all(t, how), lambda x: trim(x, e' \t\n\r')), lambda x: x <> '') as items from c
  where t is not null and lower(trim(t, e' \t\n\r')) not in ('', 'na', 'n/a', 'nan', 'none'))
select distinct field, rec_key, pos::int as pos, replace(regexp_replace(items[pos], '"((?:[^"]|"")*)"', '\1', 'g'), '""', '"') as item from (select field, rec_key, items, unnest(range(1, len(items) + 1)) as pos from p)
""",
}
