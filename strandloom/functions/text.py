"""Text functions as Column expressions; nulls give nulls unless said otherwise."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_version(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def harmonize(c: Column) -> Column:
    """Blanks collapsed, {unit} unwrapped, blank tokens Unknown."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), r"\{(.+?)\}", "$1"))
    return F.when(F.lower(t).isin("", "nan", "none", "na", "n/a"), "Unknown").otherwise(t)


def extract_gse(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, r"(?i)(GSE\d+)", 1))


def first_of_list(c: Column, sep: str = ",") -> Column:
    """First entry of a list in text; null and placeholders give ''."""
    t = F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), sep), 1))
    return F.when(F.lower(t).isin("null", "nan", "none"), "").otherwise(t)


def keyed_value(c: Column, key: str) -> Column:
    """The value after ``key:`` where it opens the text or directly follows a comma, semicolon or pipe; '' if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i)(?:^|[,;|]){key}:([^,;|]*)", 1))


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs], F.lit(""))


def last_line(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x) != ""), F.lit(-1)), F.lit(""))


def sanitize_ascii(c: Column) -> Column:
    """Printable ASCII only, runs of blanks and of empty lines squeezed."""
    t = F.regexp_replace(c, r"[^\x20-\x7E\n]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r"\n{3,}", "\n\n"))


def truncate(c: Column, n: int = 800) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def gse_folder(c: Column) -> Column:
    """The folder of a series: its last three digits replaced by nnn."""
    up = F.when(F.upper(c).startswith("GSE"), F.upper(c)).otherwise(F.concat(F.lit("GSE"), c))
    return F.concat(F.lit("geo/series/"), F.when(F.length(up) > 6, F.regexp_replace(up, r"\d{3}$", "nnn")).otherwise("GSEnnn"), F.lit("/"), up)


def soft_values(c: Column, tag: str) -> Column:
    """Values of all lines ``tag = value`` of a text, in order, joined by a blank."""
    lines = F.filter(F.split(c, "\n"), lambda x: x.startswith(tag))
    return F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^[^=]*=", ""))), " ")
