"""Hand values of the expressions."""
import pytest
from pyspark.sql import functions as F

from strandloom.functions import cases, jsonx, rules, text, vec

TISSUES = {
    "Liver": "Liver", "Left Lobe of the Liver": "Liver", "Right extensor digitorum longus": "Skeletal muscle", "Left gastrocnemius": "Skeletal muscle", "dorsal skin": "Skin", "Right hippocampus": "Brain / CNS",
    "right hemisphere of cerebellum": "Brain / CNS", "Right retina": "Eye", "Temporal Bone": "Bone / cartilage", "white adipose tissue": "Adipose", "descending colon": "Intestine", "Spleen-distal": "Spleen",
    "whole blood": "Blood / immune", "PBMC": "Blood / immune", "bone marrow": "Bone marrow", "HeLa": "Cell line", "293S cells": "Cell line", "GM12878": "Blood / immune", "zygote": "Embryo / stem cell", "iPS": "Embryo / stem cell",
    "Universal Human Reference RNA (UHRR) from Stratagene": "Reference RNA", "femur bone": "Bone / cartilage", "adrenal gland": "Adrenal gland", "renal cortex": "Kidney", "smooth muscle cell": "Vasculature",
    "skeletal muscle": "Skeletal muscle", "cardiac muscle": "Heart", "Osteosarcoma": "Tumor / cancer", "neuroblastoma": "Tumor / cancer", "hepatocarcinoma": "Liver", "fetal liver": "Liver", "": "Unknown", "   ": "Unknown",
    "NA": "Unknown", "n/a": "Unknown", "none": "Unknown", "unknown": "Unknown", "NULL": "Unknown", "qwertyuiop widget 42": "Other", "LIVER": "Liver", "  Liver  ": "Liver", "Liver\t": "Liver",
}


def test_tissues(spark):
    df = spark.createDataFrame([(k,) for k in TISSUES] + [(None,)], "t string").withColumn("b", rules.canonical(F.col("t")))
    got = {r.t: r.b for r in df.collect()}
    assert got.pop(None) == "Unknown"
    assert got == TISSUES


@pytest.mark.parametrize("fields,bucket", [
    (("cells", "liver"), "Liver"), (("qwertyuiop", "spleen"), "Spleen"), (("qwertyuiop widget", "HeLa"), "Cell line"), (("HeLa", "qwertyuiop widget"), "Cell line"), (("", "NULL", "n/a"), "Unknown"),
])
def test_coalesced(spark, fields, bucket):
    df = spark.createDataFrame([fields], ", ".join(f"c{i} string" for i in range(len(fields))))
    assert df.select(rules.coalesced(*[F.col(c) for c in df.columns]).alias("b")).first().b == bucket


def test_flight(spark):
    want = {"Space Flight": "Space Flight", "spaceflight": "Space Flight", "Ground Control": "Ground", "Ground Control Rerun": "Ground", "Basal Control": "Ground", "Vivarium Control": "Ground", "Cohort Control #1": "Ground", "": "Unknown", "nan": "Unknown"}
    df = spark.createDataFrame([(k,) for k in want], "t string").select("t", cases.flight_status(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == want


def test_tier(spark):
    rows = [(True, None, None, False, "cached"), (False, "flight", "p", True, "subprocess"), (False, "flight", "p", False, "unavailable"), (False, "flight", None, True, "unavailable"), (False, " ", "p", True, "unavailable"), (False, "n/a", "p", True, "unavailable")]
    df = spark.createDataFrame(rows, "v boolean, c string, p string, k boolean, want string")
    assert all(r.want == r.got for r in df.withColumn("got", cases.sample_tier(F.col("v"), F.col("c"), F.col("p"), F.col("k"))).collect())


def test_edge_width(spark):
    df = spark.createDataFrame([(0.9, 1.5), (1.0, 8.0), (0.95, 4.75), (0.5, 1.5), (1.2, 8.0)], "s double, w double")
    assert all(abs(r.w - r.g) < 1e-9 for r in df.withColumn("g", vec.edge_width(F.col("s"))).collect())


def test_text(spark):
    df = spark.createDataFrame([("ENSMUSG01.4", "tissue: liver;Strain:B6|age:3", "GSE123, GSE4", "a\n\n  \nb\n ", "x" * 900, '{"body": "{\\"text\\": \\"hi\\"}"}')], "g string, c string, s string, l string, t string, j string")
    r = df.select(
        text.strip_version(F.col("g")), text.keyed_value(F.col("c"), "strain"), text.keyed_value(F.col("c"), "sex"), text.first_of_list(F.col("s")), text.last_line(F.col("l")), F.length(text.truncate(F.col("t"))),
        jsonx.first_key(F.col("j"), "answer", "text"), text.gse_folder(F.lit("12345")), text.extract_gse(F.lit("see gse77")), text.first_non_empty(F.lit(" "), F.lit("b")),
    ).first()
    assert list(r) == ["ENSMUSG01", "B6", "", "GSE123", "b", 803, "hi", "geo/series/GSE12nnn/GSE12345", "GSE77", "b"]


def test_parse_vector(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ("[]",), ("oops",), (None,), ("[1, null]",)], "j string").select(jsonx.parse_vector(F.col("j")).alias("v"))
    assert [r.v for r in df.collect()] == [[1.0, 2.5], None, None, None, None]
