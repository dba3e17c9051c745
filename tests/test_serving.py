"""Driver-side helpers."""
from strandloom.plans import serving
from strandloom.sources import sinks


def test_viewport_events():
    ranges = {"xaxis.range[0]": 3, "xaxis.range[1]": 1, "yaxis.range[0]": -1, "yaxis.range[1]": 2}
    assert serving.viewport_of(ranges, None) == (1.0, 3.0, -1.0, 2.0)
    assert serving.viewport_of({"xaxis.autorange": True}, (0, 1, 0, 1)) is None
    assert serving.viewport_of({"dragmode": "pan"}, (0, 1, 0, 1)) == (0, 1, 0, 1)
    assert serving.viewport_of(None, None) is None


def test_budgets():
    assert serving.budgets(50_000, 2) == [("40,000", 40_000), ("All", 50_000)]
    assert serving.budgets(10, 3) == [("All", 10)]


def test_methods_and_coords(spark, tmp_path):
    folder = str(tmp_path / "coords")
    assert serving.default_method(folder) is None
    assert serving.read_coords(spark, folder, "umap", 3).columns == ["point", "x", "y", "z"]
    sinks.write_coords(spark.createDataFrame([(1, 0.5, 1.5)], "point long, x double, y double"), folder, "pca", 2)
    assert serving.default_method(folder) == "pca" and serving.available(folder, "pca", 2) and not serving.available(folder, "pca", 3)
    assert tuple(serving.read_coords(spark, folder, "pca", 2).first()) == (1, 0.5, 1.5)


def test_records(tmp_path):
    p = tmp_path / "s.json"
    assert serving.build_record(p) == {}
    p.write_text("[1]")
    assert serving.build_record(p) == {}
    p.write_text('{"umap_neighbors": 30, "pca_n": 942563, "total": 1}')
    assert serving.parameters(serving.build_record(p), "umap") == [("neighbors", "30")] and serving.parameters(serving.build_record(p), "pca") == [("n", "942,563")]


def test_paths(tmp_path):
    (tmp_path / "raw").mkdir()
    f = tmp_path / "raw" / "c.csv"
    f.write_text("x")
    assert serving.first_existing("data/osdr/raw/c.csv", [tmp_path]) == f
    assert serving.first_existing("c.csv", [tmp_path]) == f
    assert serving.first_existing("d.csv", [tmp_path]) is None


def test_report(spark):
    df = spark.createDataFrame([(2, "b|c", None), (1, "a", 0.5)], "rank int, gsm string, score double")
    text = serving.report(df, "Hits", valid=False)
    assert "INVALID" in text and text.index("| 1 | a |") < text.index("| 2 | b\\|c |")
    assert serving.present(df, ["score", "nope", "rank"]).columns == ["score", "rank"]
    assert serving.human_bytes(2048) == "2.0 KB" and serving.clock(3725) == "01:02:05"
