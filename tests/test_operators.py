"""Neighbours, PCA, expression, samples, graph, layouts, encoder, sources, sinks, streaming."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import dedupe, encoder, expression, graph, layout, pca, sampling, skew
from strandloom.operators.knn import knn
from strandloom.plans import gates, retrieval
from strandloom.sources import connectors, readers, sinks
from strandloom.streaming import resumable


def _vectors(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids if ids is not None else range(len(m)), m)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_knn_matches_brute_force(spark, metric):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x[7] = x[3]
    df = _vectors(spark, x)
    got = knn(df.filter("vec_id < 20"), "vec_id", "embedding", df, "vec_id", "embedding", 8, 5, metric, True).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(20):
        s = u @ u[q] if metric == "cosine" else x @ x[q] if metric == "dot" else -((x - x[q]) ** 2).sum(1)
        want = [i for i in np.lexsort((np.arange(200), -np.round(s, 12))) if i != q][:5]
        assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == want


def test_knn_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0]), (5, [0.0, 0.0]), (6, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = knn(df, "vec_id", "embedding", df, "vec_id", "embedding", 2, 99).collect()
    assert {(r.qid, r.id) for r in got} == {(a, b) for a in (1, 5, 6) for b in (1, 5, 6)}
    assert knn(df.limit(0), "vec_id", "embedding", df, "vec_id", "embedding", 2, 3).count() == 0
    assert knn(df, "vec_id", "embedding", df.limit(0), "vec_id", "embedding", 2, 3).count() == 0
    with pytest.raises(ValueError):
        knn(df, "vec_id", "embedding", df, "vec_id", "embedding", 2, 3, "hamming")


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    load = np.array([6.0, 4.5, 3.0, 2.2])
    x = rng.normal(size=(500, 4)) * load @ np.linalg.qr(rng.normal(size=(12, 4)))[0].T + rng.normal(0, 0.1, (500, 12))
    n, s, g = pca.moments(_vectors(spark, x), "embedding", 12)
    mean, comp, share = pca.fit(n, s, g)
    _, sv, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert n == 500 and np.allclose(share, sv**2 / (sv**2).sum(), atol=1e-9) and abs(share.sum() - 1) < 1e-12
    assert np.allclose(np.abs((comp[:4] * vt[:4]).sum(1)), 1, atol=1e-9)
    assert (comp[np.arange(12), np.abs(comp).argmax(1)] > 0).all()
    xy = pca.transform(_vectors(spark, x), ["vec_id"], "embedding", mean, comp[:3]).orderBy("vec_id").toPandas()[["x", "y", "z"]].to_numpy()
    assert np.allclose(xy, (x - mean) @ comp[:3].T, atol=1e-9)


def test_expression_rules(spark):
    counts = spark.createDataFrame([("s", "g1", 10.0), ("s", "g2", 5.0), ("s", "g3", 1.0), ("s", "nomap", 9.0), ("t", "g9", 0.0)], "sample string, gene string, count double")
    mapping = spark.createDataFrame([("g1", "OLD", 0), ("g1", "A", 1), ("g2", "A", 2), ("g3", "B", 3), ("g9", "C", 4)], "gene string, symbol string, line int")
    c = expression.collapse(expression.map_symbols(counts, mapping))
    assert {(r.sample, r.symbol): r["count"] for r in c.collect()} == {("s", "A"): 15.0, ("s", "B"): 1.0, ("t", "C"): 0.0}
    a = expression.align(c, spark.createDataFrame([("A",), ("B",), ("Z",)], "symbol string"))
    assert a.count() == 6 and a.filter("symbol = 'C'").isEmpty()
    lengths = expression.first_positive(spark.createDataFrame([("A", 0, 0), ("A", 500, 1), ("A", 900, 2), ("B", 1000, 0)], "symbol string, length int, line int"), "symbol", "length", "line")
    t = {(r.sample, r.symbol): r.tpm for r in expression.tpm(a, lengths).collect()}
    assert t["s", "A"] == pytest.approx(30 / 31 * 1e6) and t["s", "B"] == pytest.approx(1 / 31 * 1e6) and t["s", "Z"] == 0 and t["t", "A"] == 0


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None), (1, 3, "c")], "k int, o int, v string")
    assert {r.k: r.v for r in dedupe.keep_first(df, ["k"], [F.col("o")]).collect()} == {1: "a", 2: None}
    assert {r.k: r.v for r in dedupe.keep_last(df, ["k"], [F.col("o")]).collect()} == {1: "c", 2: None}


def test_samples(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") < 8000, "a").otherwise("b").alias("l")).unionByName(spark.createDataFrame([(10_000, "rare")], "id long, l string"))
    s = {r.l: r.n for r in sampling.stratified(df, "id", "l", 1000, 1).groupBy("l").agg(F.count("*").alias("n")).collect()}
    assert abs(s["a"] - 800) <= 1 and abs(s["b"] - 200) <= 1 and s["rare"] == 1
    assert sampling.stratified(df.filter("id < 50"), "id", "l", 1000, 1).count() == 50
    a = {r.id for r in sampling.uniform(df, "id", 100, 3).collect()}
    assert len(a) == 100 and a == {r.id for r in sampling.uniform(df.repartition(7), "id", 100, 3).collect()}


def test_components(spark):
    rng = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(e + [(None, 3)], "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_skew_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = skew.skew_join(many, one, ["k"], "id", least=100, rows_per_task=500)
    assert out.count() == 3000 and out.filter("v <> 2 * k").isEmpty() and "_salt" not in out.columns


def test_layouts_keep_classes_apart(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.1, (120, 8))
    x[:60, 0] += 1
    x[60:, 1] += 1
    df = _vectors(spark, x)
    e = knn(df, "vec_id", "embedding", df, "vec_id", "embedding", 8, 20, "cosine", True)
    p = layout.affinities(e, 8.0)
    assert p.agg(F.sum("p")).first()[0] == pytest.approx(1.0, abs=1e-6)
    for y in (layout.umap(*_arrays(layout.fuzzy_weights(e), "weight")), layout.tsne(*_arrays(p, "p"), x[:, :2], 100, 150)):
        d = ((y[:, None] - y[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1)[:, :5]
        same = (near < 60) == (np.arange(120) < 60)[:, None]
        assert np.isfinite(y).all() and same.mean() > 0.9


def _arrays(edges, weight):
    ids, i, j, w = layout.edge_arrays(edges, weight)
    return len(ids), i, j, w


def test_encoder(spark):
    w = encoder.seeded_weights(10)
    x = np.random.default_rng(0).normal(size=(6, 10))
    e = encoder.encode(x, w)
    assert np.allclose(encoder.encode(x[2:3], w)[0], e[2]) and not np.allclose(e[0], e[1])
    masked = np.full((1, 10), -10.0)
    assert np.isfinite(encoder.encode(masked, w)).all()
    df = _vectors(spark, x).unionByName(spark.createDataFrame([(99, None)], "vec_id long, embedding array<double>"))
    out = encoder.encode_table(df, "vec_id", "embedding", w, l2=True).collect()
    assert len(out) == 6 and all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in out)


def test_search_modes(spark):
    x = np.eye(4)
    index = _vectors(spark, x)
    q = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")
    pre = spark.createDataFrame([(2, [0.0, 0.0, 1.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.qid, r.rank): (r.id, r["mode"]) for r in retrieval.search(q, index, 1, 4, pre).collect()}
    assert got == {(1, 1): (1, "cached"), (2, 1): (2, "precomputed")}
    with pytest.raises(ValueError):
        retrieval.one(q, 77, index, 3, 4)


def test_readers(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(1000, 6)).astype(np.float16)
    m.tofile(tmp_path / "v.mmap")
    np.save(tmp_path / "v.npy", m)
    for path, dim in (("v.mmap", 6), ("v.npy", None)):
        df = readers.raw_vectors(spark, str(tmp_path / path), dim, rows=300)
        assert df.count() == 1000 and np.array_equal(np.array([r.embedding for r in df.orderBy("global_index").collect()], np.float16), m)
    assert sinks.write_raw(readers.raw_vectors(spark, str(tmp_path / "v.npy")), str(tmp_path / "w.mmap")) == 1000
    assert (tmp_path / "w.mmap").read_bytes() == (tmp_path / "v.mmap").read_bytes()
    (tmp_path / "c.csv").write_text("gene,s1,s2\nENSMUSG1.3,4,x\n")
    assert [tuple(r) for r in readers.counts_matrix(spark, str(tmp_path / "c.csv")).orderBy("sample").collect()] == [("ENSMUSG1", "s1", 4.0), ("ENSMUSG1", "s2", None)]
    assert readers.header(spark, str(tmp_path / "c.csv")) == ["s1", "s2"]
    (tmp_path / "m.json").write_text(json.dumps({"n_samples": 7}))
    assert readers.manifest(tmp_path / "m.json")["total_samples"] == 7 and readers.manifest(tmp_path / "none.json") == {}
    (tmp_path / "s.soft").write_text("^SERIES = GSE1\n!Series_summary = one\n!Series_summary = two\n!Series_overall_design = d = e\n")
    assert tuple(readers.soft(spark, str(tmp_path / "s.soft")).first()) == ("GSE1", "one two", "d = e")
    wide = spark.createDataFrame([("a", 1.0, 2.0)], "sample string, emb_10 double, emb_2 double")
    assert readers.sniff_vectors(wide).first().embedding == [2.0, 1.0]
    spark.range(5).repartition(2).write.parquet(str(tmp_path / "shards"))
    assert readers.shards(spark, str(tmp_path / "shards")).join(readers.shard_offsets(readers.shards(spark, str(tmp_path / "shards"))), "shard_file").select((F.col("start") + F.col("row_in_shard")).alias("g")).distinct().count() == 5


def test_lookup(spark):
    seen = spark.createDataFrame([("a",), ("b",), ("zz",), ("a",), (None,)], "id string")
    out = connectors.lookup(seen, "id", lambda ids: {i: {"series": i.upper()} for i in ids if len(i) == 1}, ["series"], batch=2)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "A"), ("b", "B")]
    with pytest.raises(RuntimeError):
        connectors.check_hit_rate(seen, out.limit(1), 0.9)


def test_resumable(spark, tmp_path):
    src, sink, cp = (str(tmp_path / x) for x in ("src", "sink", "cp"))
    spark.range(0, 10).write.parquet(src)
    run = lambda: resumable.run_available(spark, src, "id long", lambda df: df.withColumn("x", F.col("id") * 2), sink, cp)
    run()
    run()
    assert spark.read.parquet(sink).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    run()
    assert sorted(r.x for r in spark.read.parquet(sink).collect()) == [2 * i for i in range(15)]
    assert resumable.remaining(spark.range(20), spark.read.parquet(sink), "id").count() == 5


def test_records_and_gates(tmp_path, spark):
    p = tmp_path / "r.json"
    shape = {"n": 3}
    sinks.merge_record(p, shape, {"pca": 1})
    assert sinks.merge_record(p, shape, {"umap": 2}) == {"n": 3, "pca": 1, "umap": 2}
    assert sinks.merge_record(p, {"n": 4}, {"umap": 2}) == {"n": 4, "umap": 2}
    p.write_text("{broken")
    assert sinks.merge_record(p, shape, {}) == {"n": 3}
    (tmp_path / "ptr").write_text("version https://git-lfs.github.com/spec/v1\n")
    rows = gates.artifacts({"ptr": None, "r.json": None, "gone": None}, tmp_path)
    assert [r[-1] for r in rows] == ["FAIL", "OK", "FAIL"] and gates.exit_code(rows) == 1
    assert gates.digest(["a", "b "], sinks.fingerprint(["a", "b"]))[-1] == "OK"
    assert gates.quality(0.5, 0.1, 0.001, "umap")[-1] == "OK" and gates.quality(0.1, 0.1, 0.001, "umap")[-1] == "FAIL" and gates.quality(0.1, 0.1, 0.001, "pca")[-1] == "WARN"
    assert gates.mixing(54)[-1] == "WARN" and all(r[-1] == "OK" for r in gates.spectrum([0.4, 0.6], 2))
    sinks.write_coords(spark.createDataFrame([(1, 0.5)], "id int, x double"), str(tmp_path / "c"), "pca", 2)
    assert spark.read.parquet(str(tmp_path / "c")).filter("method = 'pca'").count() == 1


def test_map_ranks_of_all_hits(spark):
    from strandloom.operators.knn import nearer

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 2)), 1)  # with ties
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, xy array<double>")
    want = {(q, i): sum(float(((y - x[q]) ** 2)[0] + ((y - x[q]) ** 2)[1]) < float(((x[i] - x[q]) ** 2)[0] + ((x[i] - x[q]) ** 2)[1]) for y in x) for q in (0, 100, 200) for i in range(q, 300, 7)}
    pairs = spark.createDataFrame([(q, i, x[q].tolist(), x[i].tolist()) for q, i in want], "qid long, id long, q array<double>, v array<double>")
    assert {(r.qid, r.id): r.n for r in nearer(pairs, rows, "id", "xy", 2).collect()} == want
    assert nearer(pairs.limit(0), rows, "id", "xy", 2).count() == 0


def test_map_ranks_cover_every_query(spark, data):
    from strandloom.plans import embedding

    queries = {r.vec_id for r in embedding.asked(spark, data).collect()}
    got = embedding.map_rank(spark, data).collect()
    assert {r.qid for r in got} == queries and len(got) == 10 * len(queries) and max(r.id for r in got) > 20


def test_all_labels_are_permuted(spark, data):
    from strandloom.plans import analytic

    e = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "label").collect()
    got = sorted(analytic.permuted_labels(spark, data).collect())
    assert [(r.vec_id, r.label) for r in got] == sorted((r.vec_id, r.label) for r in e) and [r.place for r in got] == list(range(1, len(e) + 1))
    assert sorted(r.permuted for r in got) == sorted(r.label for r in e) and any(r.permuted != r.label for r in got)


def test_context_holds_whole_summary_and_design(spark, tmp_path):
    from strandloom.plans import relational

    rows = [("GSE1", "t", "s" * 900, "d" * 700), ("GSE2", None, None, None)]
    spark.createDataFrame(rows, "gse string, title string, geo_summary string, geo_design string").write.parquet(f"{tmp_path}/geo_records.parquet")
    got = {r.gse: r.context for r in relational.prompt_context(spark, str(tmp_path)).collect()}
    assert got == {"GSE1": "Series GSE1: t\n" + "s" * 900 + "\n" + "d" * 700, "GSE2": "Series GSE2: -\n-\n-"}
