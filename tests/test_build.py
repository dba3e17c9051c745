"""Readers, sinks, chains, gates, attention, layouts and the command line."""
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom import __main__ as command
from strandloom.operators import encoder, layout
from strandloom.operators.positions import group_positions
from strandloom.plans import gates, parity, serving
from strandloom.sources import connectors, readers, sinks


def test_reference_lists_keep_their_lines(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("Gene stable ID\tGene name\tHuman gene name\tHuman homology type\nE1.2\ta\tA\tortholog_one2one\nE2\tb\tB\tortholog_one2many\n\nE1\ta\tA2\tortholog_one2one\n")
    assert sorted(map(tuple, readers.orthologs(spark, str(tmp_path / "o.tsv")).collect())) == [("E1", "A", 1), ("E1", "A2", 4)]
    (tmp_path / "x.csv").write_text('gene_symbol,exon_length\nA,0\nA,120\nA,7\n"B,x",9\nC,bad\n')
    assert sorted(map(tuple, readers.exon_lengths(spark, str(tmp_path / "x.csv")).collect())) == [("A", 120.0), ("B,x", 9.0)]
    (tmp_path / "g.csv").write_text("gene_symbol\nB\n A \nB\n\n")
    assert sorted(map(tuple, readers.gene_list(spark, str(tmp_path / "g.csv")).collect())) == [("A", 2), ("B", 1)]


def test_shard_cap(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "s"))
    assert readers.shards(spark, str(tmp_path / "s")).count() == 40
    two = readers.shards(spark, str(tmp_path / "s"), most=2)
    assert two.select("shard_file").distinct().count() == 2 and readers.shards(spark, str(tmp_path / "s"), most=0).count() == 0


def test_matrices_come_back(spark, tmp_path):
    rows = [(i, [float(i), i / 2]) for i in range(50)]
    df = spark.createDataFrame(rows, "global_index long, embedding array<float>")
    assert sinks.write_npy(df.repartition(3), str(tmp_path / "m.npy"), 2) == 50
    assert np.load(tmp_path / "m.npy").tolist() == [v for _, v in rows]
    for path in (str(tmp_path / "m.npy"), "file://" + str(tmp_path / "m.npy")):
        back = readers.raw_vectors(spark, path, rows=16)
        assert sorted((r.global_index, list(r.embedding)) for r in back.collect()) == rows
    sinks.write_metadata(df, str(tmp_path / "meta"), rows=10)
    assert len(list((tmp_path / "meta").glob("*.parquet"))) >= 5 and spark.read.parquet(str(tmp_path / "meta")).count() == 50
    sinks.write_labels(df.withColumn("tissue", F.lit("x")), str(tmp_path / "labels"), "global_index", ["tissue"])
    assert spark.read.parquet(str(tmp_path / "labels/tissue")).columns == ["global_index", "label"]
    sinks.write_identity(spark.createDataFrame([(0, 1, 2)], "dataset int, src_index int, species_id int"), spark.createDataFrame([(1, "G")], "global_index long, geo_accession string"), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "points_meta")).dtypes == [("dataset", "tinyint"), ("src_index", "int"), ("species_id", "tinyint")]


def test_promotion_and_reuse(tmp_path):
    p = tmp_path / "a.bin"
    (tmp_path / "a.bin.part").write_bytes(b"abc")
    sinks.promote(p, hashlib.sha256(b"abc").hexdigest())
    assert p.read_bytes() == b"abc"
    (tmp_path / "a.bin.part").write_bytes(b"abd")
    with pytest.raises(ValueError):
        sinks.promote(p, "0" * 64)
    assert p.read_bytes() == b"abc" and not (tmp_path / "a.bin.part").exists()
    key = sinks.fingerprint(["a", "b"])
    assert not sinks.reusable(p, key)
    sinks.keep_key(p, key)
    assert sinks.reusable(p, key) and not sinks.reusable(p, sinks.fingerprint(["b", "a"]))


def test_checkpoint_and_template(tmp_path):
    np.savez(tmp_path / "c.npz", **{"module.gene": np.ones(2), "heads": np.array(2)})
    assert sorted(readers.checkpoint(str(tmp_path / "c.npz"))) == ["gene", "heads"]
    assert readers.prompt_template(None, "d") == "d" and readers.prompt_template(tmp_path / "none", "d") == "d"
    (tmp_path / "t").write_text("hello {context}")
    assert readers.prompt_template(tmp_path / "t") == "hello {context}"
    with pytest.raises(RuntimeError):
        readers.hdf5_metadata(["a"], ["x.h5"], {"id": "id"})


def test_chain_backs_off_and_fills(spark):
    waits, calls = [], []

    def search(i):
        calls.append(i)
        if len(calls) < 3:
            raise connectors.TooMany
        return [7]

    soft = "^SERIES = G1\n!Series_summary = one\n!Series_summary = two\n!Series_overall_design = d"
    out = connectors.series_record("G1", search, lambda u: {"title": "t", "summary": "s", "pubmedids": [5, 6]}, lambda p: {"title": f"p{p}"}, lambda i: soft, sleep=waits.append)
    assert out == {"title": "t", "geo_summary": "one two", "geo_design": "d", "pubmed_ids": "5;6", "pubmed_title": "p5", "pubmed_abstract": ""}
    assert waits[:2] == [0.5, 1.0]
    assert connectors.series_record("G2", lambda i: [], None, None, lambda i: "", sleep=waits.append)["title"] == ""
    with pytest.raises(connectors.TooMany):
        connectors.patient(lambda: (_ for _ in ()).throw(connectors.TooMany()), tries=2, sleep=waits.append)
    hits = spark.createDataFrame([("G1",), ("G1",), ("",), (None,)], "gse string")
    rows = connectors.enrich(hits, "gse", lambda i: [1], lambda u: {"title": "t"}, lambda p: {}, lambda i: "", pace=0).collect()
    assert [(r.id, r.title, r.geo_summary) for r in rows] == [("G1", "t", "")]


def test_download_goes_on(tmp_path):
    data, path = bytes(range(200)), str(tmp_path / "f")

    def broken(start):
        yield data[start: start + 50]

    with pytest.raises(OSError):
        connectors.download(broken, path, 200)
    assert connectors.download(lambda s: iter([data[s:]]), path, 200) == 150
    assert (tmp_path / "f").read_bytes() == data and connectors.download(broken, path, 200) == 0


def test_gates(spark):
    assert [r[3] for r in gates.shard_totals({"a": (2, 2), "b": (1, 2)}, 4)] == ["OK", "FAIL", "FAIL"]
    assert [gates.stage("s", *x)[3] for x in ((True, True), (True, False), (False, False))] == ["OK", "FAIL", "SKIP"]
    pinned = hashlib.sha256(b"A\nB").hexdigest()
    assert gates.gene_choice({"x": ["C"], "y": ["A", "B"]}, pinned, 9)[::2] == ("y", "OK")
    assert gates.gene_choice({"x": ["C"], "y": ["B", "A"]}, pinned, 2)[::2] == ("y", "WARN")
    assert gates.gene_choice({"x": ["C"]}, pinned, 5)[::2] == ("x", "WARN")
    assert gates.gene_choice({}, pinned, 2, ["A", "A", "B", "C"]) == ("inferred", ["A", "B"], "WARN")
    assert gates.gene_choice({}, pinned, None)[2] == "FAIL"
    assert gates.attention({"attention": "Flash"})[3] == "OK" and gates.attention({})[3] == "FAIL"
    assert gates.spread(0.04)[3] == "FAIL"
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (2, "a", [2.0, 3.0]), (4, "b", None)], "i long, s string, v array<double>")
    assert [r[3] for r in gates.vectors(df, "v", 2)] == ["FAIL", "OK"] and [r[3] for r in gates.vectors(df.limit(2), "v", 2)] == ["OK", "OK"]
    assert [r[3] for r in gates.contiguous(df, "s", "i")] == ["OK", "OK"]
    assert [r[3] for r in gates.contiguous(df.unionByName(df.limit(1)), "s", "i")] == ["FAIL", "OK"]


@pytest.mark.parametrize("kind", ["relu", "elu+1", "sqr", "abs", "favor+", "favor+_16"])
def test_linear_attention_against_all_pairs(kind):
    rng = np.random.default_rng(0)
    q, k, v = (rng.normal(size=(2, 150, 4)) for _ in range(3))
    got, state = encoder.linear_attention(q, k, v, kind)
    w = np.tril(np.ones((150, 150))) * (encoder.feature_map(q, kind) @ encoder.feature_map(k, kind).transpose(0, 2, 1))
    assert np.allclose(got, (w @ v) / np.maximum(w.sum(2), 1e-12)[:, :, None])
    first, s = encoder.linear_attention(q[:, :70], k[:, :70], v[:, :70], kind)
    rest, s = encoder.linear_attention(q[:, 70:], k[:, 70:], v[:, 70:], kind, s)
    assert np.allclose(np.concatenate([first, rest], 1), got) and np.allclose(s[0], state[0])


def test_features_and_states():
    assert all(map(encoder.valid_feature, ("relu", "elu+1", "favor+", "favor+_32"))) and not any(map(encoder.valid_feature, ("", "tanh", "favor+_x", "relu_2", "favor+_0")))
    with pytest.raises(ValueError):
        encoder.feature_map(np.ones((1, 1, 2)), "tanh")
    assert encoder.batch_state(np.ones((1, 3)), 4).shape == (4, 3)
    with pytest.raises(ValueError):
        encoder.batch_state(np.ones((2, 3)), 4)


def test_placing_among_landmarks(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 8))
    x = np.concatenate([c + rng.normal(0, 0.05, (60, 8)) for c in centre])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    ids = np.arange(0, 240, 3)
    y = np.repeat(np.array([[0, 0], [10, 0], [0, 10], [10, 10]], float), 20, 0)
    got = {r.id: (r.x, r.y) for r in layout.place(df, "id", "v", 8, ids, x[ids], y, 5).collect()}
    assert len(got) == 240 and all(np.allclose(got[i], y[i // 60 * 20], atol=1e-6) for i in range(240))
    assert layout.landmarks(df, "id", 50).count() == 50
    start = layout.init_from_pca(y - y.mean(0))
    assert abs(np.abs(start).max() - 10) < 0.01
    with pytest.raises(ValueError):
        layout.init_from_pca(np.zeros((3, 2)))


def test_group_positions(spark):
    rows = [(g, i * 7 % 101) for g in ("a", "b", None) for i in range(101)] + [("c", 5)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = {(r.g, r.x): r.position for r in group_positions(df, ["g"], [F.col("x")]).collect()}
    assert got == {(g, x): (1 if g == "c" else x + 1) for g, x in rows}
    assert group_positions(df.limit(0), ["g"], [F.col("x")]).count() == 0


def test_rows_that_do_not_pair(spark):
    with pytest.raises(ValueError):
        parity.zipped(spark.range(3), "id", spark.range(4), "id")
    with pytest.raises(ValueError):
        parity.one_row(spark.range(3), "id", 9)
    assert parity.one_row(spark.range(3), "id", 2).count() == 1


def test_viewport_states():
    now, frame = (0, 1, 0, 1), (5, 6, 5, 6)
    assert serving.next_viewport("method", None, frame, now) is None
    assert serving.next_viewport("retrieval", None, frame, now) == frame and serving.next_viewport("retrieval", None, None, now) == now
    assert serving.next_viewport("colour", None, frame, now) == now


def test_command_line(spark, data, tmp_path, capsys):
    assert command.main([]) == 2 and command.main(["query", "none", data]) == 2
    assert command.main(["query", "category_counts", data, str(tmp_path / "q")]) == 0 and spark.read.parquet(str(tmp_path / "q")).count() > 0
    assert command.main(["search", data, "7", "3"]) == 0
    assert command.main(["project", data, str(tmp_path / "c")]) == 0 and serving.available(str(tmp_path / "c"), "pca", 2)
    assert command.main(["index", data, str(tmp_path / "i")]) == 0
    (tmp_path / "m.json").write_text(json.dumps({"x": None}))
    assert command.main(["artifacts", str(tmp_path / "m.json"), str(tmp_path)]) == 1
    assert command.main(["validate", data]) in (0, 1)
