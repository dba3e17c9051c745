"""Typed readers of the file kinds that embedding corpora come in."""
from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated sample sheet, all columns text."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, escape='"', quote='"')


def counts_matrix(spark: SparkSession, path: str) -> DataFrame:
    """gene, sample, count of a wide counts file whose first column is the gene; versions are cut off, bad counts null."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    gene, *names = wide.columns
    long = wide.unpivot([gene], names, "sample", "count")
    return long.select(F.substring_index(F.col(f"`{gene}`"), ".", 1).alias("gene"), "sample", F.expr("try_cast(count as double)").alias("count"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Sample columns of a counts file, from its first line only."""
    return spark.read.csv(path, header=True, inferSchema=False).columns[1:]


def numbered_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """line, fields (by column name) of a small delimited reference file; the line is its true place in the file.

    Read whole, since a split file knows no line numbers; meant for gene and
    ortholog lists of a few megabytes.
    """
    names = spark.read.csv(path, sep=sep, header=True).columns
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line", "text")).filter("line > 0 and trim(text) <> ''")
    shape = ", ".join(f"`{n}` string" for n in names)
    return lines.select("line", F.from_csv("text", shape, {"sep": sep}).alias("r")).select("line", "r.*")


def orthologs(spark: SparkSession, path: str) -> DataFrame:
    """gene, symbol, line of the one-to-one pairs; line is the place in the file, in which the last of several wins."""
    kept = numbered_lines(spark, path, "\t").filter(F.col("Human homology type") == "ortholog_one2one")
    return kept.select(F.substring_index(F.col("Gene stable ID"), ".", 1).alias("gene"), F.col("Human gene name").alias("symbol"), "line")


def exon_lengths(spark: SparkSession, path: str) -> DataFrame:
    """symbol, length: of a gene's several rows the first one with a positive length counts."""
    from strandloom.operators.expression import first_positive

    t = numbered_lines(spark, path, ",").select(F.col("gene_symbol").alias("symbol"), F.expr("try_cast(exon_length as double)").alias("length"), "line")
    return first_positive(t.filter("symbol is not null"), "symbol", "length", "line")


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """symbol, place: the canonical genes in their order."""
    t = numbered_lines(spark, path, ",").select(F.trim("gene_symbol").alias("symbol"), "line").filter("symbol <> ''")
    return t.groupBy("symbol").agg(F.min("line").alias("place"))


def shards(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """All shards of a folder, or its first ``most`` by name, with the shard's name and the row's place in it."""
    df = spark.read.parquet(folder)
    if most is not None:
        names = sorted(f for f in df.inputFiles())[:most]
        if not names:
            return df.limit(0).withColumn("shard_file", F.lit("")).withColumn("row_in_shard", F.lit(0).cast("long"))
        df = spark.read.parquet(*names)
    return df.select("*", F.col("_metadata.file_name").alias("shard_file"), F.col("_metadata.row_index").alias("row_in_shard"))


def shard_offsets(df: DataFrame) -> DataFrame:
    """shard_file, start: the rows in earlier shards by name; one row a shard."""
    n = df.groupBy("shard_file").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("shard_file").rowsBetween(Window.unboundedPreceding, -1)
    return n.select("shard_file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))


def manifest(path: str | Path) -> dict:
    """A JSON manifest; its count may stand under several names.  Absent, unreadable or not an object: empty."""
    try:
        m = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}
    if not isinstance(m, dict):
        return {}
    count = next((m[k] for k in ("total_samples", "n_samples", "num_samples", "count") if isinstance(m.get(k), int)), None)
    return m | ({"total_samples": count} if count is not None else {})


def soft(spark: SparkSession, path: str) -> DataFrame:
    """series, summary, design of (gzipped) SOFT files; lines of one field joined in their order."""
    from strandloom.functions.text import soft_values

    t = spark.read.text(path, wholetext=True)
    one = lambda tag: soft_values(F.col("value"), tag)
    return t.select(one("^SERIES").alias("series"), one("!Series_summary").alias("summary"), one("!Series_overall_design").alias("design"))


def filesystem(path: str):
    """(file system, path in it) of a local path or a URI; every task opens it by itself, so shared stores work like local ones."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), str(Path(path).absolute()))


def hdf5_metadata(ids: list[str], files: list[str], fields: dict[str, str]) -> list[dict]:
    """One record for each id that any of the files knows, the earlier file first; ``fields`` maps names to data sets.

    Needs h5py, which is looked for only here.
    """
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading HDF5 metadata needs h5py") from e
    left, out = dict.fromkeys(ids), []
    for path in files:
        with h5py.File(path, "r") as f:
            known = f[fields["id"]].asstr()[:]
            at = {k: i for i, k in enumerate(known) if k in left}
            for k, i in at.items():
                out.append({n: (k if n == "id" else f[d].asstr()[i]) for n, d in fields.items()})
                left.pop(k, None)
    return out


def checkpoint(path: str) -> dict[str, np.ndarray]:
    """Arrays of a saved model (.npz, or a torch file where torch is there), without a leading ``module.`` in their names."""
    if path.endswith(".npz"):
        with np.load(path, allow_pickle=False) as f:
            state = {k: f[k] for k in f.files}
    else:
        try:
            import torch
        except ImportError as e:
            raise RuntimeError("this checkpoint needs torch; save it as npz") from e
        saved = torch.load(path, map_location="cpu", weights_only=True)
        state = {k: v.float().numpy() for k, v in saved.get("model", saved).items() if hasattr(v, "numpy")}
    return {k.removeprefix("module."): v for k, v in state.items()}


def prompt_template(path: str | Path | None, default: str = "{context}") -> str:
    """The template in a file, or the default where there is none or it is blank."""
    try:
        text = Path(path).read_text() if path else ""
    except OSError:
        text = ""
    return text if text.strip() else default


class RowRange(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class RawVectors(DataSource):
    """Rows of a raw vector file (memory map or .npy) as global_index, embedding; a partition a range of rows.

    Options: path, dim, dtype (float16), rows (32768 a partition).
    """

    @classmethod
    def name(cls) -> str:
        return "rawvectors"

    def schema(self) -> str:
        return "global_index long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return RawVectorReader(self.options)


class RawVectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rows", 32768))
        self.npy = self.path.endswith(".npy")
        store, name = filesystem(self.path)
        if self.npy:
            with store.open_input_file(name) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                if fortran or len(shape) != 2:
                    raise ValueError(f"{self.path}: rows of a matrix in row order are needed")
                self.dim, self.total, self.dtype, self.skip = shape[1], shape[0], str(kind), f.tell()
        else:
            self.dim, self.dtype, self.skip = int(options["dim"]), options.get("dtype", "float16"), 0
            size = store.get_file_info(name).size
            width = self.dim * np.dtype(self.dtype).itemsize
            if size % width:
                raise ValueError(f"{self.path}: {size} bytes are no whole number of rows of {width}")
            self.total = size // width

    def partitions(self) -> list[RowRange]:
        return [RowRange(a, min(a + self.step, self.total)) for a in range(0, self.total, self.step)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        width = self.dim * np.dtype(self.dtype).itemsize
        for a in range(part.start, part.stop, 4096):
            n = min(4096, part.stop - a)
            store, name = filesystem(self.path)
            with store.open_input_file(name) as f:
                f.seek(self.skip + a * width)
                m = np.frombuffer(f.read(n * width), self.dtype).astype(np.float32)
            offsets = pa.array(np.arange(0, (n + 1) * self.dim, self.dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(offsets, pa.array(m))], names=["global_index", "embedding"])


def raw_vectors(spark: SparkSession, path: str, dim: int | None = None, dtype: str = "float16", rows: int = 32768) -> DataFrame:
    spark.dataSource.register(RawVectors)
    r = spark.read.format("rawvectors").option("path", path).option("dtype", dtype).option("rows", rows)
    return (r.option("dim", dim) if dim else r).load()


def sniff_vectors(df: DataFrame) -> DataFrame:
    """id, embedding of a precomputed query table: an array, a JSON text, or numbered columns; null where nothing fits."""
    from strandloom.functions.jsonx import parse_vector

    ident = next((c for c in ("sample_id", "sample", "id.sample name", "sample_name") if c in df.columns), None)
    if ident is None:
        raise ValueError("no id column")
    for c in ("embedding", "vector", "query_embedding", "emb"):
        if c in df.columns:
            kind = df.schema[c].dataType.typeName()
            v = F.col(c).cast("array<float>") if kind == "array" else parse_vector(F.col(c)).cast("array<float>")
            return df.select(F.col(f"`{ident}`").cast("string").alias("id"), v.alias("embedding"))
    names = sorted((c for c in df.columns if c.startswith("emb_") and c[4:].isdigit()), key=lambda c: int(c[4:]))
    if not names:
        raise ValueError("no vector columns")
    return df.select(F.col(f"`{ident}`").cast("string").alias("id"), F.array(*[F.col(c).cast("float") for c in names]).alias("embedding"))
