"""Command line: python -m strandloom COMMAND ...

query NAME FOLDER [OUT]          run a registered query over a folder of tables
search FOLDER ID [K]             nearest vectors of one stored vector
index FOLDER OUT                 unit vectors of all samples with their places
project FOLDER OUT [DIMS]        principal coordinates of all vectors
validate FOLDER                  gates over the tables; exit code 1 if one fails
artifacts MANIFEST ROOT          presence, size and digest of files; exit code 1 if one fails
"""
from __future__ import annotations

import json
import sys

from pyspark.sql import functions as F

from strandloom.plans import catalog, gates
from strandloom.session import get_spark


def _show(df, out: list[str]) -> int:
    if out:
        df.write.mode("overwrite").parquet(out[0])
    else:
        df.show(50, truncate=False)
    return 0


def _query(name: str, folder: str, *out: str) -> int:
    known = catalog.queries()
    if name not in known:
        print("\n".join(sorted(known)))
        return 2
    return _show(known[name](get_spark(), folder), list(out))


def _search(folder: str, ident: str, k: str = "5") -> int:
    from strandloom.plans.retrieval import one

    e = get_spark().read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    dim = e.agg(F.max(F.size("embedding"))).first()[0]
    return _show(one(e, int(ident), e, int(k), dim).orderBy("rank"), [])


def _index(folder: str, out: str) -> int:
    from strandloom.functions import vec

    spark = get_spark()
    e = spark.read.parquet(f"{folder}/sample_embeddings.parquet").filter("embedding is not null").select("global_index", vec.normalized(F.col("embedding")).cast("array<float>").alias("embedding"))
    e.join(spark.read.parquet(f"{folder}/sample_locations.parquet"), "global_index").write.mode("overwrite").parquet(out)
    return 0


def _project(folder: str, out: str, dims: str = "2") -> int:
    from strandloom.operators import pca
    from strandloom.sources import sinks

    e = get_spark().read.parquet(f"{folder}/embeddings.parquet")
    dim = e.agg(F.max(F.size("embedding"))).first()[0]
    mean, comp, _ = pca.fit(*pca.moments(e, "embedding", dim))
    sinks.write_coords(pca.transform(e, ["vec_id"], "embedding", mean, comp[: int(dims)]).withColumnRenamed("vec_id", "point"), out, "pca", int(dims))
    return 0


def _report(rows: list[tuple]) -> int:
    for name, value, threshold, status in rows:
        print(f"{status:8} {name}: {value} (threshold {threshold})")
    return gates.exit_code(rows)


def _validate(folder: str) -> int:
    spark = get_spark()
    e = spark.read.parquet(f"{folder}/sample_embeddings.parquet")
    loc = spark.read.parquet(f"{folder}/sample_locations.parquet")
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return _report([gates.same_rows(loc, e), *gates.vectors(e.filter("embedding is not null"), "embedding", dim), *gates.contiguous(loc, "shard_idx", "global_index")])


def _artifacts(manifest: str, root: str) -> int:
    with open(manifest) as f:
        wanted = json.load(f)
    return _report(gates.artifacts({k: tuple(v) if v else None for k, v in wanted.items()}, root))


COMMANDS = {"query": (_query, 2, 3), "search": (_search, 2, 3), "index": (_index, 2, 2), "project": (_project, 2, 3), "validate": (_validate, 1, 1), "artifacts": (_artifacts, 2, 2)}


def main(args: list[str]) -> int:
    name, *rest = args or [""]
    command, least, most = COMMANDS.get(name, (None, 0, 0))
    if command is None or not least <= len(rest) <= most:
        print(__doc__)
        return 2
    return command(*rest)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
