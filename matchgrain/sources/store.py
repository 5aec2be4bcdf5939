"""The neutral store: Parquet tables partitioned by competition, published by a manifest that is written last.

A reader trusts only what the manifest names: it checks that everything it will need is there before it opens anything, reads
the columns it asks for, and holds row counts (or contents) against the manifest.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "open-events"


class StoreError(ValueError):
    """What is asked for is not there, or is not what the manifest says."""


def workspace(spark: SparkSession) -> str:
    """A new place in the cluster's checkpoint folder, which all executors see; where none is set, as in tests on one machine,
    in a folder of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise StoreError("spark.checkpoint.dir is unset: executors would not see each other's files")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/store-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in that folder, so that a lost executor loses nothing."""
    workspace(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def content(df: DataFrame) -> DataFrame:
    """One row, ``rows`` and ``hash``: a fingerprint of the contents that no order of rows changes."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.concat_ws(":", F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 40))), F.lit(0))).alias("hash"))


#: Rows of a file at most, and bytes of a row's partition that make one more salt.
CHUNK_ROWS = 1_000_000
MUST_NOT_BE_NULL = "must not be null"


def _files(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()


def remove(spark: SparkSession, path: str) -> None:
    make, conf = _files(spark)
    make(path).getFileSystem(conf).delete(make(path), True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    make, conf = _files(spark)
    fs = make(old).getFileSystem(conf)
    fs.mkdirs(make(new).getParent())
    if not fs.rename(make(old), make(new)):
        raise StoreError(f"{old} could not be moved to {new}")


def enforced(df: DataFrame, name: str, schema: Sequence[str]) -> DataFrame:
    """``df`` under a schema of entries "column" or "column type": columns are there, have that type, and a null fails the write."""
    kinds = dict(df.dtypes)
    for entry in schema:
        column, _, kind = entry.partition(" ")
        if column not in kinds:
            raise StoreError(f"{name} has no column {column}")
        if kind and kinds[column] != kind:
            raise StoreError(f"{name} has {column} as {kinds[column]} and not as {kind}")
        df = df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{name}.{column} {MUST_NOT_BE_NULL}")).cast(kinds[column])).otherwise(F.col(column)))
    return df


def salted(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` and a salt of the row, so that a large partition is written by as many tasks as any other."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, F.col(key), F.pmod(F.xxhash64(*df.columns), F.lit(n)))


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], schemas: Mapping[str, Sequence[str]] | None = None, unique: Mapping[str, str] | None = None, replace: bool = False) -> None:
    """Write ``tables`` (each with a column ``competition``) in two steps: beside the store, then by one move; the manifest last.

    ``schemas`` names columns (and types) that must be there and hold no nulls, checked in the write itself; ``unique`` names
    a table's key. Tables are written to a staging folder in chunks and checked there; only then does what was published
    before lose its manifest and give way, the staging folder takes its name, and the new manifest is written. A publication
    that fails a check leaves the store as it was; one that is cut off in the move leaves no manifest, and without a manifest
    there is no store.
    """
    if exists(spark, f"{root}/manifest") and not replace:
        raise StoreError(f"{root} is published already")
    staging = f"{root}.staging-{uuid.uuid4().hex}"
    parts = []
    try:
        for name, df in tables.items():
            held = enforced(df, name, (schemas or {}).get(name, ()))
            try:
                salted(held, "competition").write.partitionBy("competition").option("maxRecordsPerFile", CHUNK_ROWS).parquet(f"{staging}/{name}")
            except Exception as e:
                if MUST_NOT_BE_NULL in str(e):
                    raise StoreError(f"{name} has nulls where none may be") from e
                raise
            back = spark.read.parquet(f"{staging}/{name}")
            if name in (unique or {}) and not back.groupBy("competition", unique[name]).count().where("count > 1").limit(1).isEmpty():
                raise StoreError(f"{unique[name]} is not unique in {name}")
            row = F.xxhash64(*[F.col(c) for c in sorted(set(back.columns) - {"competition"})])
            parts += [
                {"table": name, "competition": r["competition"], "rows": r["rows"], "hash": f"{r['x']}:{r['s']}"}
                for r in back.groupBy(F.col("competition").cast("string").alias("competition")).agg(F.count("*").alias("rows"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 40))).alias("s")).collect()  # one row a competition
            ]
        if exists(spark, root):  # what an earlier publication left: its manifest goes first
            remove(spark, f"{root}/manifest")
            remove(spark, root)
        rename(spark, staging, root)
    finally:
        remove(spark, staging)
    spark.createDataFrame([(json.dumps(p),) for p in parts], "value string").coalesce(1).write.text(f"{root}/manifest")


def key_differences(ours: DataFrame, theirs: DataFrame, key: str, group: str) -> DataFrame:
    """``group, side, n, least``: keys that only one of two tables has, or has more often, by group; no row where they agree."""
    count = lambda df, c: df.groupBy(group, key).agg(F.count("*").alias(c))
    met = count(ours, "a").join(count(theirs, "b"), [group, key], "full").fillna(0, ["a", "b"]).where("a <> b")
    side = F.when(F.col("a") > F.col("b"), "only ours").otherwise("only theirs")
    return met.groupBy(group, side.alias("side")).agg(F.count("*").alias("n"), F.min(key).alias("least"))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/manifest"):
        raise StoreError(f"{root} was never published")
    return spark.read.schema("table string, competition string, rows long, hash string").json(f"{root}/manifest")


def competitions(spark: SparkSession, root: str, tables: Sequence[str]) -> list[str]:
    """Competitions for which every one of ``tables`` is there."""
    found = manifest(spark, root).where(F.col("table").isin(*tables)).groupBy("competition").agg(F.count_distinct("table").alias("n")).where(F.col("n") == len(tables))
    return sorted(r["competition"] for r in found.collect())


def load(spark: SparkSession, root: str, table: str, competition: str, columns: Sequence[str] | None = None, verify: bool = False) -> DataFrame:
    """One competition's table with the columns asked for; refused unless it is published, whole and from one provider."""
    entry = manifest(spark, root).where((F.col("table") == table) & (F.col("competition") == competition)).first()
    if entry is None:
        raise StoreError(f"no {table} of {competition}")
    df = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}/competition={competition}")
    missing = [c for c in columns or () if c not in df.columns]
    if missing:
        raise StoreError(f"{table} has no columns {missing}")
    if df.count() != entry["rows"]:
        raise StoreError(f"{table} of {competition} has not the rows that were published")
    if "provider" in df.columns and [r["provider"] for r in df.select("provider").distinct().limit(2).collect()] != [PROVIDER]:
        raise StoreError(f"{table} of {competition} is not from {PROVIDER}")
    if verify and content(df.drop("competition")).first()["hash"] != entry["hash"]:
        raise StoreError(f"{table} of {competition} has other contents than were published")
    return df.select(*columns) if columns else df


def canonical(actions: DataFrame) -> DataFrame:
    return actions.orderBy("game_id", F.when(F.col("period") == "1H", 1).otherwise(2), "seconds", "event_id")


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once and read from then on."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bundle(df: DataFrame, path: str, version: str) -> None:
    df.withColumn("bundle_version", F.lit(version)).write.json(path)


def read_bundle(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """The bundle's rows, refused where they were made for another version."""
    df = spark.read.schema(f"{schema}, bundle_version string").json(path)
    if not df.where(~F.col("bundle_version").eqNullSafe(version)).isEmpty():
        raise StoreError(f"the bundle is not of version {version}")
    return df.drop("bundle_version")


def attach(actions: DataFrame, side: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``actions`` with columns of a side table that has exactly one row for each of them: checked, then joined."""
    for what, df in (("actions", actions), ("side table", side)):
        if not df.groupBy(key).count().where(F.col("count") > 1).limit(1).isEmpty():
            raise StoreError(f"{key} is not unique in the {what}")
    if not actions.join(side, key, "left_anti").limit(1).isEmpty():
        raise StoreError("some actions have no row in the side table")
    return actions.join(side.select(key, *columns), key, "left")
