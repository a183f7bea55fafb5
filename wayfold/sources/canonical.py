"""Reading and writing canonical tables, inventories of files, and exactly-once work lists."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import TableSpec, assert_schema, violations


def relative_path(path: str) -> str:
    """path if it is relative, normal and stays under its root; else an error."""
    if not path or posixpath.isabs(path) or posixpath.normpath(path) != path or path.startswith(".."):
        raise ValueError(f"not a plain relative path: {path!r}")
    return path


def scan(spark: SparkSession, root: str, paths: Sequence[str], spec: TableSpec) -> DataFrame:
    """Lazy scan of one or more Parquet parts of a table; the stored schema must be the table's."""
    if not paths or len(set(paths)) != len(paths):
        raise ValueError("paths must be given once each")
    full = [f"{root}/{relative_path(p)}" for p in paths]
    for p in full:
        assert_schema(spark.read.parquet(p), spec)
    return spark.read.schema(spec.schema).parquet(*full)


def order_problems(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """Rows of a table's files that come before the row above them in canonical order, file by file."""
    df = spark.read.schema(spec.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    w = Window.partitionBy("file").orderBy("place")
    key = F.struct(*spec.order)
    return df.withColumn("before", F.lag(key).over(w)).where(F.col("before").isNotNull() & (F.col("before") > key)).select("file", "place")


def write_parts(df: DataFrame, path: str, spec: TableSpec, max_rows: int = 100_000) -> None:
    """Range-partitioned, sorted, immutable parts of at most max_rows rows; written whole or not at all."""
    if not violations(df, spec).isEmpty():
        raise ValueError(f"{spec.name} breaks its rules")
    ordered = df.select(*spec.schema.fieldNames()).repartitionByRange(*spec.order).sortWithinPartitions(*spec.order)
    ordered.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", max_rows).parquet(path)


def write_jsonl(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One JSON object a line, in order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def inventory(spark: SparkSession, root: str, max_files: int, max_bytes: int, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of the files under root, whose number and size may not pass the limits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    n, size = files.select("length").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > max_files or size > max_bytes:
        raise ValueError(f"{n} files of {size} bytes are over the limits")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def inventory_problems(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Files that are missing, new or changed against a saved inventory."""
    a, b = (df.select("path", F.struct("size", "sha256").alias(n)) for df, n in ((saved, "saved"), (current, "current")))
    j = a.join(b, "path", "full_outer").where(~F.col("saved").eqNullSafe(F.col("current")))
    return j.select("path", F.when(F.col("saved").isNull(), "new").when(F.col("current").isNull(), "missing").otherwise("changed").alias("problem"))


def file_pairs(listing: DataFrame, pattern: str = r"([^/]+)/(?:scenario|log_map_archive)_[^/]+$") -> DataFrame:
    """listing (path): scenario, motion, map of scenarios that have exactly one file of both kinds."""
    kind = F.when(F.col("path").endswith(".parquet"), "motion").when(F.col("path").endswith(".json"), "map")
    f = listing.select(F.regexp_extract("path", pattern, 1).alias("scenario"), kind.alias("kind"), "path").where("scenario <> '' and kind is not null")
    p = f.groupBy("scenario").pivot("kind", ["motion", "map"]).agg(F.min("path").alias("path"), F.count("path").alias("n"))
    return p.where("motion_n = 1 and map_n = 1").select("scenario", F.col("motion_path").alias("motion"), F.col("map_path").alias("map"))


def parse_listing(lines: DataFrame, root: str) -> DataFrame:
    """key and size of a store's listing: JSON records ({"key", "size"}) or lines of "date time size key"; keys under root."""
    j = F.from_json("value", "key string, size long")
    text = F.regexp_extract("value", r"^\S+ \S+\s+(\d+)\s+(\S+)$", 2)
    size = F.nullif(F.regexp_extract("value", r"^\S+ \S+\s+(\d+)\s+(\S+)$", 1), F.lit("")).cast("long")
    is_json = F.col("value").startswith("{")
    out = lines.select(F.when(is_json, j["key"]).otherwise(text).alias("key"), F.when(is_json, j["size"]).otherwise(size).alias("size"))
    return out.where(F.col("key").startswith(root) & F.col("size").isNotNull()).dropDuplicates(["key"])


def remaining(work: DataFrame, done: DataFrame, key: str = "cache_key") -> DataFrame:
    """Units of work whose result isn't there yet."""
    return work.join(done.select(key), key, "left_anti")


def cache_key(operation: str, version: str, *inputs: str):
    """Digest of an operation, its version and its input columns."""
    return F.sha2(F.concat_ws("|", F.lit(operation), F.lit(version), *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in inputs]), 256)


def materialize(spark: SparkSession, work: DataFrame, path: str, worker: Callable[[DataFrame], DataFrame], key: str = "cache_key") -> DataFrame:
    """worker's results of all units, at path; only units without a result are worked on, in one distributed job.

    Results are appended as whole committed files, so a run that breaks off costs its own units only.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    has = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    todo = remaining(work, spark.read.parquet(path), key) if has else work
    worker(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def latest_states(checkpoints: DataFrame) -> DataFrame:
    """Append-only checkpoints (unit, attempt, state): a completed state stays, else the last attempt counts."""
    best = F.max_by(F.struct("attempt", "state"), F.struct((F.col("state") == "completed").cast("int").alias("c"), "attempt"))
    return checkpoints.groupBy("unit").agg(best.alias("b")).select("unit", "b.attempt", "b.state")


def guarded(df: DataFrame, max_rows: int) -> DataFrame:
    """df, if it has at most max_rows rows."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return df
