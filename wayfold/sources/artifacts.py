"""Artifacts of a run: sizes and references of written tables, sinks of whole tapes and models, manifests, configuration.

All paths are Hadoop paths, so local folders and object stores work alike.  Tables are written by Spark's committer:
whole or not at all.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from .canonical import write_parts


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def tree_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a path; 0 if it isn't there."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def table_reference(spark: SparkSession, name: str, paths: Sequence[str]) -> dict[str, int | str]:
    """Name, rows, bytes and parts of a table written in one or more places."""
    rows = spark.read.parquet(*paths).count() if paths else 0
    return {"schema": name, "row_count": rows, "size_bytes": sum(tree_size(spark, p) for p in paths), "parts": len(paths)}


def run_directory(spark: SparkSession, root: str, run_id: str) -> str:
    """A new folder of a run; one that is there already is an error."""
    if not run_id or "/" in run_id or run_id.startswith("."):
        raise ValueError(f"not a run id: {run_id!r}")
    fs, p = _fs(spark, f"{root}/{run_id}")
    if fs.exists(p):
        raise FileExistsError(f"{root}/{run_id}")
    fs.mkdirs(p)
    return f"{root}/{run_id}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written under another name and renamed, so that no half of it is ever seen."""
    fs, p = _fs(spark, path)
    if fs.exists(p):
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.rename(part, p)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_tables(spark: SparkSession, root: str, run_id: str, tables: Mapping[str, DataFrame], summary: Mapping | None = None) -> dict:
    """Canonical tables of a tape or model, each checked, sorted and immutable, with a manifest of them written last.

    A run without a manifest never ended; `prune` takes it away.
    """
    path = run_directory(spark, root, run_id)
    for name, df in tables.items():
        write_parts(df, f"{path}/{name}.parquet", TABLES[name])
    manifest = {"run_id": run_id, "tables": [table_reference(spark, n, [f"{path}/{n}.parquet"]) for n in sorted(tables)], "summary": dict(summary or {})}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def load_tables(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a run whose manifest agrees with what is there: rows, bytes and schema of each."""
    manifest = json.loads(read_text(spark, f"{root}/{run_id}/manifest.json"))
    out = {}
    for ref in manifest["tables"]:
        path = f"{root}/{run_id}/{ref['schema']}.parquet"
        if table_reference(spark, ref["schema"], [path]) != ref:
            raise ValueError(f"{ref['schema']} isn't what the manifest says")
        out[ref["schema"]] = spark.read.schema(TABLES[ref["schema"]].schema).parquet(path)
    return out


def written_sizes(spark: SparkSession, root: str, label: str, representations: Mapping[str, DataFrame]) -> DataFrame:
    """Representations of one thing written side by side, and the bytes of each over those of "raw": what a byte budget counts."""
    rows = []
    for name, df in representations.items():
        path = f"{root}/{label}/{name}"
        fs, p = _fs(spark, f"{path}/_SUCCESS")
        if not fs.exists(p):  # a finished one is used again
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        rows.append((name, spark.read.parquet(path).count(), tree_size(spark, path)))
    sizes = spark.createDataFrame(rows, "representation string, row_count long, size_bytes long")  # one row a representation
    raw = next((b for n, _, b in rows if n == "raw"), None)
    return sizes.withColumn("byte_ratio", F.col("size_bytes") / F.lit(raw))


def incomplete(spark: SparkSession, root: str) -> list[str]:
    """Runs under root without a manifest."""
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted(n for n in names if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/manifest.json")))


def prune(spark: SparkSession, root: str, dry_run: bool = True) -> list[str]:
    """Runs that never ended; deleted unless it is a dry run."""
    gone = incomplete(spark, root)
    if not dry_run:
        for name in gone:
            fs, p = _fs(spark, f"{root}/{name}")
            fs.delete(p, True)
    return gone


def write_results(tables: Mapping[str, DataFrame], root: str, role: str = "cohort_role") -> None:
    """Result tables of a campaign, partitioned by role, so that reading one role prunes the others."""
    for name, df in tables.items():
        df.write.partitionBy(role).mode("errorifexists").parquet(f"{root}/{name}")


def load_config(text: str, overrides: Mapping[str, object] | None = None, defaults: Mapping[str, object] | None = None) -> dict:
    """A TOML configuration over defaults, under overrides given as dotted keys; keys that the defaults lack are errors."""

    def merge(a: dict, b: Mapping, at: str = "") -> dict:
        out = dict(a)
        for k, v in b.items():
            if defaults is not None and k not in a:
                raise KeyError(f"unknown setting {at}{k}")
            out[k] = merge(out[k], v, f"{at}{k}.") if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
        return out

    config = merge(dict(defaults or {}), tomllib.loads(text))
    for key, value in (overrides or {}).items():
        nested: object = value
        for part in reversed(key.split(".")):
            nested = {part: nested}
        config = merge(config, nested)
    return config


_S3 = "{http://s3.amazonaws.com/doc/2006-03-01/}"


def parse_listing_page(xml: bytes | str, root: str) -> tuple[list[tuple[str, int]], str | None]:
    """(key, size) of the objects under root on one page of a store's XML listing, and the token of the next page."""
    page = ElementTree.fromstring(xml)
    find = lambda e, n: e.find(f"{_S3}{n}") if e.find(f"{_S3}{n}") is not None else e.find(n)
    keys = [(find(c, "Key").text, int(find(c, "Size").text)) for c in [*page.iter(f"{_S3}Contents"), *page.iter("Contents")]]
    if any(not k.startswith(root) for k, _ in keys):
        raise ValueError("a key lies outside the listed root")
    more = find(page, "IsTruncated")
    token = find(page, "NextContinuationToken")
    if more is not None and more.text == "true" and token is None:
        raise ValueError("a cut listing has no token")
    return keys, token.text if token is not None and more is not None and more.text == "true" else None


def listing(spark: SparkSession, pages: DataFrame, root: str) -> DataFrame:
    """key, size of all pages (page, xml) of a listing, in parallel; a key on two pages comes once."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [x for xml in batch.column(0).to_pylist() for x in parse_listing_page(xml, root)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.int64())], ["key", "size"])

    return pages.select("xml").mapInArrow(run, "key string, size long").dropDuplicates(["key"])


def plotted_values(aggregates: DataFrame, fields: Sequence[str], where: str | None = None) -> DataFrame:
    """The columns of an aggregate table that a figure shows; the projection and the filter reach the scan."""
    return (aggregates.where(where) if where else aggregates).select(*fields)
