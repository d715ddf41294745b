"""Rule catalog by year, labelled cases and content-addressed archives."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "case_id string, category string, support_id string, province string, district string, crop string, area_da string, cks_status boolean, expected_status string, expected_amount string, production_year int"


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of a place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The catalog's versions, oldest first."""
    at, fs = _files(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[int, str]:
    """Year to folder of a version, by default the last; empty without any."""
    known = versions(spark, path)
    if not known:
        return {}
    text = spark.read.text(f"{path}/versions/{version or known[-1]:08d}.json", wholetext=True).first()[0]
    return {int(year): folder for year, folder in json.loads(text).items()}


def _claim(spark: SparkSession, path: str, number: int, folders: dict[int, str]) -> bool:
    """Write a version's manifest and give it its number by one rename, which fails if the number is taken."""
    jvm, own = spark._jvm, f"{path}/versions/{uuid.uuid4().hex}.tmp"
    at, fs = _files(spark, own)
    out = fs.create(at)
    out.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(at, jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{number:08d}.json"), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError:
        fs.delete(at, False)
        if number in versions(spark, path):
            return False
        raise
    return True


def save_rules(rules: DataFrame, path: str) -> int:
    """Replace the years that ``rules`` has, and no others, as one new version; returns its number.

    The years go to folders of their own; only when all of them are written does a manifest name them. A write that fails on its way leaves the last version as it was, and whoever reads a version goes on reading it."""
    spark, folder = rules.sparkSession, uuid.uuid4().hex
    rules.withColumn("version", F.lit(folder)).write.mode("append").partitionBy("production_year", "version").parquet(f"{path}/data")
    written = spark.read.parquet(f"{path}/data").where(F.col("version") == folder).select("production_year").distinct()
    own = {r["production_year"]: folder for r in written.collect()}  # a few years
    while True:
        known = versions(spark, path)
        number = known[-1] + 1 if known else 1
        if _claim(spark, path, number, manifest(spark, path) | own):
            return number


def read_rules(spark: SparkSession, path: str, keep: Column | None = None, version: int | None = None) -> DataFrame:
    """Rules of a version, by default the last; a filter on production_year reads only those folders. What is read later is still of this version."""
    folders = manifest(spark, path, version)
    if not folders:
        raise ValueError(f"no rules were published under {path}")
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/production_year={year}/version={folder}" for year, folder in sorted(folders.items())]).drop("version")
    return rows if keep is None else rows.where(keep)


def rule_years(spark: SparkSession, path: str) -> list[int]:
    """The years that the catalog has."""
    return sorted(manifest(spark, path))


def list_rules(spark: SparkSession, path: str, years: list[int] | None = None, program: str | None = None, crop: str | None = None, status: str | None = None) -> DataFrame:
    """Rules of the given years, program, crop and status; years read only their folders."""
    rows = read_rules(spark, path)
    if years is not None:
        rows = rows.where(F.col("production_year").isin(years))
    for name, value in (("program_key", program), ("crop_code", crop), ("review_status", status)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def set_status(spark: SparkSession, path: str, year: int, status: str, ids: list[int] | None = None) -> int:
    """Set the status of a year's rules (or of those listed), as a new version; returns how many there were."""
    rows = read_rules(spark, path, F.col("production_year") == year)
    hit = F.lit(True) if ids is None else F.col("rule_no").isin(ids)
    version = save_rules(rows.withColumn("review_status", F.when(hit, status).otherwise(F.col("review_status"))), path)
    return read_rules(spark, path, F.col("production_year") == year, version).where(hit).count()


def forget_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and the folders that only they, or writes that failed, have left."""
    known = versions(spark, path)
    used = {(year, folder) for v in known[-keep:] for year, folder in manifest(spark, path, v).items()}
    for v in known[:-keep]:
        at, fs = _files(spark, f"{path}/versions/{v:08d}.json")
        fs.delete(at, False)
    at, fs = _files(spark, f"{path}/data")
    for year in [f.getPath() for f in fs.listStatus(at) if "=" in f.getPath().getName()]:
        for folder in [f.getPath() for f in fs.listStatus(year)]:
            if (int(year.getName().split("=")[1]), folder.getName().split("=")[-1]) not in used:
                fs.delete(folder, True)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of JSON lines; decimals come as text and are cast exactly."""
    rows = spark.read.schema(CASES).json(path)
    return rows.withColumn("area_da", F.col("area_da").try_cast("decimal(12,2)")).withColumn("expected_amount", F.col("expected_amount").try_cast("decimal(14,2)"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.option("header", True).csv(path)


def archive(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, n_bytes, intact) of files that are named by their content."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)
    return rows.select(name.alias("sha256"), F.col("length").alias("n_bytes"), (F.sha2("content", 256) == name).alias("intact"))
