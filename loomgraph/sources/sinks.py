"""Writers: sorted triples by relation, flat files, rankings, Markdown of small results, and what made a result."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import os
import subprocess
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where it may be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "loomgraph-checkpoints")
    return path.rstrip("/")


def write_triples(df: DataFrame, path: str) -> None:
    """Parquet by relation, sorted within each, so a relation filter prunes folders."""
    df.repartitionByRange("interaction", "head", "tail").sortWithinPartitions("interaction", "head", "tail").write.partitionBy("interaction").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).csv(path)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A Markdown table of an aggregate of at most ``limit`` rows; a larger one is refused, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write them with Spark")
    line = lambda v: "| " + " | ".join(map(str, v)) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def write_labels(df: DataFrame, path: str) -> None:
    """(entity, label, type) as a tab-separated file with a header; tabs in labels are spaces, null is empty."""
    label = F.regexp_replace(F.coalesce("label", F.lit("")), "\t", " ").alias("label")
    df.select("entity", label, "type").write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_rankings(ranked: DataFrame, path: str, top: int | None = None) -> None:
    """A JSON line a head: {head, ranking: [{tail, rank, ...}]} in order of rank, all of it or its first ``top`` places."""
    rest = [c for c in ranked.columns if c not in ("head", "rank")]
    first = (ranked if top is None else ranked.where(F.col("rank") <= top)).groupBy("head").agg(F.sort_array(F.collect_list(F.struct("rank", *rest))).alias("ranking"))
    first.write.json(path)


def provenance(path: str, params: dict, inputs: dict[str, str], checks: list[tuple[str, bool, str]], packages: tuple[str, ...] = ("pyspark", "pyarrow", "numpy", "pandas")) -> dict:
    """A JSON file of what made a result: commit, packages, parameters, SHA-256 of local input files, checks. It appears whole or not at all."""

    def git(*args: str) -> str | None:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, check=True).stdout.strip()
        except (OSError, subprocess.CalledProcessError):
            return None

    def digest(name: str) -> str:
        with open(name, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()

    dirty = git("status", "--porcelain", "--untracked-files=no")
    versions = {}
    for p in packages:
        try:
            versions[p] = importlib.metadata.version(p)
        except importlib.metadata.PackageNotFoundError:
            versions[p] = None
    made = {
        "commit": git("rev-parse", "HEAD") or "unknown", "changed": None if dirty is None else bool(dirty), "packages": versions, "params": params,
        "sha256": {k: digest(v) for k, v in inputs.items()}, "checks": [{"item": i, "ok": bool(ok), "detail": d} for i, ok, d in checks], "ok": all(ok for _, ok, _ in checks),
    }
    with open(path + ".part", "w", encoding="utf-8") as out:
        json.dump(made, out, indent=1, default=str)
    os.replace(path + ".part", path)
    return made
