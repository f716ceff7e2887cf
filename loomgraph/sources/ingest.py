"""One-time ingest of files that Spark can't split: JSON arrays and CSV members of ZIP archives, and downloads, streamed in bounded memory by tasks; ``..._to_lines`` do it on one machine."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import os
import re
import urllib.request
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.runs import kept
from loomgraph.sources.sinks import shared_dir
from loomgraph.sources.tables import RAW_EDGE, RAW_NODE


_AFTER = re.compile(r"\s*[,\]]")


def array_items(stream, chunk: int = 1 << 20) -> Iterator[dict]:
    """The values of one JSON array, of which one value and one chunk are held. Raises ValueError where the array breaks off."""
    read = io.TextIOWrapper(stream, encoding="utf-8", errors="replace")
    decoder, held, at, opened, more = json.JSONDecoder(), "", 0, False, True
    while True:
        while at < len(held) and (held[at].isspace() or held[at] == ","):
            at += 1
        if at < len(held):
            if not opened:
                if held[at] != "[":
                    raise ValueError("not an array")
                opened, at = True, at + 1
                continue
            if held[at] == "]":
                return
            try:
                value, end = decoder.raw_decode(held, at)
                if _AFTER.match(held, end):  # else a number may go on in the next chunk
                    yield value
                    at = end
                    continue
            except json.JSONDecodeError:
                if not more:
                    raise ValueError("the array breaks off") from None
        if not more:
            raise ValueError("the array breaks off")
        new = read.read(chunk)
        more, held, at = bool(new), held[at:] + new, 0


def _member(archive: zipfile.ZipFile, ending: str) -> str:
    names = [n for n in archive.namelist() if n.endswith(ending)]
    if len(names) != 1:
        raise ValueError(f"{len(names)} members end in {ending}")
    return names[0]


def _replace(path: str, write) -> None:
    """``path`` appears whole or not at all."""
    with open(path + ".part", "w", encoding="utf-8", newline="") as out:
        write(out)
    os.replace(path + ".part", path)


def array_to_lines(zipped: str, lines: str, ending: str = ".json") -> int:
    """The JSON array in a ZIP archive as a file of lines; number of values."""
    n = 0

    def write(out) -> None:
        nonlocal n
        with zipfile.ZipFile(zipped) as archive, archive.open(_member(archive, ending)) as stream:
            for value in array_items(stream):
                out.write(json.dumps(value, ensure_ascii=False) + "\n")
                n += 1

    _replace(lines, write)
    return n


def csv_to_lines(zipped: str, lines: str, ending: str = ".csv", longest: int = 1 << 30) -> int:
    """Rows of a CSV with a header in a ZIP archive as JSON lines; fields up to ``longest`` characters, bytes that are no UTF-8 dropped."""
    n = 0

    def write(out) -> None:
        nonlocal n
        before = csv.field_size_limit(longest)
        try:
            with zipfile.ZipFile(zipped) as archive, archive.open(_member(archive, ending)) as stream:
                for row in csv.DictReader(io.TextIOWrapper(stream, encoding="utf-8", errors="ignore", newline="")):
                    out.write(json.dumps(row, ensure_ascii=False) + "\n")
                    n += 1
        finally:
            csv.field_size_limit(before)

    _replace(lines, write)
    return n


#: Rows that a task hands on at once.
_BATCH = 2_000


def _opened(path: str):
    """A file that can be sought in: of a mounted file system, or of any that Arrow knows by its scheme."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), "rb")
    files, place = pafs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def member_rows(spark: SparkSession, archives: list[str], ending: str, longest: int = 1 << 30) -> DataFrame:
    """(archive, n, value): the values of the one member of each ZIP archive that ends in ``ending``, as JSON texts in their order.

    A member ending in ``.csv`` is rows of a table with a header, bytes that are
    no UTF-8 dropped; any other is a JSON array. Each archive is streamed by a task
    of its own in bounded memory, since neither form can be split; write the result
    once (``runs.kept``) and it can. Paths are seen by all executors. An archive
    without such a member, with several, or whose array breaks off ends the query.
    """

    def values(stream) -> Iterator[str]:
        if ending.endswith(".csv"):
            csv.field_size_limit(longest)
            for row in csv.DictReader(io.TextIOWrapper(stream, encoding="utf-8", errors="ignore", newline="")):
                yield json.dumps(row, ensure_ascii=False)
        else:
            for value in array_items(stream):
                yield json.dumps(value, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with _opened(path) as file, zipfile.ZipFile(file) as archive, archive.open(_member(archive, ending)) as stream:
                    n, found = 0, values(stream)
                    while part := list(itertools.islice(found, _BATCH)):
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(n, n + len(part)), pa.int64()), pa.array(part)], ["archive", "n", "value"])
                        n += len(part)

    names = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives)), "archive")
    return names.mapInArrow(run, "archive string, n long, value string")


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The JSON texts ``value`` of ``rows`` as columns; fields that a text lacks are null."""
    return rows.select(F.from_json("value", schema).alias("v")).select("v.*")


def fetched(spark: SparkSession, wanted: dict[str, str], folder: str | None = None, part: int = 4 << 20) -> DataFrame:
    """(url, part, content) of files over HTTP whose SHA-256 are those ``wanted``, kept in the shared folder once all are there.

    A file is streamed by one task; if its digest is another, the job fails and nothing is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                told, n = hashlib.sha256(), 0
                with urllib.request.urlopen(url, timeout=60) as answer:  # noqa: S310
                    while content := answer.read(part):
                        told.update(content)
                        yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([n]), pa.array([content], pa.binary())], ["url", "part", "content"])
                        n += 1
                if told.hexdigest() != sha:
                    raise RuntimeError(f"{url} has the digest {told.hexdigest()}, not {sha}")

    rows = spark.createDataFrame(sorted(wanted.items()), "url string, sha string").repartition(max(1, len(wanted)), "url")
    name = hashlib.sha256(json.dumps(sorted(wanted.items())).encode()).hexdigest()[:32]
    return kept(spark, f"{folder or shared_dir(spark)}/loom-files-{name}", lambda: rows.mapInArrow(run, "url string, part long, content binary"))


def entity_key(kind: Column, entity: Column) -> Column:
    return F.concat(kind, F.lit("::"), entity)


def typed_triples(nodes: DataFrame, edges: DataFrame, renamed: dict[tuple[str, str, str], str]) -> tuple[DataFrame, DataFrame]:
    """(triples, unresolved): edges by uri with both ends known and (type, predicate, type) in ``renamed``, under its name.

    ``triples(head, interaction, tail)`` are distinct, without loops; between ends of one type the lesser comes
    first. ``unresolved(predicate_label, reason, n)`` counts the edges left out.
    """
    ends = nodes.select("uri", "entity_id", F.col("bioentity_type").alias("kind")).where("uri is not null").dropDuplicates(["uri"])
    side = lambda c: ends.select(F.col("uri").alias(f"{c}_uri"), F.col("entity_id").alias(f"{c}_id"), F.col("kind").alias(f"{c}_kind"))
    spark = nodes.sparkSession
    names = spark.createDataFrame([(*k, v) for k, v in renamed.items()], "source_kind string, predicate_label string, target_kind string, interaction string")
    found = edges.join(side("source"), "source_uri", "left").join(side("target"), "target_uri", "left").join(F.broadcast(names), ["source_kind", "predicate_label", "target_kind"], "left")  # a row a relation
    a, b = entity_key(F.col("source_kind"), F.col("source_id")), entity_key(F.col("target_kind"), F.col("target_id"))
    same = F.col("source_kind") == F.col("target_kind")
    rows = found.where("interaction is not null").select(F.when(same, F.least(a, b)).otherwise(a).alias("head"), "interaction", F.when(same, F.greatest(a, b)).otherwise(b).alias("tail"))
    reason = F.when(F.col("source_kind").isNull() | F.col("target_kind").isNull(), "end unknown").otherwise("relation not taken")
    left = found.where("interaction is null").groupBy("predicate_label", reason.alias("reason")).agg(F.count("*").alias("n"))
    return rows.where("head <> tail").distinct(), left


def read_graph(spark: SparkSession, node_lines: str, edge_lines: str, renamed: dict[tuple[str, str, str], str]) -> tuple[DataFrame, DataFrame]:
    return typed_triples(spark.read.schema(RAW_NODE).json(node_lines), spark.read.schema(RAW_EDGE).json(edge_lines), renamed)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(entity, label, type) of a tab-separated lookup; tabs in labels are spaces, null is empty, of several the first by label."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path).toDF("entity", "label", "type")
    return raw.groupBy("entity").agg(F.min(F.regexp_replace(F.coalesce("label", F.lit("")), "\t", " ")).alias("label"), F.min("type").alias("type"))
