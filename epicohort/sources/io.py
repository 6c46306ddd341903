"""Scans, stage tables and result sinks.

A stage table is written to a folder of its own under the session's shared
checkpoint folder (``spark.checkpoint.dir``) and becomes visible by a manifest that
is put beside it last: the folder, its files and their sizes.  Readers go by the
newest manifest alone, so a write that dies half way changes nothing for
them, a lost executor re-reads a finished stage instead of recomputing the study, and
later stages plan against a short scan.  Older folders and half-written ones
go with the next publication, all of a study's with ``drop_version``.  Result
tables are published the same way, in as many files as their plan has
partitions.  Files are listed, moved and removed through pyarrow's file systems,
by the path's URI."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Sequence
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epicohort.session import ensure_checkpoint_dir

#: Published folders of a stage that stay: the newest, and the one a reader may still hold.
KEEP = 2
_MANIFESTS = "_published"


def scan(spark: SparkSession, path: str, cols: Sequence[str] | None = None, where=None, computed: dict | None = None):
    """Parquet scan with an explicit column list, a pushed predicate and
    computed columns (pruning and pushdown reach the scan)."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if computed:
        df = df.withColumns(computed)
    if cols:
        df = df.select(*cols, *(computed or {}).keys())
    return df


def input_state(spark: SparkSession, paths: Sequence[str]) -> tuple[int, int]:
    """Number of files under ``paths`` and a digest of their places, sizes and times of change.
    Only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).coalesce(1)  # a row per file
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("digest")).first()
    return row["n"], int(row["digest"] or 0)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def _names(store: fs.FileSystem, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    return sorted(f.base_name for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _data_files(store: fs.FileSystem, folder: str) -> dict[str, int]:
    found = store.get_file_info(fs.FileSelector(folder, recursive=True))
    return {f.path[len(folder):].lstrip("/"): f.size for f in found
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


def publish(table: str, folder: str, keep: int = KEEP) -> None:
    """Make the finished folder ``table``/``folder`` the content of ``table``, then remove
    all but the last ``keep`` published folders and what no manifest names."""
    store, root = open_store(table)
    manifests = f"{root}/{_MANIFESTS}"
    store.create_dir(manifests, recursive=True)
    before = [n for n in _names(store, manifests) if n.endswith(".json")]
    number = int(before[-1].partition("-")[0]) + 1 if before else 0
    name = f"{number:09d}-{uuid.uuid4().hex[:8]}"
    with store.open_output_stream(f"{manifests}/{name}.part") as out:
        out.write(json.dumps({"folder": folder, "files": _data_files(store, f"{root}/{folder}")}).encode())
    store.move(f"{manifests}/{name}.part", f"{manifests}/{name}.json")
    for old in before[:len(before) + 1 - keep]:
        store.delete_file(f"{manifests}/{old}")
    held = {_manifest(store, f"{manifests}/{n}")["folder"] for n in _names(store, manifests) if n.endswith(".json")}
    for other in _names(store, root):
        if other != _MANIFESTS and other not in held:
            store.delete_dir(f"{root}/{other}")


def _manifest(store: fs.FileSystem, path: str) -> dict:
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def published(table: str) -> str:
    """The folder that ``table`` holds now; its files are checked against the manifest."""
    store, root = open_store(table)
    names = [n for n in _names(store, f"{root}/{_MANIFESTS}") if n.endswith(".json")]
    if not names:
        raise FileNotFoundError(f"nothing is published as {table}")
    manifest = _manifest(store, f"{root}/{_MANIFESTS}/{names[-1]}")
    if _data_files(store, f"{root}/{manifest['folder']}") != manifest["files"]:
        raise OSError(f"the files of {table}/{manifest['folder']} are not those that were published")
    return os.path.join(table, manifest["folder"])


def stage_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "stages")


def write_stage(df: DataFrame, name: str, version: str, keep: int = KEEP) -> str:
    """Replace the stage table ``name`` of a study (``version``); an unfinished write leaves the old one."""
    table, folder = os.path.join(stage_root(df.sparkSession), version, name), new_version()
    df.write.parquet(os.path.join(table, folder))
    publish(table, folder, keep)
    return os.path.join(table, folder)


def read_stage(spark: SparkSession, name: str, version: str) -> DataFrame:
    """Full scan of a study's stage table, as published last."""
    return spark.read.parquet(published(os.path.join(stage_root(spark), version, name)))


def drop_version(spark: SparkSession, version: str) -> None:
    """Remove all stage tables of a study."""
    store, root = open_store(os.path.join(stage_root(spark), version))
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)


def scratch_root(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "scratch", spark.sparkContext.applicationId)


def drop_scratch(spark: SparkSession) -> None:
    """Remove what this application stashed; tables that still read from it break."""
    store, root = open_store(scratch_root(spark))
    if store.get_file_info(root).type == fs.FileType.Directory:
        store.delete_dir(root)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table beside the stages, under a name of its own, and
    read it back: the lineage ends at files that every executor can read."""
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"{name}_{new_version()}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_version() -> str:
    return uuid.uuid4().hex[:12]


def register_view(df: DataFrame, name: str) -> DataFrame:
    """S7."""
    df.createOrReplaceTempView(name)
    return df


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV lookup with header and explicit schema (a leading BOM is dropped)."""
    return spark.read.csv(path, header=True, schema=schema, encoding="UTF-8")


def write_results(tables: dict, path: str, fmt: str = "csv") -> dict:
    """Publish each named result table under ``path``, in as many files as it has
    partitions; the manifest lists them.  Returns the tables' places."""
    out = {}
    for name, df in tables.items():
        table, folder = os.path.join(path, name), new_version()
        w = df.write.option("header", True) if fmt == "csv" else df.write
        w.format(fmt).save(os.path.join(table, folder))
        publish(table, folder)
        out[name] = table
    return out


def read_results(spark: SparkSession, path: str, name: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    """Read back an earlier result table, as published last; without a schema the types of a CSV are inferred."""
    place = published(os.path.join(path, name))
    if fmt != "csv":
        return spark.read.format(fmt).load(place)
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(place)
