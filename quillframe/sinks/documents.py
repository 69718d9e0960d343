"""One file per document, committed as a whole (K1-K4): a Python data source.

Every task writes its documents into a folder of its own attempt and, last, a
manifest part that lists them.  The job's commit collects the manifest parts of
the attempts that count, removes the folders of all others, and makes the
manifest visible with one rename; a job that fails removes what it wrote.
Readers see what a visible manifest lists, so a failed or lost task leaves
nothing behind.  Only attempt names pass through the driver.

A document that is written again (same run, topic and name) replaces the older
one for readers.  Folders are reached through ``pyarrow.fs`` (local paths,
``hdfs://``, ``s3://`` and the like).
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quillframe.session import ship_package

FORMAT = "quillframe_documents"
DOCUMENT_SCHEMA = "run_id string, topic_id string, name string, body string"
MANIFEST_SCHEMA = "run_id string, topic_id string, name string, path string, bytes bigint, sha256 string, written_us bigint"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; a path without ``://`` is local."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def file_name(*parts: str | None) -> str:
    """The parts as one file name, whatever characters they hold; distinct parts have distinct names."""
    return "~".join("-" if p is None else "'" + urllib.parse.quote(p, safe="") for p in parts)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.job = f"{time.time_ns() // 1000:017d}-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        fs, base = file_system(self.path)
        task = TaskContext.get()
        folder = f"{task.partitionId() if task else 0}-{uuid.uuid4().hex[:12]}"
        here = f"{base}/files/{self.job}/{folder}"
        fs.create_dir(here, recursive=True)
        listed = []
        try:
            for row in iterator:
                body = (row["body"] or "").encode("utf-8")
                # a long name is cut to its hash: file systems take 255 bytes
                name = file_name(row["run_id"], row["topic_id"], row["name"])
                name = name if len(name) <= 200 else hashlib.sha256(name.encode()).hexdigest()
                with fs.open_output_stream(f"{here}/{name}") as f:
                    f.write(body)
                entry = {"run_id": row["run_id"], "topic_id": row["topic_id"], "name": row["name"], "path": f"files/{self.job}/{folder}/{name}"}
                listed.append(json.dumps(entry | {"bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "written_us": time.time_ns() // 1000}))
            with fs.open_output_stream(f"{here}/_manifest.jsonl") as f:
                f.write("".join(x + "\n" for x in listed).encode("utf-8"))
        except BaseException:
            fs.delete_dir(here)
            raise
        return Attempt(folder)

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, base = file_system(self.path)
        kept = {m.folder for m in messages if m is not None}
        hidden = f"{base}/manifest/_{self.job}"
        fs.create_dir(hidden, recursive=True)
        for folder in sorted(kept):
            fs.move(f"{base}/files/{self.job}/{folder}/_manifest.jsonl", f"{hidden}/{folder}.jsonl")
        for info in fs.get_file_info(pafs.FileSelector(f"{base}/files/{self.job}", allow_not_found=True)):
            if info.base_name not in kept:
                fs.delete_dir(info.path)
        fs.move(hidden, f"{base}/manifest/job={self.job}")

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, base = file_system(self.path)
        if fs.get_file_info(f"{base}/files/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/files/{self.job}")


class DocumentSource(DataSource):
    """``df.write.format("quillframe_documents").option("path", folder).mode("append").save()``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DOCUMENT_SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("documents are appended; a document that is written again replaces the older one")
        return DocumentWriter(self.options["path"])


def write_documents(df: DataFrame, path: str, body: Column, name: Column | str) -> None:
    """One file per row: ``body`` under (run_id, topic_id, ``name``) in the folder ``path``."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(DocumentSource)
    label = F.lit(name) if isinstance(name, str) else name
    rows = df.select(F.col("run_id").cast("string").alias("run_id"), F.col("topic_id").cast("string").alias("topic_id"), label.alias("name"), body.alias("body"))
    rows.write.format(FORMAT).option("path", path).mode("append").save()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents that count at ``path``: of each (run_id, topic_id, name) the last one written."""
    base = path.rstrip("/")
    rows = spark.read.schema(MANIFEST_SCHEMA + ", job string").json(f"{base}/manifest")
    keys = ["run_id", "topic_id", "name"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("path", "bytes", "sha256"), F.struct("job", "written_us")).alias("_r"))
    return last.select(*keys, F.concat(F.lit(f"{base}/"), F.col("_r.path")).alias("path"), "_r.bytes", "_r.sha256")


#: Bytes of bodies in one batch of read documents, and files and bytes that one reading task is given.
READ_BATCH = 16 << 20
FILES_A_TASK = 2048
BYTES_A_TASK = 64 << 20


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, topic_id, name, body) of the documents that count, read back from their files.

    Tasks open the files that the manifest names: no folder is listed, and a
    task has many files however small they are.  An empty or lost file is an
    empty body.
    """
    base = path.rstrip("/")
    ship_package(spark)
    kept = read_manifest(spark, path)
    files, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, files // FILES_A_TASK + 1, size // BYTES_A_TASK + 1)
    listed = kept.select("run_id", "topic_id", "name", F.substring("path", F.lit(len(base) + 2), F.length("path")).alias("_f")).repartition(tasks, "_f")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(base)
        for batch in batches:
            start, read, held = 0, [], 0
            for i, name in enumerate(batch.column("_f").to_pylist(), 1):
                try:
                    with fs.open_input_stream(f"{root}/{name}") as f:
                        read.append(f.read().decode("utf-8", "replace"))
                except FileNotFoundError:
                    read.append("")
                held += len(read[-1])
                if held >= READ_BATCH or i == batch.num_rows:
                    keys = [batch.column(c).slice(start, i - start) for c in ("run_id", "topic_id", "name")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(read, pa.string())], ["run_id", "topic_id", "name", "body"])
                    start, read, held = i, [], 0

    return listed.mapInArrow(bodies, DOCUMENT_SCHEMA)
