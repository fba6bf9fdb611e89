"""Page snapshots as files with metadata beside them: a sink with a commit, and its reader.

``<root>/<host>/<seconds>_<content_sha>.html`` has a page and the ``.json``
file beside it what is known of the fetch. A name follows from the content, so
a repeated task or a repeated write replaces a file by its equal. Every file is
written under ``_staged`` and moved to its name when it is whole, the page
after its metadata: no reader sees half a file or a page without metadata.
Each write leaves a manifest under ``_commits``; a write that fails leaves
none, and its staged files are deleted.

Paths are opened by ``pyarrow.fs`` (local folders, HDFS, object stores), inside
the tasks; the driver only sees counts.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .pages import SNAPSHOT, snapshot_keys

_ROW = SNAPSHOT + ", host string, content_sha string, bytes int"
_META = "url string, status_code int, provider string, provider_meta map<string,string>, fetched_at double, content_sha string, bytes int"


def _opened(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:/", root) else (fs.LocalFileSystem(), root)


@dataclass
class Written(WriterCommitMessage):
    files: int = 0
    characters: int = 0


class SnapshotFiles(DataSource):
    """``df.write.format("page_snapshots").mode("append").save(root)`` for frames as ``snapshot_keys`` makes them."""

    @classmethod
    def name(cls) -> str:
        return "page_snapshots"

    def schema(self) -> str:
        return _ROW

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        if overwrite:
            raise ValueError("snapshots are only ever added; use mode append")
        missing = {"url", "html", "host", "content_sha", "bytes", "fetched_at"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return SnapshotWriter(self.options["path"])


class SnapshotWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.token = root.rstrip("/"), uuid.uuid4().hex

    def _put(self, files, path: str, data: bytes) -> None:
        """A whole file or none: written under a name of this task, then moved."""
        staged = f"{self.staged}/{uuid.uuid4().hex}"
        with files.open_output_stream(staged) as out:
            out.write(data)
        files.move(staged, path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _opened(self.root)
        self.staged, done, made = f"{root}/_staged/{self.token}", Written(), set()
        files.create_dir(self.staged)
        for batch in iterator:
            for row in batch.to_pylist():
                if row["html"] is None:
                    continue
                folder = f"{root}/{row['host']}"
                if folder not in made:
                    files.create_dir(folder)
                    made.add(folder)
                stem = f"{folder}/{int(row['fetched_at'] or 0)}_{row['content_sha']}"
                meta = {k: row.get(k) for k in ("url", "status_code", "provider", "fetched_at", "content_sha", "bytes")} | {"provider_meta": dict(row.get("provider_meta") or {})}
                self._put(files, f"{stem}.json", json.dumps(meta, ensure_ascii=False).encode())
                self._put(files, f"{stem}.html", row["html"].encode())
                done.files += 1
                done.characters += row["bytes"]
        return done

    def _finish(self):
        files, root = _opened(self.root)
        from pyarrow.fs import FileType

        if files.get_file_info(f"{root}/_staged/{self.token}").type == FileType.Directory:
            files.delete_dir(f"{root}/_staged/{self.token}")
        return files, root

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._finish()
        files.create_dir(f"{root}/_commits")
        told = [m for m in messages if m]
        with files.open_output_stream(f"{root}/_commits/{self.token}.json") as out:
            out.write(json.dumps({"files": sum(m.files for m in told), "characters": sum(m.characters for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._finish()


def write_snapshot_files(pages: DataFrame, root: str) -> None:
    """Add the snapshots of ``pages`` (url, html, status_code, provider, provider_meta, fetched_at); rows without html have no file.

    Rows of one host, second and content are one file, that of any of them.
    """
    pages.sparkSession.dataSource.register(SnapshotFiles)
    columns = ["url", "html", "status_code", "provider", "provider_meta", "fetched_at", "host", "content_sha", "bytes"]
    snapshot_keys(pages).select(*columns).write.format("page_snapshots").mode("append").save(root)


def read_snapshot_files(spark: SparkSession, root: str) -> DataFrame:
    """(url, html, status_code, provider, provider_meta, fetched_at, host, content_sha, bytes) of every page file under ``root``.

    A page whose metadata is missing, or whose content does not have the hash
    of its name, raises when its row is read. Metadata without a page is left
    out: the write that made it failed before the page.
    """

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def folders(batches):
        from pyarrow import fs

        files, top = _opened(root)
        list(batches)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(top, allow_not_found=True)) if i.type == fs.FileType.Directory and i.base_name[:1] != "_")
        for at in range(0, len(names), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000], pa.string())], names=["host"])

    def stems(batches):
        from pyarrow import fs

        files, top = _opened(root)
        for batch in batches:
            for host in batch.column("host").to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{top}/{host}"))
                names = [f"{host}/{i.base_name[:-5]}" for i in found if i.type == fs.FileType.File and i.base_name.endswith(".html") and i.base_name[:1] not in "_."]
                for at in range(0, len(names), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000], pa.string())], names=["stem"])

    def contents(batches):
        files, top = _opened(root)

        def text(path: str) -> str:
            with files.open_input_stream(path) as opened:
                return opened.read().decode("utf-8", "replace")

        def meta(path: str) -> str | None:
            try:
                return text(path)
            except FileNotFoundError:
                return None

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                names = batch.column("stem").slice(at, 64).to_pylist()
                got = [[text(f"{top}/{n}.html") for n in names], [meta(f"{top}/{n}.json") for n in names]]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.string()) for x in got)], names=["stem", "html", "meta"])

    # names are listed and files opened in the tasks, a folder's files by many of them; the driver sees none
    hosts = spark.range(1, numPartitions=1).mapInArrow(folders, "host string").repartition(tasks, "host")
    read = hosts.mapInArrow(stems, "stem string").repartition(tasks, "stem").mapInArrow(contents, "stem string, html string, meta string")
    found = read.withColumn("m", F.from_json("meta", _META))
    sound = F.substring(F.sha2("html", 256), 1, 16) == F.substring_index("stem", "_", -1)
    html = (
        F.when(F.col("m").isNull(), F.raise_error(F.concat(F.lit("no metadata beside "), "stem")))
        .when(~sound, F.raise_error(F.concat(F.lit("content does not have the hash of its name: "), "stem")))
        .otherwise(F.col("html"))
    )
    return found.select("m.url", html.alias("html"), "m.status_code", "m.provider", "m.provider_meta", "m.fetched_at", F.substring_index("stem", "/", 1).alias("host"), "m.content_sha", "m.bytes")
