"""Folders that all tasks share, and files written there whole or not at all."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, on a cluster that is an error."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError(f"spark.checkpoint.dir isn't set, and on {sc.master} there is no other folder that all executors share")
    kept = getattr(sc, "_foliospark_files", None)
    if kept is None:
        kept = sc._foliospark_files = tempfile.mkdtemp(prefix="foliospark-files-")
    return kept


def file_system(folder: str):
    """The file system of a folder and its path there, for tasks as well: a local path, or a URI such as hdfs:, s3: or gs:."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
    return fs.LocalFileSystem(), folder


class Replacing:
    """A file that takes its name only when it is done, so that attempts of one task can't mix."""

    def __init__(self, system, path: str):
        self.system, self.path, self.made = system, path, f"{path}.{uuid.uuid4().hex}.part"
        self.stream = system.open_output_stream(self.made)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def done(self) -> None:
        self.stream.close()
        self.system.move(self.made, self.path)


def write_packages(pk: DataFrame, folder: str) -> str:
    """Each package as a file of its path's last name; gives the folder."""

    def run(batches):
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                out = Replacing(system, f"{at}/{path.rpartition('/')[2]}")
                out.write(content or b"")
                out.done()
            yield b.select(["path"])

    pk.select("path", "content").mapInArrow(run, "path string").count()
    return folder
