"""Small records of finished work, one JSON file each, and signatures of the
files that the work was made from. Both go through Hadoop's file system."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession

from farepath.session import file_system


def source_signature(spark: SparkSession, path: str) -> str | None:
    """Digest of the names, lengths and times of the files under ``path`` (a
    file, a folder or a pattern); None if there are none."""
    fs, where = file_system(spark, path)
    digest, any_file = hashlib.sha256(), False
    found = fs.globStatus(where) or []
    for top in sorted((s.getPath() for s in found), key=str):
        files = fs.listFiles(top, True)
        lines = []
        while files.hasNext():
            f = files.next()
            lines.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
        any_file = any_file or bool(lines)
        digest.update("\n".join(sorted(lines)).encode())
    return digest.hexdigest() if any_file else None


def _record_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{hashlib.sha256(name.encode()).hexdigest()[:24]}.json"


def read_record(spark: SparkSession, folder: str, name: str) -> dict | None:
    fs, where = file_system(spark, _record_path(folder, name))
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_record(spark: SparkSession, folder: str, name: str, record: dict) -> None:
    """A record appears whole: it is written beside and renamed."""
    path = _record_path(folder, name)
    fs, where = file_system(spark, path)
    part = file_system(spark, f"{path}.part")[1]
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(json.dumps(record).encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"{path} can't be written")
