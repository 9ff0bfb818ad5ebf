"""Outputs replaced as a whole: written beside, then swapped by the file
system, so a write that fails leaves the old output as it was.

A swap is two renames. A reader finds the old folder or the new one; a run
that ends between the renames leaves the old one under its second name, and
the next write (or :func:`recover`) puts it back first. On stores without
renames the second step copies, and only its end makes the output whole
(Spark's success marker comes last).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from farepath.session import file_system


def _named(path: str, kind: str) -> str:
    """A path in the same folder, under a name that Spark's readers skip."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{kind}-{name}" if parent else f"_{kind}-{name}"


def recover(spark: SparkSession, path: str) -> None:
    """End a swap that was cut off: the old output returns if the new one
    isn't in place."""
    found = file_system(spark, path)
    if found is None:
        return
    fs, target = found
    previous = file_system(spark, _named(path, "previous"))[1]
    if fs.exists(previous):
        if fs.exists(target):
            fs.delete(previous, True)
        else:
            fs.rename(previous, target)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str, str], None]) -> str:
    """Call ``write(path, mode)`` for a folder beside ``path``, then put it in
    the place of ``path``. If the write fails, ``path`` is untouched. (With
    Spark Connect, whose file system can't be reached from here, Spark's own
    overwrite is used.)"""
    found = file_system(spark, path)
    if found is None:
        write(path, "overwrite")
        return path
    fs, target = found
    recover(spark, path)
    beside = _named(path, f"staging-{uuid.uuid4().hex[:12]}")
    staging, previous = (file_system(spark, p)[1] for p in (beside, _named(path, "previous")))
    try:
        write(beside, "errorifexists")
        if fs.exists(target) and not fs.rename(target, previous):
            raise OSError(f"{path} can't be moved")
        if not fs.rename(staging, target):
            raise OSError(f"{beside} can't be moved to {path}")
    except BaseException:
        fs.delete(staging, True)
        recover(spark, path)
        raise
    fs.delete(previous, True)
    return path
