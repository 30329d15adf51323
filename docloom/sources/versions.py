"""Numbered versions of a small text in a shared folder, each published whole or not at all.

A version is a file ``v<number>.json``. It is written under another name and then renamed to a name that must not exist: of two writers of one number the
second gets a Conflict, and a writer that dies half way leaves a stray file that nobody reads. Versions never change; readers take the largest number.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has published this version already."""


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Published version numbers, ascending; empty for a folder that isn't there."""
    where, system = _at(spark, folder)
    if not system.exists(where):
        return []
    names = [f.getPath().getName() for f in system.listStatus(where)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def read(spark: SparkSession, folder: str, number: int | None = None) -> tuple[int, dict] | None:
    """(number, content) of a version, the largest if none is named; None if there is none."""
    known = numbers(spark, folder)
    if not known or (number is not None and number not in known):
        return None
    number = known[-1] if number is None else number
    row = spark.read.text(f"{folder}/v{number}.json", wholetext=True).first()
    return number, json.loads(row.value)


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> int:
    """Publishes content as version number, which is returned; raises Conflict if that version is there."""
    jvm = spark._jvm
    final, system = _at(spark, f"{folder}/v{number}.json")
    draft, _ = _at(spark, f"{folder}/_draft-{uuid.uuid4().hex}")
    system.mkdirs(final.getParent())
    out = system.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    if number in numbers(spark, folder):
        system.delete(draft, False)
        raise Conflict(f"version {number} of {folder} is there")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, final, options)
    except Py4JJavaError as e:
        system.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            raise Conflict(f"version {number} of {folder} is there") from e
        raise
    return number


def forget(spark: SparkSession, folder: str, keep: int = 10) -> None:
    """Deletes all but the last keep versions (of those published now)."""
    for n in numbers(spark, folder)[:-keep]:
        where, system = _at(spark, f"{folder}/v{n}.json")
        system.delete(where, False)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the names, sizes and times of files: equal while none of them is replaced."""
    import hashlib

    told = []
    for p in sorted(paths):
        where, system = _at(spark, p)
        status = system.getFileStatus(where)
        told.append(f"{p} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()
