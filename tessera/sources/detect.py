"""Format detection, CSV sniffing and directory catalogs.

Only the first bytes of a file are read on the driver, through Spark's own file systems,
so any path that Spark can open works.
"""

from __future__ import annotations

import logging
from collections import OrderedDict
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)
SNIFF = 256
#: File extensions by format (fixed values).
EXTENSIONS = {"parquet": ["parquet", "pq"], "json": ["json", "jsonl", "ndjson"], "csv": ["csv", "tsv", "txt", "dat", "log"]}
_BY_EXTENSION = {e: f for f, many in EXTENSIONS.items() for e in many}


def _status(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def head(spark: SparkSession, path: str, size: int = SNIFF) -> bytes:
    """The first bytes of a file (of the first part of a directory)."""
    fs, p = _status(spark, path)
    if fs.getFileStatus(p).isDirectory():
        parts = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        if not parts:
            return b""
        p = spark._jvm.org.apache.hadoop.fs.Path(parts[0])
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def detect_format(name: str, first: bytes) -> str:
    """Magic bytes, then the first visible byte, then the extension, then CSV."""
    if first.startswith(b"PAR1"):
        return "parquet"
    if first.lstrip()[:1] in (b"{", b"["):
        return "json"
    return _BY_EXTENSION.get(PurePosixPath(name).suffix.lstrip(".").lower(), "csv")


def sniff_delimiter(header: str) -> str:
    """The most frequent of comma, tab and bar; ties go to the first."""
    return max(",\t|", key=header.count)


def column_names(header: str, delimiter: str) -> list[str]:
    """Header cells; blank ones are named _col_N."""
    return [c.strip().strip('"') or f"_col_{i}" for i, c in enumerate(header.rstrip("\r\n").split(delimiter))]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    text = head(spark, path, 65_536).decode("utf-8", "replace")
    line = text.split("\n", 1)[0]
    delimiter = sniff_delimiter(line)
    df = spark.read.csv(path, header=True, inferSchema=True, sep=delimiter)
    names = column_names(line.lstrip("﻿"), delimiter)
    return df.toDF(*names) if len(names) == len(df.columns) else df


def read_any(spark: SparkSession, path: str) -> DataFrame:
    first = head(spark, path)
    kind = detect_format(path, first)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        # an array of objects is one document over many lines; lines are split otherwise
        return spark.read.json(path, multiLine=first.lstrip()[:1] == b"[")
    return read_csv(spark, path)


class Catalog:
    """One table for each file of a directory, as temporary views; at most ``cached`` pinned."""

    def __init__(self, spark: SparkSession, directory: str, cached: int = 8):
        self.spark, self.directory, self.limit = spark, directory, cached
        self.prints: dict[str, tuple[str, int, int]] = {}
        self.pinned: OrderedDict[str, DataFrame] = OrderedDict()
        self.refresh()

    def _files(self) -> dict[str, tuple[str, int, int]]:
        fs, p = _status(self.spark, self.directory)
        out = {}
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if not name.startswith((".", "_")):
                out[name.rsplit(".", 1)[0].lower()] = (s.getPath().toString(), s.getLen(), s.getModificationTime())
        return dict(sorted(out.items()))

    def refresh(self) -> list[str]:
        """Register new and changed files; unreadable ones are skipped and logged."""
        now = self._files()
        for name in set(self.prints) - set(now):
            self.spark.catalog.dropTempView(name)
            self.unpin(name)
        for name, stamp in now.items():
            if self.prints.get(name) == stamp:
                continue
            self.unpin(name)
            try:
                self.spark.catalog.refreshByPath(stamp[0])
                read_any(self.spark, stamp[0]).createOrReplaceTempView(name)
            except Exception as e:  # noqa: BLE001  a bad file must not hide the others
                log.warning("skipped %s: %s", stamp[0], str(e).split("\n")[0])
                now[name] = None
        self.prints = {k: v for k, v in now.items() if v}
        return list(self.prints)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name.lower())

    def pin(self, name: str) -> DataFrame:
        """Keep a table in memory; the oldest pinned one gives way."""
        if name not in self.pinned:
            self.pinned[name] = self.table(name).cache()
            while len(self.pinned) > self.limit:
                self.pinned.popitem(last=False)[1].unpersist()
        return self.pinned[name]

    def unpin(self, name: str) -> None:
        if name in self.pinned:
            self.pinned.pop(name).unpersist()

    def sql(self, text: str, **args) -> DataFrame:
        return self.spark.sql(text, args=args or None)
