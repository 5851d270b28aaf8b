"""Shared helpers of the text operators: reading, lineage cuts and batch tokenising.

The tokeniser works on the raw UTF-8 buffer of an Arrow string column, a slice of
rows at a time, so no Python object is made per word.
"""

from __future__ import annotations

import gc
import pickle
import tempfile
import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a Python worker (a longer text is one slice).
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the session's ``spark.checkpoint.dir``; only where
    that is unset (tests on one machine) a temporary one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="ckpt"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps that nothing refers to.

    The scheduler keeps hold of the job that ran last, so a tiny one goes before the
    second round.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)  # the cleaner works in the background
        spark.range(1).collect()


def text_column(name: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- batch tokenising -------------------------------------------------------------

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_MULT = tuple(int(x) | 1 for x in _rng.integers(1 << 60, 1 << 63, size=4, dtype=np.uint64))
_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**i and its inverse modulo 2**64 for i < n (kept per worker)."""
    got = _powers.get(mult)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        inv = pow(mult, -1, 1 << 64)
        out = []
        for m in (mult, inv):
            p = np.empty(size, dtype=np.uint64)
            p[0] = 1
            p[1:] = np.uint64(m)
            np.multiply.accumulate(p, out=p)
            out.append(p)
        _powers[mult] = got = (out[0], out[1])
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, raw


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some rows: byte ranges and row bounds."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, word_byte: np.ndarray = _WORD_BYTE):
        self.base = int(offsets[0])
        self.data = raw[self.base : int(offsets[-1])]
        self.offsets = offsets - self.base
        is_word = word_byte[self.data]
        before = np.zeros(len(is_word) + 1, dtype=bool)
        before[1:] = is_word
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(is_word))]
        after = before[1:].copy()  # is_word[i]
        starts = is_word.copy()
        if len(starts):
            starts[1:] &= ~is_word[:-1]
            starts[inner] |= is_word[inner]
            after[:-1] &= ~is_word[1:]
            after[inner - 1] |= is_word[inner - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(after) + 1
        #: row r has words first[r] to first[r + 1]
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``which`` selects one of two functions."""
        n = len(self.data)
        p, inv = powers(_MULT[which], n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[which][self.data] * p[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * inv[self.starts])


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of words[i : i + size] for every i; windows that end past the array are left out."""
    n = len(words)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    p, inv = powers(_MULT[2 + which], n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * p[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inv[: n - size + 1])


def rows_of(first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row that each word index in ``starts`` belongs to."""
    return np.searchsorted(first, starts, side="right") - 1


# --- tables between steps ---------------------------------------------------------


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package (a cluster may install it instead)."""
    import os
    from pathlib import Path

    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def on_one_worker(rows: DataFrame, learn: Callable[[pa.Table], Any]) -> Any:
    """What ``learn`` makes of all rows, in one worker: training takes no memory of the driver.

    For samples of a bounded number of rows; None if there is no row.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_pydict({"found": pa.array([pickle.dumps(learn(pa.Table.from_batches(held)))], pa.binary())})

    found = rows.repartition(1).mapInArrow(run, "found binary").collect()
    return pickle.loads(found[0].found) if found else None


class Stash:
    """A table written as Parquet to the shared folder, so that it is computed once.

    Survives the loss of executors, and is compressed, unlike a checkpoint.
    """

    def __init__(self, df: DataFrame):
        import uuid

        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only after everything that reads them is materialised."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
