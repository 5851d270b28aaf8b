"""State kept from change events: in one batch, and by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.text import positions
from tessera.sources.shared import file_system


def latest_state(changes: DataFrame, key: str, order: str, deleted: str) -> DataFrame:
    """The last change of each key, without those that delete it (an aggregate by key)."""
    rest = [c for c in changes.columns if c != key]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return last.where(f"not ({deleted})")


def split_renames(changes: DataFrame) -> DataFrame:
    """A rename is a deletion of the old path and a creation of the new one."""
    two = F.when(
        F.col("kind") == "renamed",
        F.array(F.struct(F.lit("deleted").alias("kind"), F.col("path").alias("path")), F.struct(F.lit("created").alias("kind"), F.col("new_path").alias("path"))),
    ).otherwise(F.array(F.struct("kind", "path")))
    return changes.select(F.explode(two).alias("_c"), "seq").select("_c.kind", "_c.path", "seq")


def rescan_diff(state: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """key, action: what brings the state up to what was found."""
    both = state.select(key, F.col(value).alias("_old"), F.lit(1).alias("_s")).join(found.select(key, F.col(value).alias("_new"), F.lit(1).alias("_f")), key, "full")
    action = F.when(F.col("_s").isNull(), "insert").when(F.col("_f").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update").otherwise("keep")
    return both.select(key, action.alias("action"))


def latest_generation(updates: DataFrame, generation: str) -> DataFrame:
    """Drops updates of any generation but the newest."""
    newest = updates.agg(F.max(generation).alias("_g"))  # one row
    return updates.join(F.broadcast(newest), F.col(generation) == F.col("_g"), "left_semi")


def needs_compaction(state: DataFrame, deleted: str, share: float = 0.2) -> DataFrame:
    return state.agg(F.count("*").alias("n_rows"), F.count_if(F.expr(deleted)).alias("n_deleted")).withColumn("compact", F.coalesce(F.expr(f"n_deleted / nullif(n_rows, 0) > {share}"), F.lit(False)))


def compact(state: DataFrame, deleted: str, order: str, share: float = 0.2) -> DataFrame:
    """The state in order, without its deleted rows if they are more than ``share`` of all;
    fewer are left where they are."""
    due = needs_compaction(state, deleted, share).select("compact")  # one row
    return state.join(F.broadcast(due)).where(f"not (compact and ({deleted}))").drop("compact").orderBy(order)


def under(path: Column, root: str) -> Column:
    """The path is the root or lies below it."""
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def rescan_subtree(state: DataFrame, found: DataFrame, key: str, value: str, root: str) -> DataFrame:
    """key, action after a scan of one subtree: paths outside of it are kept as they are."""
    inside = rescan_diff(state.where(under(F.col(key), root)), found.where(under(F.col(key), root)), key, value)
    return inside.unionByName(state.where(~under(F.col(key), root)).select(key, F.lit("keep").alias("action")))


def rescan_roots(changes: DataFrame) -> DataFrame:
    """path: the subtrees that a ``must_rescan`` event asks for, without those inside another.

    ``history_done`` events carry no path and ask for nothing.
    """
    roots = changes.where("kind = 'must_rescan' and path is not null").select("path").distinct()
    # the ancestors of each root, by equality: no pairs of roots are compared
    parts = F.split("path", "/")
    above = roots.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("_up")).where("_up <> path")
    covered = above.join(roots.select(F.col("path").alias("_up")), "_up", "left_semi").select("path")
    return roots.join(covered.distinct(), "path", "left_anti")


def debounce(events: DataFrame, key: str, ts: str, quiet_ms: int = 500, tie: tuple[str, ...] = ()) -> DataFrame:
    """The last event of each burst: none of the same key follows within ``quiet_ms``."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(ts, *tie))
    gap = (F.unix_micros(F.col("_after").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1000
    return events.withColumn("_after", after).where(F.col("_after").isNull() | (gap > quiet_ms)).drop("_after")


@dataclass
class FlushPolicy:
    """State is written after so many changes, or so many seconds (fixed values)."""

    changes: int = 1000
    seconds: float = 30.0

    def due(self, changes: int, elapsed: float) -> bool:
        return changes >= self.changes or elapsed >= self.seconds

    def trigger(self) -> dict:
        """The same clock for a stream; its sources take ``maxFilesPerTrigger`` besides."""
        return {"processingTime": f"{self.seconds:g} seconds"}


def resume(stored: int, current: int) -> str:
    """What a stored event id is worth: ``valid``, ``none`` (start from now), or
    ``regression`` (the journal was reset: rebuild)."""
    return "none" if stored == 0 else "regression" if stored > current else "valid"


@contextmanager
def cancellable(spark: SparkSession, group: str):
    """Jobs started inside can be ended from another thread by calling what this yields."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        sc.setLocalProperty("spark.job.interruptOnCancel", None)


class StateTable:
    """The latest state of a change stream, kept as versions of a Parquet table.

    Each micro-batch is reduced to one row for each key, merged with the last complete
    version in the folder and written as the next. Merging a batch twice changes nothing, so
    one that is tried again is safe, and a new StateTable goes on from the folder. The
    version before the last stays until the next merge.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: str, deleted: str):
        self.spark, self.folder, self.key, self.order, self.deleted = spark, folder, key, order, deleted

    def _versions(self) -> list[int]:
        """Complete versions in the folder, ascending."""
        fs, p = file_system(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = [n for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(file_system(self.spark, f"{self.folder}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in whole)

    @property
    def version(self) -> int:
        return max(self._versions(), default=-1)

    def _write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        for old in [v for v in self._versions() if v < version - 1]:
            fs, p = file_system(self.spark, f"{self.folder}/v{old}")
            fs.delete(p, True)

    def merge(self, batch: DataFrame, batch_id: int = 0) -> None:
        version = self.version
        rows = batch if version < 0 else batch.unionByName(self.spark.read.parquet(f"{self.folder}/v{version}"))
        rest = [c for c in rows.columns if c != self.key]
        self._write(rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.order).alias("_r")).select(self.key, "_r.*"), version + 1)

    def compact(self, share: float = 0.2) -> None:
        """Drop deleted rows if they are more than ``share``; a late change of such a key that
        is older than its deletion would then bring it back."""
        version = self.version
        if version >= 0:
            self._write(compact(self.spark.read.parquet(f"{self.folder}/v{version}"), self.deleted, self.key, share), version + 1)

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}").where(f"not ({self.deleted})")


def search_stream(spark: SparkSession, directory: str, pattern: str, each: Callable[[DataFrame, int], None], checkpoint: str, files: int = 5000, largest: int = 100 << 20) -> None:
    """Search the files of a directory in chunks: each micro-batch of at most ``files`` files
    gives path, line, column and offset of its matches; files over ``largest`` bytes are left out."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    chunks = spark.readStream.schema(schema).format("binaryFile").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).load(directory)
    texts = chunks.where(F.col("length") <= largest).select("path", F.decode("content", "UTF-8").alias("text"))
    run_stream(texts, lambda batch, n: each(positions(batch, "path", "text", pattern), n), checkpoint)


def run_stream(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> None:
    """Feed all available micro-batches to ``each`` and wait for the end."""
    query = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def progressive_search(names: DataFrame, contents: DataFrame, each: Callable[[str, DataFrame], None]) -> None:
    """Deliver name matches first, then content matches, then the end."""
    each("names", names)
    each("contents", contents)
    each("complete", names.limit(0))


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts and sums; on a stream, state is bounded by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
