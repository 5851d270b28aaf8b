"""Result formats: padded table, CSV, JSON array, JSON lines, and saving them."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import show_float

FORMATS = ("table", "csv", "json", "jsonl")


def cell(value) -> str:
    if value is None:
        return ""
    return show_float(value) if isinstance(value, float) and abs(value) < 1e15 else str(value)


def lines(df: DataFrame, kind: str = "table") -> Iterator[str]:
    """The lines of a result. All but the table are streamed partition by partition."""
    names = df.columns
    if kind == "table":
        rows = [[cell(v) for v in r] for r in df.toLocalIterator()]
        widths = [max(len(n), *(len(r[i]) for r in rows)) if rows else len(n) for i, n in enumerate(names)]
        pad = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip()
        yield pad(names)
        yield "-+-".join("-" * w for w in widths)
        yield from map(pad, rows)
        yield f"({len(rows)} row{'' if len(rows) == 1 else 's'})"
    elif kind == "csv":
        for r in [names], df.toLocalIterator():
            for row in [r[0]] if r == [names] else r:
                out = io.StringIO()
                csv.writer(out, lineterminator="").writerow([v if isinstance(v, str) else cell(v) for v in row])
                yield out.getvalue()
    else:
        objects = (json.dumps(r.asDict(True), default=str, ensure_ascii=False) for r in df.toLocalIterator())
        if kind == "jsonl":
            yield from objects
        else:
            yield "["
            before = None
            for o in objects:
                if before is not None:
                    yield before + ","
                before = o
            if before is not None:
                yield before
            yield "]"


def save(df: DataFrame, path: str, kind: str) -> None:
    """Write one local file, for results meant for people."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in lines(df, kind))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Distributed write to a directory."""
    if kind == "csv":
        df.write.csv(path, header=True)
    elif kind in ("json", "jsonl"):
        df.write.json(path)
    else:
        df.write.parquet(path)


def to_jsonl(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def to_json_array(df: DataFrame, group: str, order: str) -> DataFrame:
    """For each group its rows as one JSON array."""
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (order, group)])))
    return df.groupBy(group).agg(F.to_json(rows).alias("json"))
