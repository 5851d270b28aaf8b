"""Command line: query a directory of files.

    python -m tessera.cli DIR [-e "SELECT ..." | -f FILE] [--format table|csv|json|jsonl] [-o FILE]

Statements and dot commands come from -e, a file, or standard input: one dot command a
line, SQL up to its semicolon.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.scalars import SCAN_SPEED, show_bytes, show_rows, show_time
from tessera.operators.aggregates import describe_table
from tessera.sources.detect import Catalog
from tessera.sources.sinks import FORMATS, lines, save

HELP = """.tables  .schema TABLE  .describe TABLE  .refresh  .format table|csv|json|jsonl  .save FILE
.timer on|off  .profile on|off  .benchmark  .comparison  .history  .clear  .help  .quit"""


class Shell:
    """Runs statements in turn and keeps the settings, the last result and the history."""

    def __init__(self, catalog: Catalog, kind: str = "table", profile: bool = False, cold: bool = False):
        self.catalog, self.kind, self.profile, self.cold = catalog, kind, profile, cold
        self.timer, self.ended = False, False
        self.history: list[tuple[str, float]] = []
        self.last: DataFrame | None = None

    def _switch(self, name: str, word: str) -> str:
        if word not in ("", "on", "off"):
            raise ValueError(f".{name} takes on or off")
        setattr(self, name, word == "on" if word else not getattr(self, name))
        return f"{name} {'on' if getattr(self, name) else 'off'}"

    def dot(self, text: str) -> DataFrame | str:
        """A dot command: a DataFrame to show, or a message."""
        word, _, rest = text.strip().rstrip(";").partition(" ")
        rest = rest.strip()
        spark = self.catalog.spark
        if word == ".tables":
            return spark.createDataFrame([(t,) for t in self.catalog.refresh()] or [], "table_name string")
        if word == ".schema":
            return spark.createDataFrame(self.catalog.table(rest).dtypes, "column_name string, column_type string")
        if word == ".describe":
            return describe_table(self.catalog.table(rest))
        if word == ".refresh":
            spark.catalog.clearCache()
            self.catalog.pinned.clear()
            self.catalog.prints.clear()
            return f"{len(self.catalog.refresh())} tables"
        if word == ".format":
            if rest not in FORMATS:
                raise ValueError(f"format is one of {', '.join(FORMATS)}")
            self.kind = rest
            return f"format {rest}"
        if word == ".save":
            if self.last is None or not rest:
                raise ValueError(".save FILE needs a result")
            save(self.last, rest, self.kind)
            return f"saved {rest}"
        if word in (".timer", ".profile"):
            return self._switch(word[1:], rest)
        if word == ".history":
            return "\n".join(f"{i + 1}  {show_time(s)}  {q}" for i, (q, s) in enumerate(self.history))
        if word in (".benchmark", ".comparison"):
            return self.compare(3 if word == ".benchmark" else 1)
        if word == ".help":
            return HELP
        if word == ".clear":
            self.last = None
            return ""
        if word == ".quit":
            self.ended = True
            return ""
        raise ValueError(f"unknown command {word}")

    def compare(self, runs: int) -> str:
        """Time the last statement again; and how long a plain scan of its input would take."""
        if self.last is None:
            raise ValueError("no statement to time")
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            rows = self.last.count()
            took.append(time.perf_counter() - began)
        size = int(str(self.last._jdf.queryExecution().optimizedPlan().collectLeaves().head().stats().sizeInBytes()))
        return f"{show_rows(rows)} rows, best of {runs}: {show_time(min(took))}; {show_bytes(size)} by a plain scan: {show_time(size / SCAN_SPEED)}"

    def run(self, text: str, output: str | None = None) -> Iterator[str]:
        """The output lines of one statement; ``output`` saves a result to a file instead."""
        text = text.strip().rstrip(";")
        if not text:
            return
        if self.cold:
            self.catalog.spark.catalog.clearCache()
        began = time.perf_counter()
        found = self.dot(text) if text.startswith(".") else self.catalog.sql(text)
        if isinstance(found, str):
            if found:
                yield found
            return
        if not text.startswith("."):
            self.last = found
        if output:
            save(found, output, self.kind)
        else:
            yield from lines(found, self.kind)
        took = time.perf_counter() - began
        self.history.append((text, took))
        if self.profile:
            found.explain("formatted")
        if self.profile or self.timer:
            print(show_time(took), file=sys.stderr)


def statements(text: str) -> Iterator[str]:
    """Dot commands by line, SQL by semicolon; quotes protect both."""
    held, quote = "", ""
    for line in text.splitlines(keepends=True):
        for i, ch in enumerate(line):
            if not held.strip() and ch == ".":
                yield line[i:].strip()
                held = ""
                break
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "'\"`":
                quote = ch
            elif ch == ";":
                if held.strip():
                    yield held.strip()
                held = ""
                continue
            held += ch
    if held.strip():
        yield held.strip()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("directory")
    p.add_argument("-e", "--execute")
    p.add_argument("-f", "--file")
    p.add_argument("-o", "--output")
    p.add_argument("--format", choices=FORMATS, default="table")
    p.add_argument("--profile", action="store_true")
    p.add_argument("--cold", action="store_true", help="drop what is cached before each statement")
    a = p.parse_args(argv)
    if a.execute:
        text = a.execute
    elif a.file:
        with open(a.file, encoding="utf-8") as f:
            text = f.read()
    else:
        text = sys.stdin.read()
    try:
        spark = spark or SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        shell = Shell(Catalog(spark, a.directory), a.format, a.profile, a.cold)
        for one in statements(text):
            for line in shell.run(one, a.output):
                print(line)
            if shell.ended:
                break
    except Exception as e:  # noqa: BLE001  any failure is the exit code
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
