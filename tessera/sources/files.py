"""Whole-file sources and structural counts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import file_system

#: Common extensions of binary files.
BINARY = ["png", "jpg", "jpeg", "gif", "zip", "gz", "exe", "dll", "so", "dylib", "o", "a", "pdf", "bin", "class", "jar", "wasm", "mp3", "mp4", "ttf", "woff"]


def walk(spark: SparkSession, directory: str, hidden: bool = False, pattern: str = "*") -> DataFrame:
    """path, size, modified, content of all files below a directory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(directory)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return out if hidden else out.where(~F.col("path").rlike(r"/\.[^/]+(/|$)"))


def text_files(files: DataFrame) -> DataFrame:
    """Files that are not binary: by extension, then by a zero byte in the first 8 KB."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    zero = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 8192)), "(..)", "$1 ")) > 0
    return files.where(~ext.isin(BINARY) & ~zero)


def csv_structure(lines: DataFrame, column: str = "value", delimiter: str = ",") -> DataFrame:
    """Lines, delimiters and characters, without parsing."""
    c = F.col(column)
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.length(c) - F.length(F.replace(c, F.lit(delimiter), F.lit("")))).alias("n_delimiters"), F.sum(F.length(c)).cast("long").alias("n_chars"))


# --- ignore files ------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """The regular expression of an ignore pattern's glob, over a relative path."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out.append(".+")
            break
        if ch == "*":
            out.append("[^/]*")
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end]
            negated = inner[:1] in "!^"
            out.append(("[^/" if negated else "[") + re.sub(r"([\\\[&])", r"\\\1", inner[negated:]) + "]")
            i = end
        elif ch == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def ignore_rules(lines: list[tuple[str, str]]) -> list[tuple[str, bool, bool]]:
    """(regex over the whole path, ignores, directories only) of the lines of ignore files.

    ``lines`` are (directory of the file, line) in order, outer files first. A pattern with
    a slash before its end is relative to its directory, any other matches at every level
    below; the last rule that matches decides.
    """
    rules = []
    for directory, line in lines:
        text = line.rstrip("\r\n")
        while text.endswith(" ") and not text.endswith("\\ "):
            text = text[:-1]
        if not text or text.startswith("#"):
            continue
        ignores = not text.startswith("!")
        text = text if ignores else text[1:]
        only_dirs = text.endswith("/")
        text = text.rstrip("/")
        if not text:
            continue
        anywhere = "" if "/" in text else "(?:[^/]+/)*"
        base = re.escape(directory.rstrip("/")) + "/"
        rules.append((f"^{base}{anywhere}{glob_regex(text.lstrip('/'))}$", ignores, only_dirs))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool, bool]], is_dir: Column | None = None) -> Column:
    """Whether the rules ignore a path: those that match the path itself decide, else those
    that match its nearest directory that any matches. The rules are a bounded list."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    # the path, then its directories from the inside out
    levels = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("p"), (n < F.size(parts)).alias("dir")))

    def verdict(level: Column) -> Column:
        folder = level["dir"] | (is_dir if is_dir is not None else F.lit(False))
        tests = [F.when(level["p"].rlike(regex) & (folder if only_dirs else F.lit(True)), F.lit(ignores)) for regex, ignores, only_dirs in reversed(rules)]
        return reduce(lambda a, b: F.coalesce(a, b), tests)

    said = F.filter(F.transform(levels, verdict), lambda v: v.isNotNull())
    return F.coalesce(F.get(said, F.lit(0)), F.lit(False))


def drop_ignored(spark: SparkSession, files: DataFrame, directory: str, path: str = "path", name: str = ".gitignore") -> DataFrame:
    """The files that no ignore file of the directory or of those below it rules out."""
    fs, root = file_system(spark, directory)
    clean = lambda p: re.sub("^file:/+", "/", p)
    # readers of Spark skip hidden files: the listing is walked here, for the ignore files alone
    each, listed = [], fs.listFiles(root, True)
    while listed.hasNext():
        p = listed.next().getPath()
        if p.getName() == name:
            stream = fs.open(p)
            try:
                each.append((clean(p.getParent().toString()), bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))
            finally:
                stream.close()
    each.sort()
    each.sort(key=lambda x: x[0].count("/"))
    rules = ignore_rules([(d, line) for d, text in each for line in text.split("\n")])
    return files.where(~is_ignored(F.regexp_replace(path, "^file:/+", "/"), rules))
