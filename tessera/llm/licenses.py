"""License scan by diagonal voting, in DataFrame operations only.

Every rolling word 2-gram of every document is hashed and joined with the 2-grams of the
templates (license notices and phrases). A match at document word i and template word p
votes for the diagonal i - p. Votes are counted by diagonal, neighbouring diagonals of a
template are merged into one span, and every vote is verified against the document's words.

Words are runs of ASCII letters and digits and of all characters above ASCII, with A-Z
lower-cased. Phrase places (base) are exact: all of a phrase's 2-grams on one diagonal,
and the same words there. A notice found with at least ``share`` of its words adds its
label, unless an overlapping notice is found more fully; the score is the largest share of a template found (1 for any base place).

Defined results: a null text is empty; doc_id may be null or repeated (rows are told
apart by id and text, equal rows have equal results); documents without a match have score 0 and empty labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Stash, text_column

#: Phrases of the base labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license notices that add labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "all rights reserved": "all-rights-reserved",
}
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_column(text):
    """The words of a text. Only two characters above ASCII lower-case into ASCII letters;
    they are swapped for another letter first, so that lower() is A-Z's own."""
    plain = F.regexp_replace(text, "[Kİ]", "ĸ")
    return F.filter(F.split(F.lower(plain), _GAP), lambda w: w != "")


def _literals(spark, rows: list[dict]) -> DataFrame:
    """A table of a few fixed rows, made of literals by the JVM alone."""
    return spark.range(1).select(F.explode(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])).alias("r")).select("r.*")


#: Hash of the row that stands for the document itself, so that each document joins.
_SELF = 0


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, share: float = 0.8, reach: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One pass over the texts: 2-grams whose hash no template has are left out as they are
    made, the others carry their two words into a broadcast join with the templates (a few
    hundred rows, given as literals), which also compares the words, so only matches and
    one row for each document are shuffled.
    """
    spark = docs.sparkSession
    listed = [*((t, n, True) for t, n in (PHRASES if phrases is None else phrases).items()), *((t, n, False) for t, n in (NOTICES if notices is None else notices).items())]
    templates = _literals(spark, [{"template": F.lit(i), "label": F.lit(label), "template_words": F.array(*map(F.lit, text.split())), "base": F.lit(base)} for i, (text, label, base) in enumerate(listed)])
    # rows are told apart by their content: equal rows have equal results
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_column()).alias("text"))
    base = docs.select(row.alias("row"), words_column(text_column()).alias("words"))

    places = [(i, p, *text.split()[p : p + 2]) for i, (text, *_) in enumerate(listed) for p in range(len(text.split()) - 1)]
    empty = F.lit(None).cast("string")
    template_grams = _literals(
        spark,
        [{"h": F.lit(_SELF).cast("long"), "template": F.lit(-1), "p": F.lit(0), "t1": empty, "t2": empty}]
        + [{"h": F.xxhash64(F.lit(a), F.lit(b)), "template": F.lit(i), "p": F.lit(p), "t1": F.lit(a), "t2": F.lit(b)} for i, p, a, b in places],
    )
    known = sorted({(a, b) for *_, a, b in places})
    pairs = F.expr("transform(sequence(0, size(words) - 2), i -> struct(i as i, xxhash64(words[i], words[i + 1]) as h, words[i] as w1, words[i + 1] as w2))")
    # (place, hash, two words); place -1 stands for the document
    itself = F.array(F.struct(F.lit(-1).alias("i"), F.lit(_SELF).cast("long").alias("h"), empty.alias("w1"), empty.alias("w2")))
    matched = F.filter(pairs, lambda g: g["h"].isin(*[F.xxhash64(F.lit(a), F.lit(b)) for a, b in known])) if known else None
    grams = F.when(F.size("words") > 1, F.concat(itself, matched)).otherwise(itself) if known else itself
    met = (
        base.select("row", F.size("words").cast("long").alias("n_words"), F.explode(grams).alias("g"))
        .select("row", "n_words", "g.*")
        .join(F.broadcast(template_grams), "h")
        .where("template = -1 and i = -1 or w1 = t1 and w2 = t2")
        .select("row", "n_words", "template", "p", (F.col("i") - F.col("p")).alias("diagonal"))
    )
    votes = Stash(met.groupBy("row", "n_words", "template", "diagonal").agg(F.count("*").alias("rows"), F.collect_set("p").alias("ps"))).df
    named = votes.join(F.broadcast(templates), "template")

    # a phrase stands where all of its 2-grams lie on one diagonal
    places = (
        named.where("base and size(ps) = size(template_words) - 1")
        .groupBy("row")
        .agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("found"))
    )
    # neighbouring diagonals (an inserted or missing word or two) become one span, whose
    # verified words are the template words that its 2-grams cover
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    spans = (
        named.where("not base")
        .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > reach).cast("int"))
        .withColumn("span", F.coalesce(F.sum("new").over(by_diagonal), F.lit(0)))
        .groupBy("row", "template", "label", "template_words", "span")
        .agg(F.flatten(F.collect_list("ps")).alias("ps"), F.min(F.col("diagonal") + F.array_min("ps")).alias("start"), F.max(F.col("diagonal") + F.array_max("ps") + 2).alias("end"))
        .select("row", "label", "start", "end", F.size("template_words").alias("words"), F.expr("size(array_distinct(concat(ps, transform(ps, p -> p + 1)))) / size(template_words)").alias("share"))
        .where(F.col("share") >= share)
    )
    better = "t.share > s.share or t.share = s.share and t.words > s.words"
    notices_found = spans.groupBy("row").agg(F.collect_list(F.struct("label", "start", "end", "words", "share")).alias("notices")).select(
        "row",
        # of notices that overlap, the one found more fully stands, then the longer
        F.expr(f"filter(notices, s -> not exists(notices, t -> t.start < s.end and s.start < t.end and ({better})))").alias("notices"),
    )
    each = votes.where("template = -1").select("row", "n_words", "rows")
    place, notice = places.withColumnRenamed("row", "row1"), notices_found.withColumnRenamed("row", "row2")
    return (
        each.join(place, F.col("row").eqNullSafe(F.col("row1")), "left")
        .join(notice, F.col("row").eqNullSafe(F.col("row2")), "left")
        .withColumn("more", F.coalesce(F.expr("transform(notices, s -> s.label)"), F.array().cast("array<string>")))
        .withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
        .withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
        .select(
            "row.doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).alias("n_base"),
            F.col("first_word").cast("long"),
            F.col("last_word").cast("long"),
            F.array_join(F.array_sort("found"), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("found", "more")), ",").alias("labels"),
            F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce(F.expr("array_max(transform(notices, s -> s.share))"), F.lit(0.0))).cast("double").alias("score"),
        )
    )
