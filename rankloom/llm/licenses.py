"""License scans by diagonal voting.

Templates are word sequences: the base phrases, which decide the base columns, and longer notices, which add labels. Words
are lower-cased (A-Z) runs of bytes that are letters, digits or not ASCII.

All two-word grams of all texts are hashed and joined by Spark to the grams of the templates. A hit at text word p of
template word q lies on the diagonal p - q. Hits are counted by document, template and diagonal; a place where a phrase
stands holds all grams of the phrase, in one run on one diagonal. Hits of a notice that lie on neighbouring diagonals,
``SHIFT`` apart at most and within ``REACH`` words, are voted together, so that words put in, left out or changed do not
end it: its score is the share of its grams found there. As the join also compares the two words, hashes only select:
every hit, and so every span, is verified.

Spark broadcasts the templates' grams if they are ``BROADCAST_GRAMS`` at most, and joins a longer list by a shuffle.

Every document also sends one mark that matches a template of its own, so one pass over the texts gives a row for each
document and its number of words. A null or empty text has no words. Rows that repeat a doc_id with the same text are
judged once and answered each; other texts of a doc_id, or a null doc_id, give a row each by their hash. An empty table
gives no rows. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The phrases of the contract, by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Notices in common use, by label.
NOTICES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
}
LEAST = 0.75  # share of a notice's grams
BROADCAST_GRAMS = 100_000
SHIFT, REACH = 3, 12

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; lower-casing by translate touches A-Z only."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _SPLIT), "")


def templates(spark: SparkSession, phrases: Mapping[str, str], notices: Mapping[str, str]) -> DataFrame:
    """gram, first, second, template, at, grams, phrase: the two-word grams of all templates, and the mark."""
    rows = [(label, text.lower().split(), True) for label, text in phrases.items()] + [(label, text.lower().split(), False) for label, text in notices.items()]
    if any(len(w) < 2 for _, w, _ in rows):
        raise ValueError("templates need two words at least")
    grams = [(w[k], w[k + 1], label, k, len(w) - 1, phrase) for label, w, phrase in rows for k in range(len(w) - 1)]
    listed = spark.createDataFrame(grams, "first string, second string, template string, at int, grams int, phrase boolean")
    mark = spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in ("first", "second", "template")], F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("grams"), F.lit(None).cast("boolean").alias("phrase"))
    table = listed.unionByName(mark).select(F.xxhash64("first", "second").alias("gram"), "*")
    return F.broadcast(table) if len(grams) <= BROADCAST_GRAMS else table.hint("merge")


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """doc, digest, n_words, place, template, at, grams, phrase: verified hits, and for each row the mark, without template."""
    cut = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("digest"), words(F.coalesce("text", F.lit(""))).alias("words"))

    def pair(a: Column, b: Column) -> Column:
        return F.struct(F.xxhash64(a, b).alias("gram"), a.alias("word"), b.alias("next"))

    pairs = F.zip_with(F.col("words"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), pair)
    none = F.lit(None).cast("string")
    # the last of the pairs has no second word: the mark's place at the end
    marked = F.concat(F.slice(pairs, F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), F.array(pair(none, none)))
    listed = cut.select("doc", "digest", F.size("words").cast("long").alias("n_words"), F.posexplode(marked).alias("place", "pair"))
    listed = listed.select("doc", "digest", "n_words", "place", "pair.*")
    found = listed.join(grams, "gram").filter(F.col("template").isNull() | ((F.col("word") == F.col("first")) & (F.col("next") == F.col("second"))))
    return found.select("doc", "digest", "n_words", F.col("place").cast("long").alias("place"), "template", "at", "grams", "phrase")


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """doc, n_words, n_base, first_word, last_word, base_labels, labels, score; labels are distinct, sorted, comma-joined."""
    found = hits(docs, templates(docs.sparkSession, phrases, notices))
    found = found.groupBy(*found.columns).agg(F.count("*").alias("copies"))  # rows that repeat have the same hits, each as often
    row = ["doc", "digest", "n_words", "copies"]
    # diagonals: the places of a phrase, the votes for a notice
    diagonal = found.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(*row, "template", "phrase", "grams", "diagonal")
    voted = diagonal.agg(F.count("at").alias("votes"), F.collect_set("at").alias("seen"), F.min("place").alias("start"), F.max("place").alias("end"))
    # neighbouring diagonals of a notice: a new group where the shift or the distance is too large
    order = Window.partitionBy(*row, "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(order) <= SHIFT) & (F.col("start") - F.lag("end").over(order) <= REACH)
    grouped = voted.withColumn("group", F.sum(F.when(near & ~F.col("phrase"), 0).otherwise(1)).over(order))
    merged = grouped.groupBy(*row, "template", "phrase", "grams", "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("held"), F.min("diagonal").alias("start")
    )
    share = merged.withColumn("share", F.col("held") / F.col("grams"))
    base = F.col("phrase") & (F.col("held") == F.col("grams"))
    label = base | (~F.col("phrase") & (F.col("share") >= LEAST))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    judged = share.groupBy(*row).agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("template"))).alias("base_labels"), joined(F.when(label, F.col("template"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
