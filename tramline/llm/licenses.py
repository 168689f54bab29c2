"""License scans by diagonal voting: k-gram hits of templates, summed by offset, merged and verified. DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .license_texts import TEXTS

GRAM = 3
#: A template is found if this share of its words agrees on one merged diagonal, and this share of the span's words with it.
COVERAGE = 0.8
#: Offsets this near each other are one diagonal (words put in or left out).
NEAR = 2
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: phrase -> label; places of whole phrases are the base labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
def _folded(text: Column) -> Column:
    """A-Z lower-cased.  lower() differs in what matters here only where it makes ASCII letters of others."""
    odd = text.rlike("[\\u0130\\u212A]")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def words_of(text: str) -> list[str]:
    """A template's words, taken as those of the documents."""
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEXTS, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """License labels of every row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Every ``GRAM``-word hash of every text is joined to the templates' hashes;
    hits are checked word by word, and vote for (template, text offset - template
    offset).  Diagonals at most NEAR apart merge.  A merged one is verified as a span, from its first
    agreeing word to its last: ``coverage`` of the template's words must agree in it, and as
    large a share of its own words; then it labels the text.
    A phrase counts where one diagonal holds all its k-grams.  score is the
    largest share of a template that agrees.  A template's label is its name up to a slash.
    spans (template, start, end, share) are those of the verified templates: of
    overlapping ones of a template all that verify.

    The template table is a constant of this package or an argument, so its size is bounded;
    it is broadcast, and its hashes cut the texts' before they become rows.  Null or empty texts have no words.  Each input row is
    judged by itself, repeated ids too.  Phrases need GRAM words or more.
    """
    spark = docs.sparkSession
    listed = [(0, label, p, p.split()) for p, label in phrases.items()] + [(1, name.partition("/")[0], name, words_of(text)) for name, text in templates.items()]
    if any(len(words) < GRAM for *_, words in listed):
        raise ValueError(f"phrases need {GRAM} words")
    grams = [(t, kind, label, name, len(words), i, words[i : i + GRAM]) for t, (kind, label, name, words) in enumerate(listed) for i in range(len(words) - GRAM + 1)]
    plain = spark.createDataFrame(grams, "t int, kind int, label string, name string, m int, j int, gram array<string>")
    seeds = plain.withColumn("h", F.xxhash64(*[F.get("gram", F.lit(i)) for i in range(GRAM)]))
    known = sorted({r.h for r in seeds.select("h").collect()})  # a bounded table: a hash a template word

    words = F.array_remove(F.split(_folded(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), SEPARATORS), "")
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), words.alias("w"))
    rolling = F.transform("w", lambda x, i: F.struct(i.alias("p"), F.xxhash64(x, *[F.get("w", i + n) for n in range(1, GRAM)]).alias("h")))
    near = F.transform(F.filter(rolling, lambda x: x["h"].isin(known)), lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"), F.slice("w", x["p"] + 1, GRAM).alias("own")))
    placed = rows.select("_id", "_row", F.size("w").alias("n_words"), F.explode_outer(near).alias("x")).select("_id", "_row", "n_words", "x.p", "x.h", "x.own")
    held = placed.join(F.broadcast(seeds), (placed["h"] == seeds["h"]) & (placed["own"] == seeds["gram"]), "left")

    # votes of each diagonal: a row per document, template and offset
    votes = held.groupBy("_id", "_row", "n_words", "t", "kind", "label", "name", "m", (F.col("p") - F.col("j")).cast("long").alias("d")).agg(F.count("j").alias("votes"), F.collect_set("j").alias("js"))
    near = W.partitionBy("_row", "t").orderBy("d").rangeBetween(0, NEAR)
    both = votes.withColumn("hits", F.collect_list(F.struct("d", "js")).over(near))
    covered = F.array_distinct(F.flatten(F.flatten(F.transform("hits", lambda x: F.transform(x["js"], lambda j: F.sequence(j, j + GRAM - 1))))))
    inside = F.array_distinct(F.flatten(F.flatten(F.transform("hits", lambda x: F.transform(x["js"], lambda j: F.sequence(x["d"] + j, x["d"] + j + GRAM - 1))))))
    merged = both.withColumn("agree", F.size(covered)).withColumn("inside", inside).withColumn("share", F.when(F.col("t").isNotNull(), F.col("agree") / F.col("m")).otherwise(F.lit(0.0)))
    merged = merged.withColumn("start", F.array_min("inside")).withColumn("end", F.array_max("inside") + 1)
    base = (F.col("kind") == 0) & (F.col("votes") == F.col("m") - GRAM + 1)  # the diagonal holds the whole phrase
    method = (F.col("kind") == 1) & (F.col("share") >= coverage) & (F.size("inside") >= coverage * (F.col("end") - F.col("start")))
    span = F.struct(F.col("name").alias("template"), "start", "end", "share")
    out = merged.groupBy("_id", "_row", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("d"))).alias("first_word"),
        F.max(F.when(base, F.col("d"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(base | method, F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_set(F.when(method, span))).alias("spans"),
    )
    return out.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
