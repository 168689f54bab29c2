"""URL filters: given host rules, and association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._job import staged

#: (verdict, rule); a rule is a host and a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The model is fitted on about so many distinct labelled URLs at most, chosen by hash.
MAX_LABELLED = 20_000
MIN_SUPPORT = 0.002
#: Labelled URLs that a rule rests on at least, however few there are.
MIN_COUNT = 4
MIN_CONFIDENCE = 0.9
_BLOCK = "=block"


def _folded(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host and path of a column; both empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(_folded(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(length, rule, verdict) of the longest rule that fits; null if none does."""
    table = F.array(*[F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit(r[r.index("/") :]).alias("path")) for v, r in rules])
    dotted = F.concat(F.lit("."), host)
    fits = F.filter(table, lambda x: dotted.endswith(F.concat(F.lit("."), x["host"])) & path.startswith(x["path"]))
    return F.array_max(fits)


def tokens(host: str, path: str) -> Column:
    """Distinct tokens of a URL: host labels by their place from the right, path parts by depth, words in either."""
    labels = F.reverse(F.split(F.col(host), "\\."))
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    deep = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(F.concat_ws("/", host, path), "[^\\p{L}\\p{N}]+"), lambda x: F.char_length(x) > 2), lambda x: F.concat(F.lit("w:"), x))
    return F.array_distinct(F.concat(placed, deep, words))


def labelled(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """(url, blocked) of the URLs that something is known of.

    The longest given rule that fits a URL labels it; without one, the label of
    the document that the URL names (``labels``: doc_id, quality, toxic; the id is the number that its second path part
    begins with): one to block if its quality is 0 or it is toxic.
    """
    host, path = host_and_path("url")
    rows = pages.select(F.col(url_col).cast("string").alias("url")).distinct().withColumn("host", host).withColumn("path", path).filter("host <> ''")
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("named")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    named = F.regexp_extract("path", "^/[^/]+/(\\d+)", 1).try_cast("long")
    both = rows.withColumn("best", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("named", named).join(marked, "named", "left")
    return both.select("url", F.coalesce(F.col("best.verdict") == "block", "bad").alias("blocked")).filter("blocked is not null")


def mined(baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, DataFrame] | None:
    """Rules that lead to ``block``, from (tokens array, blocked boolean): (items array, confidence, support), and (token, item, n).

    A rule holds for a URL with a token of each of its items.  An item stands for all tokens that
    occur in the same labelled URLs (n of them), so any of these makes the same rule, and the miner
    sees one.  Nor does it see tokens in fewer blocked URLs than a rule
    needs, or those of all URLs, which can only be a rule by themselves.  A rule is dropped
    if a part of it is a rule of no less confidence; nothing else is left out.
    All of it is tables; None without labelled URLs enough.
    """
    known = baskets.dropDuplicates(["tokens", "blocked"]).withColumn("h", F.xxhash64("tokens", "blocked"))
    share = min(1.0, max_labelled / max(1, known.count()))
    sample, _ = staged(known.filter(F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))), "baskets")
    n = sample.count()
    if n < MIN_COUNT:
        return None
    least = math.ceil(max(min_support, MIN_COUNT / n) * n)
    each = sample.select("h", "blocked", F.explode("tokens").alias("token"))
    # the URLs of a token as two sums of hashes: equal sums, equal URLs
    at = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"), F.sum(F.shiftright("h", 16)).alias("s1"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("s2")).filter(F.col("n_blocked") >= least)
    first = at.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    items, _ = staged(at.join(first, ["n", "s1", "s2"]).select("token", "item", "n", "n_blocked"), "items")
    seen = items.filter((F.col("token") == F.col("item")) & (F.col("n") < n)).select("token")
    kept = each.join(seen, "token").groupBy("h").agg(F.collect_list("token").alias("own"))
    given = sample.select("h", "blocked").join(kept, "h", "left").select(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.when(F.col("blocked"), F.array(F.lit(_BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=0.0).fit(given)
    found = model.associationRules.filter(F.array_contains("consequent", _BLOCK)).select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    whole = items.filter((F.col("token") == F.col("item")) & (F.col("n") == n)).select(F.array("item").alias("items"), (F.col("n_blocked") / n).alias("confidence"), (F.col("n_blocked") / n).alias("support"))
    sets, _ = staged(found.unionByName(whole).withColumn("size", F.size("items")), "sets")
    return _essential(sets, min_confidence), items.select("token", "item", "n")


def _essential(sets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules of a confidence that no part of them reaches.  All parts of a frequent set are frequent, so the best part is known from those an item smaller."""
    last = sets.agg(F.max("size")).first()[0] or 0
    kept = best = None
    for size in range(1, last + 1):
        now = sets.filter(F.col("size") == size)
        if best is None:
            ranked = now.withColumn("below", F.lit(0.0))
        else:
            parts = now.select("items", F.explode("items").alias("out")).select("items", F.array_remove("items", F.col("out")).alias("part"))
            below = parts.join(best.withColumnRenamed("items", "part"), "part").groupBy("items").agg(F.max("best").alias("below"))
            ranked = now.join(below, "items", "left").withColumn("below", F.coalesce("below", F.lit(0.0)))
        level, _ = staged(ranked, "level")
        best = level.select("items", F.greatest("confidence", "below").alias("best"))
        good = level.filter((F.col("confidence") >= min_confidence) & (F.col("below") < F.col("confidence"))).select("items", "confidence", "support")
        kept = good if kept is None else kept.unionByName(good)
    return kept if kept is not None else sets.select("items", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(host, path, mined_confidence) of the URLs (host, path) that a rule holds for.

    The inverted index lists each rule under the tokens of its rarest item; URLs
    meet it there, and the rule's other items are looked up in the URL's tokens.
    """
    parts = rules.withColumn("r", F.xxhash64("items")).select("r", "confidence", F.explode("items").alias("item")).join(items, "item")
    own = parts.groupBy("r", "confidence", "item", "n").agg(F.collect_set("token").alias("tokens"))
    each = own.groupBy("r", "confidence").agg(F.collect_list("tokens").alias("parts"), F.min(F.struct("n", "item", "tokens")).alias("rarest"))
    index = each.select(F.explode("rarest.tokens").alias("token"), "r")
    hashed = urls.withColumn("u", F.xxhash64("host", "path"))  # a key to carry; the rules are held against the URL itself
    near = hashed.select("u", F.explode(tokens("host", "path")).alias("token")).join(index, "token").select("u", "r").distinct()
    holds = F.forall("parts", lambda p: F.arrays_overlap(p, F.col("tokens")))
    both = near.join(each.select("r", "confidence", "parts"), "r").join(hashed, "u").withColumn("tokens", tokens("host", "path"))
    return both.filter(holds).groupBy("host", "path").agg(F.max("confidence").alias("mined_confidence"))


def judged(pages: DataFrame, known: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``id_col``, host, path, rule, verdict, mined_confidence of every row.

    ``known`` are labelled URLs (url, blocked), as labelled() makes them.  Token combinations that FP-growth
    finds in them with the given support and confidence block a URL
    that holds them all.  The longest given rule overrules them.  Without a
    rule the verdict is allow.

    A null url, or one without ``://``, has an empty host and path and no tokens.  Null labels mark
    nothing; without labels nothing is mined.  Every row is judged by itself,
    repeated ids too; equal hosts and paths are matched once.
    """
    host, path = host_and_path("_url")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url")).withColumn("host", host).withColumn("path", path).drop("_url")
    named = known.filter("blocked is not null").select(F.col("url").cast("string").alias("_url"), "blocked").withColumn("host", host).withColumn("path", path).filter("host <> ''")
    found = mined(named.select(tokens("host", "path").alias("tokens"), "blocked"), min_support, min_confidence, max_labelled)
    best = longest_rule(F.col("host"), F.col("path"), rules)
    if found is None:
        out = rows.withColumn("mined_confidence", F.lit(None).cast("double"))
    else:
        hits, _ = staged(matched(rows.select("host", "path").filter("host <> ''").distinct(), *found), "matches")
        out = rows.join(hits, ["host", "path"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("mined_confidence").isNotNull(), "block"), F.lit("allow"))
    return out.withColumn("best", best).select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "mined_confidence")
