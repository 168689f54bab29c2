"""Small corpora for the tests: invented words, copies, edits, shared passages, odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 7))) if rng.random() < 0.7 else f"w{rng.randrange(size)}" for _ in range(n)]


def texts(seed=1, n=60):
    """doc_id -> text: prose, exact copies, near-copies in chains, a passage that many share, repeated lines, short texts."""
    rng = random.Random(seed)
    out = [" ".join(words(rng, rng.randint(30, 200))) for _ in range(n)]
    base = words(rng, 120)
    for _ in range(12):  # near-copies of a base, some further off than others
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = "x" + rng.choice("abc")
        out.append(" ".join(copy))
    chain = words(rng, 150)
    for _ in range(8):  # each a little off the one before it
        chain = chain[6:] + words(rng, 6)
        out.append(" ".join(chain))
    passage = " ".join(words(rng, 60))
    for _ in range(10):
        out.append(" ".join(words(rng, 40)) + "\n" + passage + " " + " ".join(words(rng, 30)))
    out += [out[0], out[0], out[3], out[3].upper()]
    line = " ".join(words(rng, 9))
    out += ["\n".join([line] * 6), "", "   \n\t ", "one", "one two three", "a b c d e", "a b c d e f"]
    return list(enumerate(out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, null ids, clashing extra columns."""
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    rows = [(1, None), (2, ""), (3, " \n "), (4, long), (5, "tie tie tie"), (5, "tie tie tie"), (None, "no id at all here"), (None, None), (7, "İstanbul K ▁ mark ﷺ \U0001f600 end"), (8, long)]
    base = frame(spark, rows)
    from pyspark.sql import functions as F

    for name in ("kept", "score", "n", "ids", "items", "decoded", "spans", "label", "posterior", "_k", "_t", "_id", "_row", "key", "rep"):
        base = base.withColumn(name, F.lit("clash"))
    return base


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
