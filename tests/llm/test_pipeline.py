import hashlib

import corpus_pipeline as P
from tramline.llm import pieces, substrings, tiling, weak_labels

from . import test_near_dup, test_substrings
from .corpus import SCHEMA, empty, frame, odd, texts, words


def world(spark, tmp_path):
    import random

    rng = random.Random(21)
    item = " ".join(words(rng, 40))
    rows = texts() + [(200, f"{' '.join(words(rng, 60))} {item} {' '.join(words(rng, 30))}"), (201, "Ab### cd$$$ " * 60), (202, "No no no no " * 30)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, item


def test_run_equals_a_brute_force_version(spark, tmp_path):
    rows, item = world(spark, tmp_path)
    # the classifier has its own tests; its verdicts are taken as they are
    kept = {r.doc_id for r in weak_labels.classified(frame(spark, rows)).filter("kept").collect()}
    rows = [(i, t) for i, t in rows if i in kept]
    assert 201 not in kept and 202 not in kept and 200 in kept
    rows = [(i, t) for i, t in rows if test_near_dup.brute(rows)[i][2]]
    cut = test_substrings.brute(rows)
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    expected = {i for i, _ in rows if not (cut[i][0] and cut[i][1] == cut[i][0])} - {200}
    assert set(out) == expected
    for i, r in out.items():
        assert hashlib.sha256(" ".join(test_substrings.WORD.findall(r.text or "")).encode()).hexdigest() == cut[i][2]
        assert r.lossless and r.n_tokens == len(r.ids)


def test_stages_keep_the_columns(spark, tmp_path):
    world(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString(), name


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns: what each stage keeps of them."""
    world(spark, tmp_path)
    stages = dict(P.STAGES)
    kept = {name: stage(spark, odd(spark), str(tmp_path)) for name, stage in P.STAGES}
    ids = {name: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect()) for name, df in kept.items()}
    every = sorted((r.doc_id is None, r.doc_id or 0) for r in odd(spark).collect())
    assert ids["near dedup"] == [x for x in every if x != (False, 8)]  # the copy of 4 goes, rows that repeat stay together
    assert ids["substring dedup"] == [x for x in every if x != (False, 8)]  # nothing of the copy is left
    assert ids["decontamination"] == ids["sentencepiece"] == every
    assert all(x in every for x in ids["quality classifier"])
    for name in list(stages)[:-1]:
        assert kept[name].columns == odd(spark).columns
        assert stages[name](spark, empty(spark), str(tmp_path)).collect() == []
    assert stages["sentencepiece"](spark, empty(spark), str(tmp_path)).collect() == []


def test_ids_that_repeat_with_other_texts(spark, tmp_path):
    """No text is lost with an id: what stays of each group is one of its texts."""
    world(spark, tmp_path)
    rows = test_near_dup.repeated_ids()
    kept = {(r.doc_id, r.text) for r in P.near_duplicates(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert (3, rows[0][1]) in kept and (9, rows[2][1]) in kept and (9, rows[0][1]) not in kept and (12, rows[3][1]) not in kept and (3, "") in kept
    cut = {(r.doc_id, r.n_words) for r in substrings.remove_repeats(frame(spark, [(1, "a b"), (1, "c d e")]), cells=1 << 20).collect()}
    assert cut == {(1, 2), (1, 3)}


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "near dedup", "substring dedup", "decontamination", "sentencepiece"]
    assert P.ORACLE_SQL is None and pieces and substrings and tiling and SCHEMA
