import numpy as np
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tramline.llm import _text as T
from tramline.llm import pieces

from .corpus import empty, frame, odd, texts

CASES = ["", " ", "a", "  two  spaces ", "tab\tnew\nline\n\n", "▁own▁ mark", "naïve Straße ﷺ 漢字 \U0001f600", "x" * 300, "aaaa" * 50 + " b", "1234567890", "<0x41> <s> </s>", "\r\n;\r\n", "word " * 40]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.default_model())


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def split(ids, count):
    return np.split(ids, np.cumsum(count)[:-1])


def test_without_dropout_it_equals_the_library(vocab, model):
    cases = [t for t in CASES + [t for _, t in texts()] if "▁" not in t]
    got = split(*pieces.encode_many(vocab, cases, np.zeros(len(cases), np.uint64), rate=0.0))
    for t, ids in zip(cases, got, strict=True):
        assert ids.tolist() == (model.encode(t) if t else []), t


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_round_trip(vocab, rate):
    got = split(*pieces.encode_many(vocab, CASES, np.arange(len(CASES), dtype=np.uint64), rate=rate))
    for t, ids in zip(CASES, got, strict=True):
        assert pieces.decode(vocab, ids) == t


def one_by_one(vocab, text, key, rate, seed):
    """Every occurrence of a word on its own, by the heap, without shared work."""
    code = [pieces.MARK] + [pieces.OWN_MARK if c == "▁" else pieces.MARK if c == " " else ord(c) for c in text]
    cuts = [0] + [i for i in range(1, len(code)) if code[i] == pieces.MARK != code[i - 1] or (vocab.cut_lines and 10 in (code[i], code[i - 1]))]
    salt = T.mix(np.array([key], np.uint64) ^ T.mix(np.array([seed], np.uint64)))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(code)], strict=True):
        own = np.array(code[a:b])
        plain = T.mix((T.mix(own.astype(np.uint64) + np.uint64(1)) * T.powers(0x9E3779B97F4A7C15, b - a)).sum(dtype=np.uint64) + np.array([b - a], np.uint64))
        word = int(T.mix(plain ^ T.mix(salt + np.uint64(a)))[0])
        ids, starts = pieces.merge_one(vocab, vocab.initial[own].tolist(), word, rate)
        for i, s in zip(ids, starts, strict=True):
            c = "▁" if own[s] == pieces.OWN_MARK else chr(own[s])
            out += [i] if 0 <= i < vocab.size else vocab.bytes_[list(c.encode())].tolist()
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.4, 1.0])
def test_shared_work_changes_nothing(vocab, rate):
    cases = [t for t in CASES if t] + [t for _, t in texts()][:30] + ["the same words the same words " * 60]
    keys = np.arange(len(cases), dtype=np.uint64) * np.uint64(977)
    got = split(*pieces.encode_many(vocab, cases, keys, rate, 5))
    for t, k, ids in zip(cases, keys.tolist(), got, strict=True):
        assert ids.tolist() == one_by_one(vocab, t, k, rate, 5), t


def test_occurrences_of_a_word_differ(vocab):
    t = "transportation " * 400
    ids, _ = pieces.encode_many(vocab, [t], np.zeros(1, np.uint64), 0.1, 1)
    words, own = set(), []
    for i in ids.tolist():
        if vocab.blob[vocab.offsets[i]] == 0x20 and own:
            words.add(tuple(own))
            own = []
        own.append(i)
    assert len(words) > 20


def test_a_script_without_blanks(vocab):
    rng = np.random.default_rng(4)
    t = "".join(chr(c) for c in rng.integers(0x3041, 0x3097, 40_000))
    ids, _ = pieces.encode_many(vocab, [t], np.zeros(1, np.uint64), 0.1, 1)
    assert pieces.decode(vocab, ids) == t


def test_seeds_and_keys_vary_the_segmentation(vocab):
    t = [" ".join(x for _, x in texts())[:4000]]
    encode = lambda v, seed, rate=0.2: pieces.encode_many(vocab, t, np.array([v], np.uint64), rate, seed)[0].tolist()
    assert encode(0, 1) == encode(0, 1)
    assert encode(0, 1) != encode(0, 2) and encode(0, 1) != encode(1, 1)
    assert len(encode(0, 1, 0.0)) < len(encode(0, 1, 0.2)) < len(encode(0, 1, 1.0))


def test_the_agenda_and_the_rounds_agree(vocab, monkeypatch):
    t = [x for _, x in texts()]
    v = np.arange(len(t), dtype=np.uint64) % 3
    many = pieces.encode_many(vocab, t, v, 0.3)
    monkeypatch.setattr(pieces, "LONG", 0)
    one = pieces.encode_many(vocab, t, v, 0.3)
    assert (many[0] == one[0]).all() and (many[1] == one[1]).all()


def test_neighbours_and_partitions_don_t_matter(spark):
    docs = frame(spark, texts())
    key = lambda df: {r.doc_id: r.ids_sha256 for r in df.collect()}
    a, b = pieces.digests(docs.repartition(7)), pieces.digests(docs.coalesce(1))
    assert key(a) == key(b)
    assert all(r.lossless for r in a.collect())


def test_odd_rows(spark):
    rows = odd(spark)
    out = pieces.decoded(pieces.encode(rows)).collect()
    assert len(out) == 10
    assert all(r.decoded == (r.text or "") for r in out)
    assert all(r.label == "clash" for r in out)
    assert pieces.digests(empty(spark)).collect() == []


@given(st.lists(st.text(max_size=60), max_size=8), st.floats(0, 1), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_any_text_round_trips(vocab, cases, rate, seed):
    got = pieces.encode_many(vocab, cases, np.arange(len(cases), dtype=np.uint64), rate, seed)
    parts = split(*got) if cases else []
    for t, ids in zip(cases, parts, strict=True):
        assert pieces.decode(vocab, ids) == t
