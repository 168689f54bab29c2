import itertools
import random
import re

from tramline.llm import urls


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(r), r, v) for v, r in urls.RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits)[1:] if fits else None


CASES = [None, "", "no scheme", "http://", "https://A.Example.COM/en/1?x#y", "http://www.example.com/en/", "http://x.www.example.com/en/a", "http://example.com", "http://example.com?/en/", "ftp://b.net/es/1", "http://net/fr/",
         "http://notnet/fr/", "http://a.org/x://y/z", "http://ÉA.net/es/é", "x://y.com/#z", "http://a.com//en/"]


def pages(spark, cases):
    return spark.createDataFrame([(i, u, "h", "clash", "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, host string, verdict string")


def known(spark, rows=()):
    return spark.createDataFrame(list(rows), "url string, blocked boolean")


def spelled(found):
    """Mined rules with their items spelled out: tokens -> confidence."""
    rules, items = found
    members = {}
    for r in items.collect():
        members.setdefault(r.item, []).append(r.token)
    return {frozenset(own): r.confidence for r in rules.collect() for own in itertools.product(*[members[i] for i in r["items"]])}


def test_rules_equal_brute_force(spark):
    got = {r.page_id: r for r in urls.judged(pages(spark, CASES), known(spark)).collect()}
    assert len(got) == len(CASES)
    for i, u in enumerate(CASES):
        host, path, rule = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule[0] if rule else None), u
        assert got[i].verdict == (rule[1] if rule else "allow")


def test_mined_combinations_block(spark):
    rng = random.Random(3)
    cases, bad = [], []
    for i in range(400):
        spam, shop = rng.random() < 0.5, rng.random() < 0.5
        cases.append(f"http://{'pills' if spam else 'garden'}{rng.randrange(9)}.example.org/{'buy' if shop else 'read'}/{i}")
        bad.append(spam and shop)  # only both together
    hosts = [c.replace("pills", "pills.").replace("garden", "garden.") for c in cases]
    labels = known(spark, [*zip(hosts, bad, strict=True), (None, True), ("nothing", True), (hosts[0], None)])
    got = {r.page_id: r for r in urls.judged(pages(spark, hosts), labels, min_confidence=0.95).collect()}
    assert [got[i].verdict == "block" for i in range(400)] == bad


def test_redundant_rules_are_dropped(spark):
    rows = spark.createDataFrame([(["a", "b", f"x{i}"], True) for i in range(30)] + [(["c", f"y{i}"], False) for i in range(30)], "tokens array<string>, blocked boolean")
    assert set(spelled(urls.mined(rows))) == {frozenset("a"), frozenset("b")}


def test_empty(spark):
    assert urls.judged(pages(spark, []), known(spark)).collect() == []


def brute_rules(rows, min_support, min_confidence, most=99):
    """All rules to block by enumeration, without those that have a part of no less confidence."""
    least = max(min_support * len(rows), urls.MIN_COUNT)
    tokens = [t for t in sorted({t for own, _ in rows for t in own}) if sum(b for own, b in rows if t in own) >= least]
    conf = {}
    for k in range(1, min(most, len(tokens)) + 1):
        for own in map(frozenset, itertools.combinations(tokens, k)):
            hits = [blocked for have, blocked in rows if own <= set(have)]
            if sum(hits) >= least and sum(hits) / len(hits) >= min_confidence:
                conf[own] = sum(hits) / len(hits)
    return {own: c for own, c in conf.items() if not any(part < own and conf[part] >= c for part in conf)}


def test_rules_of_long_baskets_equal_brute_force(spark):
    rng = random.Random(8)
    rows = set()
    for i in range(120):
        own = ["every", "too", *(t for t in "abcdefg" if rng.random() < 0.8), f"x{i}"]
        own += ["m", "n"] * (rng.random() < 0.3)
        rows.add((tuple(own), ("m" in own and rng.random() < 0.9) or rng.random() < 0.2))
    rows = sorted(rows)
    got = spelled(urls.mined(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), 0.09, 0.6))
    expected = brute_rules([([t for t in own if t[0] != "x"], blocked) for own, blocked in rows], 0.09, 0.6)
    assert got == expected and frozenset("m") in got


def test_rare_tokens_of_long_urls_block(spark):
    """The generic tokens of these URLs are more than ten and all more frequent than the one that tells."""
    cases = [f"http://{'pills' if i % 4 == 0 else f'shop{i}'}.www.blog.example.com/en/read/page/{i}.html" for i in range(80)]
    labels = known(spark, [(c, i % 4 == 0) for i, c in enumerate(cases)])
    got = {r.page_id: r for r in urls.judged(pages(spark, [*cases, "http://pills.org/"]), labels).collect()}
    assert [got[i].mined_confidence for i in range(80)] == [None if i % 4 else 1.0 for i in range(80)]
    assert (got[80].verdict, got[80].mined_confidence) == ("block", 1.0)


def brute_tokens(url):
    host, path, _ = brute(url)
    parts = [x for x in path.split("/") if x]
    words = [x for x in re.split(r"[^\w]+|_", host + "/" + path) if len(x) > 2]
    return {f"h{i}:{x}" for i, x in enumerate(reversed(host.split(".")))} | {f"p{i}:{x}" for i, x in enumerate(parts)} | {f"w:{x}" for x in words}


def test_mined_verdicts_equal_brute_force(spark):
    rng = random.Random(12)
    cases = [f"https://{rng.choice(['a', 'bb', 'ccc'])}.{rng.choice(['x', 'yy', 'shop'])}.{rng.choice(['org', 'info'])}/{rng.choice(['en', 'fr', 'es'])}/{rng.randrange(9000)}{rng.choice(['', '.html', '?q=1'])}" for _ in range(300)]
    told = {c: ("shop" in c and "/fr" in c) or rng.random() < 0.1 for c in cases[:200]}
    rules = brute_rules([(sorted(own), b) for own, b in {(frozenset(brute_tokens(c)), b) for c, b in told.items()}], 0.05, 0.7, most=4)
    got = {r.page_id: r for r in urls.judged(pages(spark, cases), known(spark, told.items()), min_support=0.05, min_confidence=0.7).collect()}
    assert rules
    for i, c in enumerate(cases):
        best = max((conf for own, conf in rules.items() if own <= brute_tokens(c)), default=None)
        assert (got[i].mined_confidence is None) == (best is None), c
        assert best is None or abs(got[i].mined_confidence - best) < 1e-12
        assert got[i].verdict == ("block" if best is not None else "allow")


def test_labels_are_the_rules_and_the_named_documents(spark):
    cases = ["http://a.example.com/en/7", "http://www.example.com/en/7", "http://a.org/en/7?x", "http://a.org/en/8.html", "http://a.org/en/9", "http://a.org/x", None, "http://b.net/es/8"]
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 0), (8, None, None), (9, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.url: r.blocked for r in urls.labelled(pages(spark, cases), labels).collect()}
    assert got == {cases[0]: True, cases[1]: False, cases[2]: True, cases[3]: False, cases[7]: True}


def test_odd_rows(spark):
    """Nulls, repeated ids and rows, very long urls, clashing columns."""
    long = "http://h.org/" + "/".join(f"p{i}" for i in range(20_000))
    cases = [None, long, long, "", "http://x.com/a"]
    rows = pages(spark, cases).unionByName(spark.createDataFrame([(1, "http://b.net/fr/1", None, "x", None), (None, "http://b.net/fr/1", None, None, None)], "page_id long, url string, html string, host string, verdict string"))
    out = urls.judged(rows, known(spark, [(long, True), (None, None)] + [(f"http://q{i}.org/", True) for i in range(8)])).collect()
    assert len(out) == 7 and sum(r.rule == "net/fr/" for r in out) == 2
    assert {r.verdict for r in out if r.host == "h.org"} == {"block"}
