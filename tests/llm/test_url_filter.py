import re
from itertools import combinations, product

from twinframe.llm import url_filter as U
from twinframe.llm.common import join_by_count

PAGES = "page_id long, url string"
LABELS = "doc_id long, quality int, toxic int"


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = re.sub("[A-Z]", lambda m: m.group().lower(), cut[1]), cut[2]
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def urls():
    out = ["http://A.Example.ORG/es/1?x=1#t", "https://example.org/en/17", "http://example.org/en/2", "http://org/x", "http://x.com/fr/1", "http://com/de/", "http://notcom/fr/1", "ftp://x.net", "http://x.org", "http://x.org?a=/es/", "no scheme", "", None, "http://a.com/fr//http://b/de/", "http://É.com/de/x", "http://u\nv.com/fr/\nz"]
    return [(i, u) for i, u in enumerate(out)]


def test_fixed_rules(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(spark.createDataFrame(urls(), PAGES), spark.createDataFrame([], LABELS)).collect()}
    for i, u in urls():
        host, path, rule, verdict = plain(u)
        assert got[i] == (host, path, rule, verdict or "allow")


def enumerated(sets, bad, min_rows, min_support=0.002, min_confidence=0.5, min_lift=1.5):
    """{antecedent: (confidence, support)} over all token sets of the labelled rows, without those that a subset makes useless."""
    total, base, rules = len(sets), len(bad) / len(sets), {}
    counts = {}
    for i, s in sets.items():
        for size in range(1, len(s) + 1):
            for part in combinations(sorted(s), size):
                n, k = counts.get(part, (0, 0))
                counts[part] = (n + 1, k + (i in bad))
    for part, (n, k) in counts.items():
        if k >= max(min_rows, min_support * total) and k / n >= min_confidence and k / n / base >= min_lift:
            rules[part] = (k / n, k / total)
    return {p: v for p, v in rules.items() if not any((q := tuple(x for x in p if x != y)) in rules and rules[q][0] >= v[0] for y in p)}


def token_table(pages):
    host, path = U.host_and_path(U.F.col("url"))
    return pages.withColumns({"h": host, "p": path}).withColumn("tokens", U.url_tokens(U.F.col("url"), U.F.col("h"), U.F.col("p")))


def test_mined_rules_match_like_enumeration(spark):
    rows = [(i, f"https://{('bad' if i % 4 == 0 else 'good') + str(i % 3)}.site.net/{('spam/x' if i % 8 == 0 else 'news')}/{i}" + ("?ref=x" if i % 5 == 0 else "")) for i in range(400)]
    labels = [(i, 0 if i % 4 == 0 and i % 12 else 1, 0) for i in range(0, 400)]
    pages, known = spark.createDataFrame(rows, PAGES).repartition(3), spark.createDataFrame(labels, LABELS)
    tokens = token_table(pages)
    rules, classes = U.mine_rules(tokens.join(known, tokens.page_id == known.doc_id).selectExpr("tokens", "quality = 0 as bad"), min_support=0.01)
    members = {}
    for r in classes.collect():
        members.setdefault(r.item, []).append(r.token)
    assert max(map(len, members.values())) > 1
    mined = {tuple(sorted(choice)): (r.confidence, r.support) for r in rules.collect() for choice in product(*[members[x] for x in r.antecedent])}
    sets = {r.page_id: set(r.tokens) for r in tokens.collect()}
    want = enumerated(sets, {i for i, q, _ in labels if q == 0}, 10, 0.01)
    assert mined.keys() == want.keys() and mined
    assert all(abs(a - b) < 1e-9 for p in want for a, b in zip(mined[p], want[p]))
    got = {r.page_id: (r.verdict, r.confidence) for r in U.judge_urls(pages, known, min_support=0.01).collect()}
    for i, s in sets.items():
        sure = [c for have, (c, _) in want.items() if s.issuperset(have)]
        assert got[i][0] == ("block" if sure else "allow") and (not sure or abs(got[i][1] - max(sure)) < 1e-9)


def test_long_templates_are_one_item(spark):
    deep = "/".join(f"seg{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    rows = [(i, f"https://a.net/{deep}/{i}" if i % 5 == 0 else f"https://b.net/p/{i}") for i in range(100)] + [(200, f"http://c.net/{deep}x"), (201, None), (202, None)]
    labels = [(i, 0 if i % 5 == 0 else 1, 0) for i in range(100)]
    pages, known = spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS)
    got = {r.page_id: (r.verdict, r.mined) for r in U.judge_urls(pages, known).collect()}
    assert all(got[i][0] == ("block" if i % 5 == 0 else "allow") for i in range(100)) and len(got[0][1]) == 41
    assert got[200][0] == "block" and len(got[200][1]) == 39 and got[201] == ("allow", None)  # a part of the template is enough


def test_hot_sets_give_the_same(spark, monkeypatch):
    rows = [(i, None if i % 3 == 0 else f"https://bad.net/{i % 2}/a" if i % 3 == 1 else f"https://good.net/{i}") for i in range(300)]
    labels = [(i, 0 if i % 3 == 1 else 1, 0) for i in range(300)]
    pages, known = spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS)
    want = sorted(map(str, U.judge_urls(pages, known).collect()))
    small = U._small_or_by_count
    monkeypatch.setattr(U, "_small_or_by_count", lambda a, b, key: small(a, b, key, 0))
    monkeypatch.setattr(U, "join_by_count", lambda *a, **k: join_by_count(*a, **{**k, "hot_rows": 5}))
    assert sorted(map(str, U.judge_urls(pages, known).collect())) == want


def test_facts_of_a_key_in_parts(spark):
    rows = [(i, f"k{min(i % 7, 3)}") for i in range(60)] + [(99, "none"), (100, None)]
    facts = [(f"k{i % 3}", i) for i in range(50)] + [("other", 1), (None, 2)]
    a, b = spark.createDataFrame(rows, "id int, key string"), spark.createDataFrame(facts, "key string, fact int")
    want = sorted((i, f) for i, k in rows for x, f in facts if k is not None and k == x)
    for part in (1, 4, 1_000):
        assert sorted((r.id, r.fact) for r in U._small_or_by_count(a, b, "key", 0, part).collect()) == want


def test_edges(spark):
    labels = spark.createDataFrame([(0, 0, 1), (0, None, None), (None, 1, 0)], LABELS)
    assert U.judge_urls(spark.createDataFrame([], PAGES), labels).collect() == []
    odd = spark.createDataFrame([(0, "http://a.net/"), (0, "http://a.net/"), (None, None)], PAGES).selectExpr("*", "1 as host", "2 as tokens", "3 as rule")
    assert U.judge_urls(odd, labels).count() == 3
