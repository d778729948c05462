"""URL rules against plain comparison of every URL with every rule."""

import pytest
from pyspark.sql import functions as F

from taktwerk.llm import urls
from taktwerk.llm.common import table

PAGES = "page_id long, url string, host string, rule string, verdict string, key string, stack string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]


def judged(url, rules):
    host, path = parts(url)
    best = None
    for verdict, h, p in rules:
        if None not in (verdict, h, p) and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or ((-1, -1), "", ""), ((len(h), len(p)), verdict, h + p))
    return host, path, best[2] if best else None, best[1] if best else urls.DEFAULT


def pages_of(spark, links):
    return spark.createDataFrame([(i, u, "h", "r", "v", "k", "s") for i, u in links], PAGES)


def check(spark, links, rules):
    out = urls.judge_urls(pages_of(spark, links), urls.rule_table(spark, rules))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, *judged(u, rules)) for i, u in links), key=repr)


ODD = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en",
    "http://example.com?/en/", "http://badexample.com/en/", "x://a.net/es/1#q", "x://net/fr/", "x://net./fr/", "x://.net/fr/", "x://a..com/", "x://com.example/en/",
    "x://user@example.com:80/en/", "x://ex\u00c4mple.com/en/\u00e9", "x://a\nb.com/\n", "a://b://example.com/en/", "x://" + "a." * 3000 + "com/" + "p" * 9000,
]


def test_contract_rules_on_odd_urls(spark):
    links = [(i, u) for i, u in enumerate(ODD)] + [(None, ODD[6]), (3, ODD[6]), (3, ODD[6])]
    check(spark, links, urls.RULES)
    check(spark, [], urls.RULES)
    check(spark, links, ())


def test_nested_rules_of_any_kind(spark):
    rules = [("block", "com", ""), ("allow", "b.com", "/"), ("block", "b.com", "/x"), ("allow", "a.b.com", "/x/y"), ("block", "", "/"), ("block", "b.com", "/x/y/z"),
             ("allow", "c.b.com", "/"), (None, "b.com", "/q"), ("block", None, "/"), ("block", "b.com", None)]
    hosts = ["com", "b.com", "a.b.com", "x.a.b.com", "c.b.com", "d.c.b.com", "bb.com", "b.com.", "", "org"]
    check(spark, [(i, f"z://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/x", "/x/y", "/x/y/z", "/xy", "/q"))], rules)


def test_same_rule_twice_blocks(spark):
    out = urls.judge_urls(pages_of(spark, [(1, "x://a.com/")]), urls.rule_table(spark, [("allow", "com", "/"), ("block", "com", "/")]))
    assert [(r.rule, r.verdict) for r in out.collect()] == [("com/", "block")]


@pytest.mark.parametrize("inline", [0, 16, 1000])
def test_many_rules_many_ranges_and_a_hot_host(spark, monkeypatch, inline):
    monkeypatch.setattr(urls, "INLINE_PATHS", inline)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rules = [(("allow", "block")[i % 2], f"h{i % 7}.t{i % 3}" if i % 5 else f"t{i % 3}", "/" + "ab"[i % 2] * (i % 4) + str(i % 11)) for i in range(300)]
        rules += [("block", "t1", "/" + "a" * i) for i in range(12)]
        rules = list({(h, p): (v, h, p) for v, h, p in sorted(rules)}.values())
        links = [(i, f"x://{'w.' * (i % 3)}h{i % 9}.t{i % 4}/{'ab'[i % 2] * (i % 5)}{i % 12}/{i}") for i in range(600)] + [(i, "x://w.h1.t1/aaa1") for i in range(600, 900)]
        check(spark, links, rules)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_table_by_built_in_functions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = urls.judge_urls(pages)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((r.page_id, *judged(r.url, urls.RULES)) for r in pages.select("page_id", "url").collect()), key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_a_hot_range_is_dealt_to_several_tasks():
    ranges = urls._Ranges([b"a"] * 10 + [b"m"] * 80 + [b"z"] * 10, 10)
    assert ranges.cuts == [b"m", b"z"] and ranges.deals == [1, 8, 1]


def test_ranges_of_keys(spark):
    keys = sorted({bytes([65 + i % 26, 65 + i * 7 % 26]) for i in range(400)})
    ranges = urls._Ranges(keys, 50)
    got = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").select("k", ranges.range_of(F.col("k")).alias("r")).collect()
    assert all(r.r == sum(c <= bytes(r.k) for c in ranges.cuts) for r in got)
