"""op12 against rules and classes worked out in Python."""

import re

import pytest
from pyspark.sql import functions as F

from tidewright.llm import queries, urls

NET, ORG = "http://a.net/x", "http://z.org/fr/1"
CASES = [
    # (url, html, host, path, rule, verdict)
    (None, None, "", "", None, "allow"),
    ("no scheme", '<link rel="canonical" href="http://a.net/x">', "", "", None, "allow"),
    ("", "", "", "", None, "allow"),
    ("HTTP://A.Example.NET/en/1?q#f", "", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/en", "", "example.net", "/en", "net/", "block"),
    ("http://example.net?/en/", "", "example.net", "", None, "allow"),
    ("http://xnet/", "", "xnet", "/", None, "allow"),
    ("http://net/", "", "net", "/", "net/", "block"),
    ("https://www.example.com/de/9#x", "", "www.example.com", "/de/9", "example.com/de/", "block"),
    ("http://example.com/DE/9", "", "example.com", "/DE/9", None, "allow"),
    (ORG, "", "z.org", "/fr/1", "org/fr/", "allow"),
    ("http://a.net:80/x/", "", "a.net:80", "/x/", None, "block"),  # the normal form is that of a blocked page
    (NET, "", "a.net", "/x", "net/", "block"),
    ("http://m.com/1", '<head><link rel="canonical" href="https://a.net/y"></head>', "m.com", "/1", None, "block"),  # blocked target that is no page
    ("http://m.com/2", "<LINK href='/1' REL='alternate Canonical'>", "m.com", "/2", None, "block"),  # through /1
    ("http://m.com/dir/3?q=1", '<meta http-equiv="Refresh" content="0; URL=4">', "m.com", "/dir/3", None, "block"),
    ("http://m.com/dir/4", '<meta content="1;url=\'http://m.com/2\'" http-equiv=refresh>', "m.com", "/dir/4", None, "block"),
    ("http://m.com/5", '<!-- <link rel=canonical href="http://a.net/x"> --><script>"<link rel=canonical href=http://a.net/x>"</script>', "m.com", "/5", None, "allow"),
    ("http://m.com/6", '<link rel=canonical href="#top"><link rel=canonical href="mailto:x"><link rel=canonical href="">', "m.com", "/6", None, "allow"),
    ("http://c.com/1", f'<link rel=canonical href={NET}><link rel=canonical href="{ORG}">', "c.com", "/1", None, "allow"),  # an explicit allow takes precedence
    ("http://c.com/2", '<link rel=canonical href="//c.com/1?utm_source=x&amp;utm_medium=y">', "c.com", "/2", None, "allow"),
    ("http://c.com/3", '<link rel=canonical href="?a=1&amp;b=2">', "c.com", "/3", None, "block"),  # through the next one, whose target is blocked
    ("https://c.com/3?a=1&b=2", '<link rel=canonical href="ftp://b.net/q">', "c.com", "/3", None, "block"),
    ("http://loop.com/a", '<link rel=canonical href="/b">', "loop.com", "/a", None, "allow"),
    ("http://loop.com/b", '<link rel=canonical href="/a">', "loop.com", "/b", None, "allow"),
    ("http://long.com/" + "x" * 50_000, "y" * 200_000 + '<link rel=canonical href="//a.net/x">', "long.com", "/" + "x" * 50_000, None, "block"),
]
# NET is linked from c.com/1 to an allowed address: its whole class has an explicit allow.
FREED = {"http://a.net:80/x/", "http://long.com/" + "x" * 50_000}


def _judged(spark, rows, rules=queries.RULES):
    pages = spark.createDataFrame([(i, u, h, "n", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, node string, verdict int").withColumn("a.b", F.lit(0))
    found = urls.judge(pages, rules)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(map(tuple, found.collect()))


def test_cases(spark):
    want = [(i, h, p, r, "allow" if u in FREED else v) for i, (u, _, h, p, r, v) in enumerate(CASES)]
    assert _judged(spark, [c[:2] for c in CASES]) == want


def test_a_class_without_allow_is_blocked(spark):
    own = [(u, h) for u, h, *_ in CASES if u and u not in ("http://c.com/1", "http://c.com/2")]
    verdicts = {own[r[0]][0]: r[4] for r in _judged(spark, own)}
    assert all(verdicts[u] == "block" for u in FREED) and verdicts[ORG] == "allow"


def test_repeated_rows_empty_table_and_no_rules(spark):
    assert _judged(spark, []) == []
    assert [r[4] for r in _judged(spark, [(NET, None)] * 3 + [("http://b.com/", f"<link rel=canonical href={NET}>")] * 2)] == ["block"] * 5
    assert [r[3:] for r in _judged(spark, [(NET, None)], [])] == [(None, "allow")]


def test_long_chain_and_hub(spark):
    chain = [(f"http://k.com/{i}", f"<link rel=canonical href=/{i + 1}>") for i in range(60)] + [("http://k.com/60", "<link rel=canonical href=http://q.net/>")]
    hub = [(f"http://h{i}.com/", "<link rel=canonical href=http://hub.com/>") for i in range(200)] + [("http://hub.com/", "<link rel=canonical href=http://q.net/1>")]
    assert {r[4] for r in _judged(spark, chain + hub)} == {"block"}


def test_equal_lengths_prefer_allow(spark):
    assert _judged(spark, [("http://a.io/", None)], [("allow", "io", "/"), ("block", "io", "/")])[0][4] == "allow"


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_hosts_and_paths_of_the_tables(spark, folder):
    d = f"/root/testdata/{folder}"
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op12_url_filters(spark, d).collect()}
    assert len(got) == len(rows)
    for r in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = sorted(((len(h + p), v, h + p) for v, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), reverse=True)
        own = got[r.page_id]
        assert (own.host, own.path, own.rule) == (host, path, fits[0][2] if fits else None)
        assert not fits or own.verdict == fits[0][1]
