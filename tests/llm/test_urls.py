import duckdb
from pyspark.sql import functions as F

from rowloom.llm import url_equiv

PAGES = [
    (1, "https://a.org/x", '<link rel="canonical" href="https://b.org/x">'), (2, "https://b.org/x", None), (3, "http://www.c.org/y/", '<meta http-equiv="refresh" content="0; url=https://d.net/y">'),
    (4, "https://d.net/y", ""), (5, "https://e.org/z?utm_source=f&id=3#top", "<p>"), (6, "https://E.org/z?id=3", "<p>"), (7, None, "<p>"), (8, "", None), (5, "https://e.org/z?utm_source=f&id=3#top", "<p>"),
    (None, "https://f.org", '<link href="/g" rel=canonical>'), (9, "https://f.org/g", None), (10, "https://a.org/x/index.html", None), (11, "https://bad.org/1", '<link rel="canonical" href="https://good.org/1">'),
]
RULES = [("host", "b.org", "block"), ("host", "d.net", "block"), ("url", "https://c.org/y", "allow"), ("host", "bad.org", "block"), ("host", "bad.org", "block"), ("host", None, "block"), ("host", "nowhere", "allow")]


def decide(spark, pages=PAGES, rules=RULES):
    p = spark.createDataFrame([(*x, "r", 3) for x in pages], "page_id long, url string, html string, root string, aliases int")
    return url_equiv.decide(p, spark.createDataFrame(rules, "kind string, value string, action string"))


def test_blocks_spread_and_allows_win(spark):
    rows = decide(spark).collect()
    assert len(rows) == len(PAGES)
    got = {r["page_id"]: r["decision"] for r in rows}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "none", 6: "none", 7: "none", 8: "none", None: "none", 9: "none", 10: "block", 11: "block"}
    root = {r["page_id"]: r["root"] for r in rows}
    assert root[1] == root[2] == root[10] and root[3] == root[4] and root[5] == root[6] and root[None] == root[9]
    assert root[7] is None
    assert {r["aliases"] for r in rows if r["page_id"] in (7, 8)} == {0}


def test_long_chain_of_redirects(spark):
    chain = [(i, f"https://h{i:02}.org/p", f'<link rel="canonical" href="https://h{i + 1:02}.org/p">') for i in range(40)]
    rows = decide(spark, chain, [("host", "h40.org", "block")]).collect()
    assert {r["decision"] for r in rows} == {"block"}
    assert {r["aliases"] for r in rows} == {41}


def test_empty(spark):
    assert decide(spark, PAGES[:0] or [(1, "x", None)]).count() == 1
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_equiv.decide(empty, url_equiv.default_rules(spark)).isEmpty()
    none = decide(spark, rules=[("host", None, None)])
    assert {r["decision"] for r in none.collect()} == {"none"}


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(p) for p in PAGES])
    p = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    names = ["page_id", "url", "root", "aliases", "decision"]
    got = url_equiv.decide(p, url_equiv.default_rules(spark)).select(*names).collect()
    want = con.sql(url_equiv.ORACLE_SQL).select(*names).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_normal_form(spark):
    urls = ["http://WWW.A.org:80/x/?utm_a=1&b=2&ref=3#f", "https://a.org", "https://a.org/index.html?gclid=1", " https://a.org/x// "]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r["n"] for r in df.select(url_equiv.normal_url(F.col("u")).alias("n")).collect()] == ["https://a.org/x?b=2", "https://a.org", "https://a.org", "https://a.org/x"]


ODD_LINKS = [
    ('<link rel="canonical" href="//b.example/y">', "https://b.example/y"), ("<meta http-equiv='refresh' content=\"0; url='https://b.example/y'\">", "https://b.example/y"),
    ('<meta content="5;URL = https://b.example/y" http-equiv=refresh>', "https://b.example/y"), ("<LINK HREF='../y?a=1&amp;b=2' REL='alternate canonical'>", "https://a.example/y?a=1&b=2"),
    ("<link\n rel=canonical\n href=y>", "https://a.example/dir/y"), ('<meta http-equiv="Refresh" content="0,url=/z">', "https://a.example/z"), ('<link rel="canonical" href="?p=2">', "https://a.example/dir/page?p=2"),
    ('<link rel="canonical" href="./a/../b/./c">', "https://a.example/dir/b/c"), ('<link rel="canonicals" href="/no">', None), ('<link rel="canonical" href="mailto:x@y.org">', None), ('<link rel="canonical" href="">', None),
    ('<meta http-equiv="refresh" content="30">', None), ('<a rel="canonical" href="/no">', None), ('<link data-rel="canonical" href="/no">', None), ('<link rel="canonical" data-href="/no">', None), ("<link rel=canonical", None),
]


def test_targets_of_every_form(spark):
    for html, want in ODD_LINKS:
        pages = spark.createDataFrame([(1, "https://a.example/dir/page?q=1#f", html)], "page_id long, url string, html string")
        assert [r["v"] for r in url_equiv.page_targets(pages).collect()] == ([] if want is None else [want]), html


def test_all_targets_of_a_page_count(spark):
    html = '<link rel="canonical" href="https://x.org/1"><meta http-equiv="refresh" content="0;url=https://x.org/2"><link rel="canonical" href="https://x.org/3">'
    pages = spark.createDataFrame([(1, "https://a.org/p", html)], "page_id long, url string, html string")
    assert {r["v"] for r in url_equiv.page_targets(pages).collect()} == {f"https://x.org/{i}" for i in (1, 2, 3)}


def test_odd_links_same_as_sql(spark):
    pages = [(i, f"https://a.example/dir/page{i}?q=1#f", html.replace("b.example", "x.example.net")) for i, (html, _) in enumerate(ODD_LINKS)]
    pages += [(50, None, ODD_LINKS[0][0]), (None, "https://a.example/dir/page1", None), (51, "not a url", '<link rel="canonical" href="/x">'), (51, "", ""), (52, "https://a.example", '<link rel="canonical" href="x/y">'), (53, "HTTP://A.example/UP", "<p>" * 50_000 + '<link rel="canonical" href="https://a.example/dir/y">')]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(p) for p in pages])
    p = spark.createDataFrame([(*x, "v", "u", "tag") for x in pages], "page_id long, url string, html string, v string, U string, tag string")
    names = ["page_id", "url", "root", "aliases", "decision"]
    got = url_equiv.decide(p, url_equiv.default_rules(spark)).select(*names).collect()
    want = con.sql(url_equiv.ORACLE_SQL).select(*names).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r["decision"] == "block" for r in got) >= 3
