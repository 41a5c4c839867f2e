import json

from rowloom.operators import frontier
from rowloom.sources import pages as P
from rowloom.sources.markup import css, parse, select, xpath


def ld(*things):
    return "<html><body>" + "".join(f'<script type="application/ld+json">{json.dumps(x) if not isinstance(x, str) else x}</script>' for x in things) + "</body></html>"


def rows(html, country="Canada"):
    return P.page_records(html, "https://e.org/p", country)


def test_structured_data(spark):
    clinic = {"address": dict(addressCountry="Canada", addressLocality="Toronto", streetAddress="1 A St"), "name": "Northside Occupational Health", "@type": "MedicalClinic"}
    df = spark.createDataFrame([("https://e.org/p", ld(clinic, "{broken"), "Canada"), ("https://e.org/q", None, None)], "url string, html string, country string")
    (row,) = P.extract_records(df, run_key="test-run").collect()
    assert (row["name"], row["country"], row["crawlRunKey"], row["type"], row["city"]) == ("Northside Occupational Health", "Canada", "test-run", "provider_candidate", "Toronto")


def test_structured_shapes():
    assert rows(ld({"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Hospital", "name": "H"}}]})) == []
    (h,) = rows(ld({"@type": "ItemList", "itemListElement": [{"@type": "Hospital", "name": "H"}]}), "")
    assert (h["name"], h["country"]) == ("H", "")
    (p,) = rows(ld({"@graph": [{"@type": ["Physician", "LocalBusiness"], "name": "P", "address": "1 A St"}]}), "")
    assert (p["address"], p["country"], p["services"]) == ("1 A St", "", "LocalBusiness; Physician")
    assert [r["name"] for r in rows(ld({"@type": "LocalBusiness", "name": "Joe Dental"}))] == ["Joe Dental"]
    assert rows(ld({"@type": "LocalBusiness", "name": "Joe Pizza"})) == []
    (q,) = rows(ld({"@type": "Hospital", "name": "Q", "address": ["a", "b"], "geo": {"latitude": 1.5, "longitude": -2}}))
    assert (q["address"], q["country"], q["lat"], q["lng"]) == ("a; b", "Canada", "1.5", "-2")


def test_card():
    html = '<section id="s" class="clinic-location"><address>10 Main Street, Toronto</address> <h3>Central Medical Clinic</h3> <a href="/central">More</a> <a href="tel:4165550100">Call</a>'
    (row,) = rows(html)
    assert (row["name"], row["phone"], row["address"]) == ("Central Medical Clinic", "4165550100", "10 Main Street, Toronto")


def test_page_fallback_and_empty():
    html = "<html><head><title>Lakeside Hospital</title></head><body><p>Call 416 555 0100 about our hospital.</p></body></html>"
    (row,) = rows(html)
    assert row["name"].startswith("Lakeside Hospital")
    assert rows("") == rows(None) == []


def test_selectors():
    page = parse('<ul id="l"><li class="a b">x<b>y</b><li data-k="v">z</ul><a href="/1">one</a>')
    assert [n.attrs.get("class") for n in select(page, "#l > li")] == ["a b", None]
    assert css(page, "li.a::text") == ["x"]
    assert css(page, "li.a ::text") == ["x", "y"]
    assert css(page, 'li[data-k="v"], a::attr(href)') == ["z", "/1"]
    assert xpath(page, "//li[@class='a b']/b/text()") == ["y"]
    assert xpath(page, "//a/@href") == ["/1"]


def test_rules(spark):
    config = {
        "sourceTag": "dir", "listSelector": "div.row", "fields": {"name": "h2::text", "services": {"css": "i::text", "join": ", "}}, "defaults": {"country": "CA"},
        "follow": {"detailLinks": "a.more::attr(href)", "pagination": {"type": "xpath", "selector": "//a[@rel='next']/@href"}}, "detailFields": {"phone": "b.tel::text"},
    }
    listing = '<div class="row"><h2>A</h2><i>x</i><i>y</i><a class="more" href="/a">m</a></div><div class="row"><h2>B</h2></div><a rel="next" href="?p=2">n</a>'
    pages = spark.createDataFrame([("https://d.org/l", listing), ("https://d.org/a", '<b class="tel">555</b>')], "url string, html string")
    found = P.rule_records(pages.where("url like '%/l'"), config)
    got = found.orderBy("position").collect()
    assert [(r["kind"], r["link"]) for r in got] == [("detail", "https://d.org/a"), ("item", None), ("page", "https://d.org/l?p=2")]
    assert json.loads(got[0]["item"]) == {"country": "CA", "name": "A", "services": "x, y", "sourceTag": "dir", "sourceUrl": "https://d.org/l", "internalStatus": "candidate"}
    (detail,) = P.complete_details(found, pages, config).collect()
    item = json.loads(detail["item"])
    assert (item["phone"], item["name"], item["sourceUrl"]) == ("555", "A", "https://d.org/a")


def test_printed_windows(spark):
    lines = [("d", 1, i, t) for i, t in enumerate(["City Hospital", "1 Road", "555 123 4567", "", "x", "y", "z", "w"])]
    out = P.printed_windows(spark.createDataFrame(lines, "doc string, page int, line_no int, text string")).collect()
    assert [(r["name"], r["blob"]) for r in out] == [("City Hospital", "City Hospital 1 Road 555 123 4567 x y")]


def test_printed_windows_need_a_contact(spark):
    pages = {1: ["City Hospital", "no contact"], 2: ["Clinic", "+1 (555) 123-4567 a.b@c.org", "www.c.org/x y"], 3: ["Doctor", "https://d.org"], 4: ["no term", "a@b.org"]}
    lines = [("d", p, i, t) for p, ts in pages.items() for i, t in enumerate(ts)]
    out = P.printed_windows(spark.createDataFrame(lines, "doc string, page int, line_no int, text string")).collect()
    got = {(r["page"], r["line_no"], r["phone"], r["email"], r["website"]) for r in out}
    assert got == {(2, 0, "+1 (555) 123-4567", "a.b@c.org", "www.c.org/x"), (3, 0, "", "", "https://d.org")}


def site(spark):
    a = lambda *hrefs: "".join(f'<a href="{h}">clinics</a>' for h in hrefs)
    pages = [("https://e.org/", a("/clinics/1", "/clinics/1/", "/about.jpg", "https://o.org/clinics")), ("https://e.org/clinics/1", a("2", "/clinics/3")), ("https://e.org/clinics/2", a("/clinics/4")), ("https://e.org/clinics/4", None)]
    return spark.createDataFrame(pages, "url string, html string")


def test_links_and_frontier(spark):
    pages = site(spark)
    links = frontier.scored_links(pages)
    assert {r["dst_url"] for r in links.where("src_url = 'https://e.org/'").collect()} == {"https://e.org/clinics/1"}
    queue = spark.createDataFrame([("r", "https://e.org/clinics/2", "processed", 1, None)], "run_key string, url string, status string, depth int, parent_url string")
    new = frontier.enqueue(queue, links, "r", 1)
    assert {r["url"] for r in new.collect()} == {"https://e.org/clinics/1", "https://e.org/clinics/3", "https://e.org/clinics/4"}
    assert frontier.enqueue(queue, links, "other", 1).count() == 4


def test_crawl(spark):
    seeds = spark.createDataFrame([("https://e.org/",)], "url string")
    got = {(r["url"].rsplit("/", 1)[-1], r["depth"], r["fetched"]) for r in frontier.crawl(site(spark), seeds).collect()}
    assert got == {("e.org", 0, True), ("1", 1, True), ("2", 2, True), ("3", 2, False), ("4", 3, True)}
    assert frontier.crawl(site(spark), seeds, max_depth=1).count() == 2
    assert frontier.crawl(site(spark), seeds, max_pages=3).count() == 3


def test_discovered(spark):
    got = frontier.discovered(site(spark).where("url = 'https://e.org/'"))
    assert {r["match_reasons"] for r in got.collect()} == {"clinics"}
    assert got.where("dst_url like '%o.org%' or dst_url like '%.jpg'").isEmpty()


def test_all_rows_of_an_address_are_seen(spark, tmp_path):
    """Rows of one address, whichever of them is even: the links of all are left out."""
    from rowloom.plans import registry

    page = lambda n, *hrefs: (n, "http://e.org/en", "".join(f'<a href="http://e.org/{h}">the</a>' for h in hrefs))
    spark.createDataFrame([page(1, "los"), page(2, "mir"), (3, "http://e.org/o", '<a href="http://e.org/nub">the</a>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["dst_url"] for r in registry.QUERIES["frontier_anti_join"](spark, str(tmp_path)).collect()] == ["http://e.org/nub"]


def test_windows_of_whole_texts_need_no_shuffle(spark):
    texts = ["City Hospital\n1 Road\n555 123\n\n 4567 x\ny\nz\nw", "Clinic\n\n+1 (555) 123-4567 a.b@c.org\nwww.c.org/x y", "no term\na@b.org", "Clinic\nno contact", "", None, "Doctor ٠٥٥ ١٢٣ ٤٥٦٧"]
    df = spark.createDataFrame([(str(i), 1, t) for i, t in enumerate(texts)], "doc string, page int, text string").coalesce(4)
    lines = df.selectExpr("doc", "page", "posexplode(split(text, '\n')) as (line_no, text)")
    for ours, theirs in ((P.printed_text_windows(df), P.printed_windows(lines)), (P.text_windows(df), P.term_windows(lines))):
        assert sorted(map(tuple, ours.select(*theirs.columns).collect())) == sorted(map(tuple, theirs.collect()))
        plan = ours._jdf.queryExecution().executedPlan().toString()
        assert ours.count() > 1 and "Window" not in plan and "hashpartitioning" not in plan
