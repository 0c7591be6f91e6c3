"""One test per decided behaviour and per URL / link rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import media as M
from pagemill.functions import urls as U
from pagemill.operators import costs as C
from pagemill.operators import crawl as CR
from pagemill.operators import links as L
from pagemill.operators import media as MO
from pagemill.operators import merge as G
from pagemill.sources import sitemaps as S


def one(spark, col, **vals):
    cols = ", ".join(f"{k} string" for k in vals)
    df = spark.createDataFrame([tuple(vals.values())], cols)
    return df.select(col.alias("x")).first().x


def _both(pages, resolved):
    return MO.annotate(MO.annotate(pages, resolved, "image"), resolved, "audio", "processed")


def test_x1_description_tags_with_attributes_are_counted(spark):
    df = spark.createDataFrame([(1, 'a <md_image-description src="u">d</md_image-description> b <md_image-description>e')],
                               "page_id bigint, processed string")
    rows = {r.page_id: r for r in G.tag_counts(df).collect()}
    assert rows[1].n_descriptions == 2 and rows[None].n_descriptions == 2


def test_x9_each_identical_ref_annotated_and_dollar_literal(spark):
    md = "![a](/i/uuid-1.png) text ![a](/i/uuid-1.png)"
    pages = spark.createDataFrame([(1, "https://s.org/p", md)], "page_id bigint, url string, markdown string")
    resolved = spark.createDataFrame(
        [(1, "image", 0, "/i/uuid-1.png", "https://s.org/i/uuid-1.png", "cost $1 \\ ok")],
        "page_id bigint, kind string, pos bigint, raw_url string, resolved_url string, content string",
    )
    out = _both(pages, resolved).first().processed
    tag = '\n\n<md_image-description src="https://s.org/i/uuid-1.png">cost $1 \\ ok</md_image-description>\n\n'
    assert out == "![a](/i/uuid-1.png)" + tag + " text ![a](/i/uuid-1.png)" + tag


def test_mediated_failure_keeps_text(spark):
    pages = spark.createDataFrame([(1, "https://s.org/p", "![a](/x.png) [s](/a.mp3)")], "page_id bigint, url string, markdown string")
    resolved = spark.createDataFrame([], "page_id bigint, kind string, pos bigint, raw_url string, resolved_url string, content string")
    assert _both(pages, resolved).first().processed == "![a](/x.png) [s](/a.mp3)"


def test_x10_query_dropped_from_path_key(spark):
    a = one(spark, U.path_key(F.col("u")), u="https://h.org/list?page=1")
    b = one(spark, U.path_key(F.col("u")), u="https://h.org/list?page=2")
    assert a == b == "tmp/h.org/list/list"
    assert one(spark, U.path_key(F.col("u")), u="https://H.org/") == "tmp/h.org/index/index"
    assert one(spark, U.path_key(F.col("u")), u="https://h.org/a/b/page.html") == "tmp/h.org/a/b/page/page.html"


def test_x13_status_labels(spark):
    df = spark.createDataFrame(
        [("u", 1, 403, "cloudflare", "x"), ("u", 2, 429, "nginx", "x"), ("u", 3, 200, "nginx", "<p>Just a moment</p>"),
         ("u", 4, 404, "nginx", "x"), ("u", 5, 503, "nginx", "x"), ("u", 6, 200, "nginx", "ok")],
        "url string, attempt bigint, status int, server string, html string",
    ).withColumn("fetched_at", F.lit(None).cast("timestamp_ntz"))
    got = {r.attempt: (r.outcome, r.accepted_by_status, r.retry_after_ms) for r in CR.fetch_outcome(df).collect()}
    assert got[1][0] == "blocked" and got[2] == ("rate_limited", True, 30000)
    assert got[3][0] == "challenge" and got[4][0] == "client_error" and got[5][0] == "server_error" and got[6] == ("ok", True, 0)


def test_x14_one_entry_sitemap(spark):
    docs = spark.createDataFrame([("s", "<urlset><url><loc>https://a/only</loc></url></urlset>")], "loc string, xml string")
    rows = S.urlset_entries(docs).collect()
    assert [(r.pos, r.loc) for r in rows] == [(0, "https://a/only")]


def test_sitemap_index_expansion_order_and_cycles(spark):
    docs = spark.createDataFrame(
        [
            ("root", "<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"),
            ("a", "<urlset><url><loc>https://x/a1</loc></url><url><loc>https://x/a2</loc></url></urlset>"),
            ("b", "<urlset><url><loc>https://x/b1</loc></url><url><loc>https://x/a1</loc></url></urlset>"),
        ],
        "loc string, xml string",
    )
    roots = spark.createDataFrame([("root",)], "root string")
    rows = S.expand(docs, roots).orderBy("order_key").collect()
    assert [r.loc for r in rows] == ["https://x/b1", "https://x/a1", "https://x/a1", "https://x/a2"]  # no dedup


def test_x15_relative_links_resolve_against_origin(spark):
    html = '<a href="rel/x">r</a><a href="/abs">a</a><a href="//cdn.org/c">c</a><a href="#top">t</a><a href="mailto:a@b">m</a>'
    df = spark.createDataFrame([(1, "https://Site.org/deep/path/page", html)], "page_id bigint, url string, html string")
    links = [r.link for r in L.page_links(df).orderBy("pos").collect()]
    assert links == ["https://site.org/rel/x", "https://site.org/abs", "https://cdn.org/c"]


def test_link_tiers(spark):
    df = spark.createDataFrame(
        [(1, "https://s.org/", '<link href="/style.css"><p>x</p>'), (2, "https://s.org/", "see https://e.org/a and http://www.w3.org/x")],
        "page_id bigint, url string, html string",
    )
    got = {(r.page_id, r.link) for r in L.page_links(df).collect()}
    assert got == {(1, "https://s.org/style.css"), (2, "https://e.org/a")}


def test_x16_robots_link_is_separate(spark):
    df = spark.createDataFrame([(1, "u", '<a href="/robots.txt">r</a>')], "page_id bigint, url string, html string")
    r = L.sitemap_discovery(df).first()
    assert r.sitemap_link is None and r.robots_link == "/robots.txt"


def test_x20_bare_relative_media_stays(spark):
    assert one(spark, M.resolve_media(F.col("u"), F.col("p")), u="images/a.png", p="https://s.org/d/p") == "images/a.png"
    assert one(spark, M.resolve_media(F.col("u"), F.col("p")), u="./a/../b.png", p="https://s.org/d/p") == "https://s.org/d/b.png"
    assert one(spark, M.resolve_media(F.col("u"), F.col("p")), u="../up.png", p="https://s.org/d/e/p") == "https://s.org/d/up.png"


def test_x23_x24_wrapped_image_decoded_once_and_resolved(spark):
    u = "https://s.org/_next/image?url=%2Fimg%2Fuuid-ab%252Fx.png&w=64"
    got = one(spark, M.unwrap_next_image(F.col("u"), F.col("p")), u=u, p="https://s.org/page")
    assert got == "https://s.org/img/uuid-ab%2Fx.png"
    assert one(spark, M.image_cache_key(F.col("u")), u=got) == "uuid-ab%2Fx.png.json"


def test_cache_key_and_stored_name(spark):
    assert one(spark, M.image_cache_key(F.col("u")), u="https://c.org/a/b.png?x=1") == "b.png.json"
    name = one(spark, M.stored_name(F.lit("audio"), F.col("u"), F.col("u"), F.lit("0123456789abcdef")), u="https://c.org/s.WAV")
    assert name == "audio-0123456789ab.WAV"


def test_x26_retry_uses_twice_the_timeout(spark):
    st = spark.createDataFrame([("s", "https://s/x", False, "Error 503")], "site string, url string, ok boolean, error string")
    r = CR.failure_report(st, timeout_ms=45000).first()
    assert r.retry_timeout_ms == 90000 and r.n == 1
    assert CR.failure_report(st).first().retry_timeout_ms == 120000


def test_costs_exact_and_text(spark):
    usage = spark.createDataFrame(
        [(1, "h1", "gpt-4o-mini", 1000, 0, 0.0), (1, "h2", "whisper-1", 0, 0, 90.0)],
        "page_id bigint, media_hash string, model string, prompt_tokens bigint, completion_tokens bigint, seconds double",
    )
    priced = C.priced_usage(usage, C.prices_df(spark))
    page = C.cost_by_page(priced).first()
    assert page.image_cost == 0.00015 and page.audio_cost == 0.009 and page.total_cost == 0.00915
    top = [r for r in C.cost_rollup(priced).collect() if r.page_id is None][0]
    assert top.cost_text == "0.0092"
    assert "Duration: 90 seconds" in top.summary and "Prompt Tokens: 1000" in top.summary


def test_cost_guard_levels(spark):
    rows = [(i, f"h{i:03d}", "whisper-1", 0, 0, 1000.0) for i in range(40)]  # 0.1 USD each
    usage = spark.createDataFrame(rows, "page_id bigint, media_hash string, model string, prompt_tokens bigint, "
                                        "completion_tokens bigint, seconds double")
    usage = usage.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,page_id * 3600)"))
    g = C.cost_guard(C.priced_usage(usage, C.prices_df(spark))).orderBy("ts").collect()
    assert g[-1].cumulative_cost == 4.0 and g[-1].guard_level == "ok"
    many = usage.withColumn("seconds", F.lit(60000.0))  # 6 USD each
    levels = [r.guard_level for r in C.cost_guard(C.priced_usage(many, C.prices_df(spark))).orderBy("ts").collect()]
    assert levels[0] == "ok" and levels[1] == "warn" and levels[8] == "stop"


def test_merge_parts_and_numbering(spark):
    pages = spark.createDataFrame(
        [("s", i, f"https://d.org/s/p{i}", f"body {i}") for i in (5, 150, 151, 40)], "site string, pos bigint, url string, content string"
    )
    parts = {r.part: r for r in G.merge_site(pages, part_pages=100).collect()}
    assert parts[0].body == "## p5\n\nbody 5\n\n---\n\n## p40\n\nbody 40" and parts[0].first_i == 1
    assert parts[1].first_i == 3 and parts[1].n_pages == 2
    toc = {r.part: r.toc for r in G.merge_toc(pages.drop("content"), F.lit("https://d.org/sitemap.xml"), "T", 100).collect()}
    assert toc[1] == "3. https://d.org/s/p150\n4. https://d.org/s/p151\n"


def test_strip_source_line(spark):
    assert one(spark, G.strip_source_line(F.col("m")), m="[source: https://x]\n\nbody [source: y]\n\n") == "body [source: y]\n\n"


def test_changed_since_new_and_changed(spark):
    from pagemill.operators import incremental as I

    urls = spark.createDataFrame([("a", "2024-02-01"), ("b", "2024-01-01"), ("c", "2024-01-05")], "loc string, lastmod string")
    prev = spark.createDataFrame([("a", "2024-01-15"), ("b", "2024-01-15")], "url string, last_modified string")
    got = {(r.loc, r.reason) for r in I.changed_since(urls, prev).collect()}
    assert got == {("a", "changed"), ("c", "new")}


def test_prefer_processed_falls_back_to_raw(spark):
    raw = spark.createDataFrame([(1, "s", 1, "u1", "raw1"), (2, "s", 2, "u2", "raw2")],
                                "page_id bigint, site string, pos bigint, url string, markdown string")
    proc = spark.createDataFrame([(1, "[source: u1]\n\nproc1")], "page_id bigint, processed string")
    got = {r.page_id: (r.content, r.used_processed) for r in G.prefer_processed(raw, proc).collect()}
    assert got == {1: ("proc1", True), 2: ("raw2", False)}
