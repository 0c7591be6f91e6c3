"""Derived inputs (FIXTURES.md F1-F8): deterministic formulas over the supplied
tables, so features the raw `pages` lack (tables, breadcrumbs, dates, sitemaps,
media, capture attempts) are exercised at every scale. Each is a plain
DataFrame plan; the DuckDB oracle builds the same rows with the same formulas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tables import Tables

RUN_DATE = "2024-06-01"


def date_pages(t: Tables) -> DataFrame:
    """pages with a date attribute inserted after `<body>`:
    `data-timemodified` when page_id % 3 = 0 (empty on every 15th, which then
    carries a `data-publicationdate` too), `data-publicationdate` when % 3 = 1."""
    dd = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    div = (
        F.when(F.col("page_id") % 15 == 0,
               F.concat(F.lit('<div data-timemodified=""></div><p data-publicationdate="2024-02-'), dd, F.lit('">x</p>')))
        .when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div data-timemodified="2024-01-'), dd, F.lit('">')))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit('<div data-publicationdate="2024-03-'), dd, F.lit('">')))
        .otherwise(F.lit(""))
    )
    return t.pages.select("page_id", "url", F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), div)).alias("html"))


def media_occurrences(t: Tables) -> DataFrame:
    """one media occurrence per lineitem row. hash = sha2(l_partkey), type =
    audio when l_partkey % 5 = 0 else image, page = the order, ts = ship date;
    ties broken by (l_linenumber, l_suppkey, l_orderkey). `api_cost` is the
    cost (F7 formulas) of describing/transcribing this item."""
    li = t.lineitem
    is_audio = F.col("l_partkey") % 5 == 0
    mtype = F.when(is_audio, F.lit("audio")).otherwise(F.lit("image"))
    prompt = F.round(F.col("l_quantity") * 100).cast("bigint")
    completion = (F.col("l_linenumber") * 50).cast("bigint")
    seconds = F.col("l_quantity") * 6
    # Fixed values (USD): gpt-4o-mini 0.00015 in / 0.0006 out per 1K tokens,
    # whisper-1 0.006 per minute; here as exact nano-USD per token / second.
    nano = F.when(is_audio, F.round(seconds * 100000).cast("bigint")).otherwise(prompt * 150 + completion * 600)
    return li.select(
        F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"),
        mtype.alias("type"),
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("page_path"),
        F.concat(F.lit("https://media.example.com/"), mtype, F.lit("/"), F.col("l_partkey").cast("string"),
                 F.when(is_audio, F.lit(".mp3")).otherwise(F.lit(".png"))).alias("original_url"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").cast("bigint").alias("tie1"),
        F.col("l_suppkey").alias("tie2"),
        F.col("l_orderkey").alias("tie3"),
        F.concat(mtype, F.lit(" of part "), F.col("l_partkey").cast("string")).alias("content"),
        (nano / F.lit(1e9)).alias("api_cost"),
        F.col("l_orderkey").alias("page_id"),
        F.when(is_audio, F.lit("whisper-1")).otherwise(F.lit("gpt-4o-mini")).alias("model"),
        F.when(is_audio, F.lit(0)).otherwise(prompt).cast("bigint").alias("prompt_tokens"),
        F.when(is_audio, F.lit(0)).otherwise(completion).cast("bigint").alias("completion_tokens"),
        F.when(is_audio, seconds).otherwise(F.lit(0.0)).alias("seconds"),
    )


def api_usage(t: Tables) -> DataFrame:
    """one API call per distinct content hash, made at its first occurrence
    (the registry makes every later occurrence free)."""
    occ = media_occurrences(t)
    first = occ.groupBy("hash").agg(
        F.min_by(
            F.struct("page_id", "model", "prompt_tokens", "completion_tokens", "seconds", "ts"),
            F.struct("ts", "tie1", "tie2", "tie3"),
        ).alias("f")
    )
    return first.select(
        F.col("f.page_id").alias("page_id"),
        F.col("hash").alias("media_hash"),
        F.col("f.model").alias("model"),
        F.col("f.prompt_tokens").alias("prompt_tokens"),
        F.col("f.completion_tokens").alias("completion_tokens"),
        F.col("f.seconds").alias("seconds"),
        F.col("f.ts").alias("ts"),
    )


# Challenge-page literals and the status each event type stands for.
CHALLENGE_LITERALS = ["Just a moment", "cf-browser-verification", "cf_chl_prog", "challenge-platform"]
EVENT_STATUS = [("view", 200), ("click", 200), ("signup", 404), ("purchase", 429), ("error", 503)]


def captures(t: Tables) -> DataFrame:
    """F8: capture attempts from `events`. url from user_id (and event_id % 16, so
    that a URL sees a handful of attempts and some never succeed), attempt order = ts
    (then event_id), status by event type; every 10th view (event_id % 10 = 0)
    is a challenge page."""
    ev = t.events
    status = F.lit(None).cast("int")
    for et, st in reversed(EVENT_STATUS):
        status = F.when(F.col("event_type") == et, F.lit(st)).otherwise(status)
    url = F.concat(F.lit("https://site"), (F.col("user_id") % 12).cast("string"), F.lit(".example.com/user/"),
                   F.col("user_id").cast("string"), F.lit("/p"), (F.col("event_id") % 16).cast("string"))
    challenge = (F.col("event_type") == "view") & (F.col("event_id") % 10 == 0)
    html = (
        F.when(challenge, F.concat(F.lit("<html><head><title>Just a moment...</title></head><body>"
                                          "<div id=\"challenge-platform\"></div></body></html>")))
        .when(status < 300, F.concat(F.lit("<!DOCTYPE html><html><head><title>User "), F.col("user_id").cast("string"),
                                     F.lit("</title></head><body><article><h1>Event "), F.col("event_id").cast("string"),
                                     F.lit("</h1><p>"), F.col("props"), F.lit("</p></article></body></html>")))
        .otherwise(F.concat(F.lit("<html><body>Error "), status.cast("string"), F.lit("</body></html>")))
    )
    return ev.select(
        url.alias("url"),
        F.col("ts").alias("fetched_at"),
        F.col("event_id").alias("attempt"),
        status.alias("status"),
        F.when(F.col("user_id") % 2 == 0, F.lit("cloudflare")).otherwise(F.lit("nginx")).alias("server"),
        html.alias("html"),
    )


def page_captures(t: Tables) -> DataFrame:
    """capture attempts of the supplied pages, for a site run over their sitemaps: page_id % 10 = 0
    never captured, 1 a server error, 2 a challenge page, 3 an error and then the page, else the page."""
    k = F.col("page_id") % 10
    page = F.struct(F.lit(200).alias("status"), F.lit("nginx").alias("server"), F.col("html").alias("html"))
    down = F.struct(F.lit(503).alias("status"), F.lit("nginx").alias("server"), F.lit("<html><body>down</body></html>").alias("html"))
    wall = F.struct(F.lit(200).alias("status"), F.lit("nginx").alias("server"), F.lit("<html><head><title>Just a moment...</title></head></html>").alias("html"))
    tries = F.when(k == 1, F.array(down)).when(k == 2, F.array(wall)).when(k == 3, F.array(down, page)).when(k != 0, F.array(page))
    return t.pages.select("url", F.posexplode(tries).alias("n", "c")).select(
        "url", F.lit("2024-05-01 00:00:00").cast("timestamp_ntz").alias("fetched_at"), F.col("n").cast("bigint").alias("attempt"), "c.*"
    )


def repeated_sitemap(t: Tables) -> DataFrame:
    """the F4 documents under a new root that lists the top index and one more urlset, which holds
    the pages with page_id % 5 = 4 again (at most SITEMAP_CHUNK, as the protocol has it)."""
    again = t.pages.filter(F.col("page_id") % 5 == 4).select("page_id", "url")
    chunk = F.floor(F.col("page_id") / SITEMAP_CHUNK).cast("bigint")
    loc = lambda c: F.concat(F.lit(f"{INDEX_HOST}/again-"), c.cast("string"), F.lit(".xml"))
    extra = again.groupBy(chunk.alias("c")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("page_id", F.concat(F.lit("<url><loc>"), _xml_escape(F.col("url")), F.lit("</loc></url>")).alias("x")))), lambda s: s["x"]), "").alias("b"))
    extra = extra.select(loc(F.col("c")).alias("loc"), F.concat(F.lit("<urlset>"), F.col("b"), F.lit("</urlset>")).alias("xml"), "c")
    names = extra.agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: F.concat(F.lit("<sitemap><loc>"), loc(c), F.lit("</loc></sitemap>"))), "").alias("b"))
    root = names.select(F.lit(RUN_ROOT).alias("loc"), F.concat(F.lit(f"<sitemapindex><sitemap><loc>{INDEX_HOST}/sitemap.xml</loc></sitemap>"), F.col("b"), F.lit("</sitemapindex>")).alias("xml"))
    return sitemap_docs(t).unionByName(extra.select("loc", "xml")).unionByName(root)


def _hx(c, m: int):
    return F.lpad(F.lower(F.hex(c % m)), 2, "0")


def media_pages(t: Tables) -> DataFrame:
    """Markdown pages with media: `documents.text` plus an image
    `/img/uuid-<hex(doc_id % 97)>.png` always, the same reference again when
    doc_id % 5 = 0, an audio link `./audio/clip<doc_id % 13>.MP3` when
    doc_id % 4 = 0, and a wrapped image `/_next/image?url=<encoded>` when
    doc_id % 9 = 0. Page URL `https://docs.example.com/<lang>/doc-<doc_id>`."""
    d = F.col("doc_id")
    img = F.concat(F.lit("![figure "), d.cast("string"), F.lit("](/img/uuid-"), _hx(d, 97), F.lit(".png)\n\n"))
    wrapped_src = F.concat(F.lit("https%3A%2F%2Fcdn.example.com%2Fassets%2Fuuid-"), _hx(d, 89), F.lit("%2Fphoto.png"))
    md = F.concat(
        F.col("text"), F.lit("\n\n"), img,
        F.when(d % 5 == 0, img).otherwise(F.lit("")),
        F.when(d % 4 == 0, F.concat(F.lit("[listen to clip](./audio/clip"), (d % 13).cast("string"), F.lit(".MP3)\n\n")))
        .otherwise(F.lit("")),
        F.when(d % 9 == 0, F.concat(F.lit("![wrapped](/_next/image?url="), wrapped_src, F.lit("&w=640)\n\n")))
        .otherwise(F.lit("")),
    )
    return t.documents.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("https://docs.example.com/"), F.col("lang"), F.lit("/doc-"), d.cast("string")).alias("url"),
        F.col("lang").alias("site"),
        md.alias("markdown"),
    )


def _clip_bytes(n, lang):
    """Bytes of clip `n`: clips with an even number differ by language."""
    return F.concat(F.lit("media:clip"), n.cast("string"), F.when(n % 2 == 0, F.concat(F.lit("-"), lang)).otherwise(F.lit("")))


def media_bytes(t: Tables) -> DataFrame:
    """F5 media_bytes(url, content, content_type): what was fetched. Figures k and k + 60 hold the same
    bytes under two names; a clip's name is the same in every language, its bytes are not
    when its number is even; wrapped photos with w % 11 = 0 were never fetched."""
    d = F.col("doc_id")
    k, n, w = d % 97, d % 13, d % 89

    def item(url, b, content_type: str):
        return F.struct(F.concat(*url).alias("url"), b.alias("b"), F.lit(content_type).alias("content_type"))

    img = item((F.lit("https://docs.example.com/img/uuid-"), _hx(d, 97), F.lit(".png")),
               F.concat(F.lit("media:img"), (k % 60).cast("string")), "image/png")
    clip = item((F.lit("https://docs.example.com/"), F.col("lang"), F.lit("/audio/clip"), n.cast("string"), F.lit(".MP3")),
                _clip_bytes(n, F.col("lang")), "audio/mpeg")
    photo = item((F.lit("https://cdn.example.com/assets/uuid-"), _hx(d, 89), F.lit("/photo.png")),
                 F.concat(F.lit("media:photo"), w.cast("string")), "image/png")
    items = t.documents.select(F.explode(F.array(img, clip, F.when(w % 11 != 0, photo))).alias("x"))
    return items.filter("x is not null").select("x.*").distinct().select("url", F.encode("b", "UTF-8").alias("content"), "content_type")


def known_contents(t: Tables) -> DataFrame:
    """F5 registry: figures whose bytes have a number j with j % 3 <> 0, and clips with n % 3 <> 0, were
    described before. Some descriptions hold a literal `$1` and a backslash, some an audio link."""
    j, n = F.col("doc_id") % 97 % 60, F.col("doc_id") % 13
    clip = _clip_bytes(n, F.col("lang"))
    img = F.struct(
        F.concat(F.lit("media:img"), j.cast("string")).alias("b"),
        F.lit("image").alias("type"),
        F.concat(F.lit("A figure labelled img"), j.cast("string"),
                 F.when(j % 2 == 0, F.lit(" (costs $1, path C:\\tmp)")).otherwise(F.lit("")),
                 F.when(j % 10 == 1, F.lit(" [hear it](./audio/clip1.MP3)")).otherwise(F.lit(""))).alias("content"),
    )
    transcript = F.struct(clip.alias("b"), F.lit("audio").alias("type"), F.concat(F.lit("Transcript of "), F.substring(clip, 7, 100)).alias("content"))
    known = t.documents.select(F.explode(F.array(F.when(j % 3 != 0, img), F.when(n % 3 != 0, transcript))).alias("x"))
    return known.filter("x is not null").select("x.*").distinct().select(F.sha2(F.col("b"), 256).alias("hash"), "type", "content")


SITEMAP_CHUNK = 50000  # URLs per urlset and sitemaps per index (protocol limits)
INDEX_HOST = "https://index.example.com"
RUN_ROOT = f"{INDEX_HOST}/run.xml"


def _xml_escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def sitemap_rows(t: Tables) -> DataFrame:
    """F4 rows: (host, page_id, url, sitemap, lastmod) — the relational truth the
    XML documents are rendered from."""
    from pagemill.functions.urls import host

    p = t.pages.select("page_id", "url", host("url").alias("host"))
    chunk = F.floor(F.col("page_id") / SITEMAP_CHUNK).cast("bigint")
    sm = F.concat(F.lit("https://"), F.col("host"), F.lit("/sitemap"),
                  F.when(chunk > 0, F.concat(F.lit("-"), chunk.cast("string"))).otherwise(F.lit("")), F.lit(".xml"))
    lastmod = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "yyyy-MM-dd")
    return p.select("host", "page_id", "url", sm.alias("sitemap"), lastmod.alias("lastmod"))


def sitemap_docs(t: Tables) -> DataFrame:
    """one urlset per host (≤ SITEMAP_CHUNK URLs each, ordered by page_id),
    index documents listing the urlsets (≤ SITEMAP_CHUNK each), and one top
    index above them (depth 2). Every aggregate is bounded by the chunk size."""
    rows = sitemap_rows(t)
    entry = F.concat(F.lit("<url><loc>"), _xml_escape(F.col("url")), F.lit("</loc><lastmod>"), F.col("lastmod"),
                     F.lit("</lastmod></url>"))
    urlsets = rows.groupBy("sitemap").agg(
        F.min("page_id").alias("first_page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("x")))), lambda s: s["x"]), "")
        .alias("body"),
    )
    ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    urlset_docs = urlsets.select(
        F.col("sitemap").alias("loc"),
        F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><urlset{ns}>'), F.col("body"), F.lit("</urlset>")).alias("xml"),
    )
    bucket = F.floor(F.col("first_page") / SITEMAP_CHUNK).cast("bigint")
    idx = urlsets.withColumn("bucket", bucket).groupBy("bucket").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_page", "sitemap"))),
                                 lambda s: F.concat(F.lit("<sitemap><loc>"), s["sitemap"], F.lit("</loc></sitemap>"))), "")
        .alias("body")
    )
    idx_loc = F.concat(F.lit(f"{INDEX_HOST}/sitemap-index-"), F.col("bucket").cast("string"), F.lit(".xml"))
    index_docs = idx.select(
        idx_loc.alias("loc"), F.col("bucket"),
        F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex{ns}>'), F.col("body"), F.lit("</sitemapindex>")).alias("xml"),
    )
    top = index_docs.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "loc"))),
                                 lambda s: F.concat(F.lit("<sitemap><loc>"), s["loc"], F.lit("</loc></sitemap>"))), "")
        .alias("body")
    ).select(
        F.lit(f"{INDEX_HOST}/sitemap.xml").alias("loc"),
        F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex{ns}>'), F.col("body"), F.lit("</sitemapindex>")).alias("xml"),
    )
    return urlset_docs.unionByName(index_docs.select("loc", "xml")).unionByName(top)


def robots_docs(t: Tables) -> DataFrame:
    """one robots.txt per host with a `Sitemap:` line per urlset of the host."""
    rows = sitemap_rows(t).select("host", "sitemap").distinct()
    return rows.groupBy("host").agg(
        F.concat(
            F.lit("User-agent: *\nDisallow: /private\n"),
            F.array_join(F.transform(F.array_sort(F.collect_list("sitemap")), lambda s: F.concat(F.lit("Sitemap: "), s)), "\n"),
            F.lit("\n"),
        ).alias("robots_txt")
    )


def discovery_pages(t: Tables) -> DataFrame:
    """F4b: pages carrying sitemap hints: `<link rel="sitemap">` in the head when
    page_id % 4 = 0, a footer link to robots.txt when page_id % 4 = 1."""
    from pagemill.functions.urls import host

    link = F.concat(F.lit('<head><link rel="sitemap" type="application/xml" href="https://'), host("url"), F.lit('/sitemap.xml">'))
    html = (
        F.when(F.col("page_id") % 4 == 0, F.replace(F.col("html"), F.lit("<head>"), link))
        .when(F.col("page_id") % 4 == 1, F.replace(F.col("html"), F.lit("<footer>"), F.lit('<footer><a href="/robots.txt">robots</a> ')))
        .otherwise(F.col("html"))
    )
    return t.pages.select("page_id", "url", html.alias("html"))


def _order_lines(t: Tables, each) -> DataFrame:
    """(order_key, priority, status, lines): `each` line item's HTML, joined in order."""
    key = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]
    # an order is small and its page long to convert: parts merged by size, as Spark does, would be too few for the cores
    dealt = t.lineitem.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    li = dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*key))).alias("items"))
    lines = F.array_join(F.transform("items", each), "")
    return li.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), lines.alias("lines"))


def order_table_pages(t: Tables) -> DataFrame:
    """one page per order holding one `<table>`: header Part | Note, a row per line item; the note is
    `Key <supplier>`, and for even suppliers `Key <supplier> Example: a|b`."""
    def row(i):
        note = F.concat(F.lit("Key "), i["l_suppkey"].cast("string"), F.when(i["l_suppkey"] % 2 == 0, " Example: a|b").otherwise(""))
        return F.concat(F.lit("<tr><td>"), i["l_partkey"].cast("string"), F.lit("</td><td>"), note, F.lit("</td></tr>\n"))

    html = F.concat(F.lit("<p>Lines of the order, priority "), F.col("priority"), F.lit('</p>\n<table class="lines">\n<tr><th>Part</th><th>Note</th></tr>\n'), F.col("lines"), F.lit("</table>"))
    return _order_lines(t, row).select("order_key", "priority", html.alias("html"))


def order_pages(t: Tables) -> DataFrame:
    """one page per order whose markup is of the kind that trips a page converter: a teaser article beside the
    body, a sidebar longer than the body's paragraphs, `>` in attributes, a bare `<`, references without semicolon, unclosed
    paragraphs and items, paragraphs in items, nested lists and quotes, a named code block, bare and
    single-quoted attributes, link titles."""
    k, s = F.col("order_key").cast("string"), lambda c: c.cast("string")
    li = lambda i: F.concat(F.lit("<li><p>Part "), s(i["l_partkey"]), F.lit("</p><p>Quantity "), s(i["l_quantity"].cast("bigint")), F.lit("<ul><li>Supplier "), s(i["l_suppkey"]), F.lit("</ul>"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Order "), k, F.lit(" &amp co</title><script>if (a < b) document.write('<p>no')</script></head><body><nav><a href='/'>Home</a></nav>"
              "<article class=card><p>Teaser "), k, F.lit(".</p></article><div class='a>b'><h2 title=\"x>y\">Order "), k, F.lit(": 1 < 2 &copy 3</h2><p>Priority "), F.col("priority"), F.lit(", status "),
        F.col("status"), F.lit(", and a text that is long enough to count as content.<ul>"), F.col("lines"), F.lit("</ul><blockquote>outer<blockquote>inner "), k,
        F.lit("</blockquote>tail</blockquote><pre><code class=\"language-js\">a  "), k, F.lit("\n  b</code></pre><p>See <a href=/o/"), k, F.lit(" title=\"ti\"><b>order</b></a> and <img src='/i/"), k,
        F.lit(".png' alt=pic><br></div><div class=\"my-sidebar\"><p>More of this, and of that, and of others, in a text, with commas, that is much longer than what the page is about.</div></body></html>"))
    return _order_lines(t, li).select(F.col("order_key").alias("page_id"), F.concat(F.lit("https://shop.example/o/"), k).alias("url"), html.alias("html"))


def breadcrumb_pages(t: Tables) -> DataFrame:
    """one page per supplier with a breadcrumb list region (link) › nation
    (link) › supplier (text); `id="breadcrumbs"` on every 7th supplier, no
    breadcrumb on every 11th."""
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    k = F.col("s_suppkey")
    items = F.concat(
        F.lit('<li><a href="/region/'), F.col("r_regionkey").cast("string"), F.lit('">'), F.col("r_name"), F.lit("</a></li>"),
        F.lit('<li><a href="/nation/'), F.col("n_nationkey").cast("string"), F.lit('">'), F.col("n_name"), F.lit("</a></li>"),
        F.lit("<li>"), F.col("s_name"), F.lit("</li>"),
    )
    crumb = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 7 == 0, F.concat(F.lit('<ul id="breadcrumbs">'), items, F.lit("</ul>")))
        .otherwise(F.concat(F.lit('<ul class="breadcrumb">'), items, F.lit("</ul>")))
    )
    html = F.concat(F.lit("<html><body><nav>"), crumb, F.lit("</nav><article><h1>"), F.col("s_name"),
                    F.lit("</h1><p>Account balance "), F.col("s_acctbal").cast("string"), F.lit("</p></article></body></html>"))
    return s.select(k.alias("page_id"), html.alias("html"))


def content_cache(t: Tables) -> DataFrame:
    """F5 per-page cache: documents with doc_id % 7 = 0 have cache entries for
    their image, wrapped image and audio references; only those with
    doc_id % 14 = 0 were made by the configured model (others are stale)."""
    from pagemill.functions.media import AUDIO_MODEL, IMAGE_MODEL
    from pagemill.functions.urls import dir_key

    d = F.col("doc_id")
    docs = t.documents.filter(d % 7 == 0).select(
        "doc_id", "lang",
        dir_key(F.concat(F.lit("https://docs.example.com/"), F.col("lang"), F.lit("/doc-"), d.cast("string"))).alias("page_dir"),
    )
    audio_hash = F.sha2(_clip_bytes(d % 13, F.col("lang")), 256)
    entries = F.array(
        F.struct(F.concat(F.lit("uuid-"), _hx(d, 97), F.lit(".png.json")).alias("cache_key"), F.lit("image").alias("media_type")),
        F.when(d % 9 == 0, F.struct(F.concat(F.lit("uuid-"), _hx(d, 89), F.lit(".json")).alias("cache_key"),
                                    F.lit("image").alias("media_type"))),
        F.when(d % 4 == 0, F.struct(F.concat(F.lit("audio-"), F.substring(audio_hash, 1, 12), F.lit(".MP3.json")).alias("cache_key"),
                                    F.lit("audio").alias("media_type"))),
    )
    e = docs.select("doc_id", "page_dir", F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("e"))
    model = F.when(F.col("e.media_type") == "image", F.lit(IMAGE_MODEL)).otherwise(F.lit(AUDIO_MODEL))
    return e.select(
        "page_dir", F.col("e.cache_key").alias("cache_key"), F.col("e.media_type").alias("media_type"),
        F.concat(F.lit("Cached "), F.col("e.media_type"), F.lit(" for doc "), F.col("doc_id").cast("string")).alias("content"),
        F.when(F.col("doc_id") % 14 == 0, model).otherwise(F.lit("older-model")).alias("model"),
    )
