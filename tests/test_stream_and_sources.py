"""Stream forms (batch ≡ stream) and file sources / sinks."""

from __future__ import annotations

import base64
import datetime as dt
import json
import shutil

from pyspark.sql import functions as F

from pagemill.operators import pages as P
from pagemill.operators import registry as R
from pagemill.sources import files as FS
from pagemill.sources import writers as W
from pagemill.sources.derived import captures, media_occurrences
from pagemill.streaming import incremental as S
from pagemill.streaming import runs


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_registry_stream_equals_batch(spark, tables, tmp_path):
    occ = media_occurrences(tables).select(
        "hash", "type", "page_path", "original_url", "ts", "tie1", "tie2", "tie3", "content", "api_cost"
    )
    src = tmp_path / "occ"
    # Three arrival files, split by a hash of the row, not by time.
    for k in range(3):
        occ.filter(F.pmod(F.xxhash64("page_path", "tie1"), F.lit(3)) == k).write.parquet(str(src / f"part{k}"))
    schema = occ.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    base = str(tmp_path / "registry")
    S.start_registry_stream(spark, str(src / "part[01]"), schema, base, str(tmp_path / "ckpt")).awaitTermination()
    half = runs.committed(spark, base)
    S.start_registry_stream(spark, str(src / "*"), schema, base, str(tmp_path / "ckpt")).awaitTermination()
    assert len(runs.committed(spark, base)) > len(half) >= 1
    contents, pairs = S.streamed_registry(spark, base)
    assert _rows(contents) == _rows(R.registry_build(occ))
    assert pairs.count() == occ.select("hash", "page_path").distinct().count()
    # a replayed batch changes nothing
    runs.add(R.distinct_occurrences(occ.limit(1)), base, 1, S.merged_pairs)
    assert _rows(S.streamed_registry(spark, base)[0]) == _rows(R.registry_build(occ))
    assert W.save_registry_version(contents, pairs, str(tmp_path / "saved")) == 1


def test_runs_merge_in_levels_and_survive_failures(spark, tables, tmp_path):
    occ = media_occurrences(tables).limit(900).withColumn("_b", F.pmod(F.xxhash64("page_path", "tie1"), F.lit(9)) + 1).persist()
    base, sizes = str(tmp_path / "reg"), []
    assert S.streamed_registry(spark, base) is None
    for v in range(1, 10):
        batch = R.distinct_occurrences(occ.where(F.col("_b") == v).drop("_b"))
        runs.add(batch, base, v, S.merged_pairs, fanout=2)
        sizes.append((batch.count(), spark.read.parquet(f"{base}/runs/{v}-{v}").count()))
        if v == 4:  # a merge that died before its commit is made again
            shutil.rmtree(f"{base}/_runs/1-4")
            runs.add(batch, base, v, S.merged_pairs, fanout=2)
    assert all(a == b for a, b in sizes)  # a batch writes its own rows, however large the registry is
    assert runs.cover(runs.committed(spark, base)) == [(1, 8), (9, 9)] and len(runs.obsolete(spark, base)) == 14
    contents, _ = S.streamed_registry(spark, base)
    assert _rows(contents) == _rows(R.registry_build(occ.drop("_b")))


def test_late_captures_do_not_win(spark, tmp_path):
    row = lambda v, url, day: (url, dt.datetime(2024, 1, day), v, f"v{v}")
    for v, rows in enumerate([[row(0, "a", 2), row(0, "b", 1)], [row(1, "a", 1), row(1, "b", 2)], [row(2, "c", 1)]]):
        df = spark.createDataFrame(rows, "url string, fetched_at timestamp_ntz, batch_id bigint, markdown string")
        runs.add(df, str(tmp_path / "p"), v + 1, S.newest_pages, fanout=2)
    assert {(r.url, r.markdown) for r in S.current_pages(spark, str(tmp_path / "p")).collect()} == {("a", "v0"), ("b", "v1"), ("c", "v2")}


def test_registry_save_survives_failures(spark, tmp_path):
    import pytest

    base = str(tmp_path / "reg")
    one = spark.createDataFrame([("h1", "d1")], "hash string, content string")
    two = spark.createDataFrame([("h1", "d1"), ("h2", "d2")], "hash string, content string")
    assert W.latest_registry_version(spark, base) == 0
    assert W.save_registry_version(one, one, base) == 1
    # a save that dies before its commit leaves version 1 in force, and the next save takes its place
    two.write.parquet(f"{base}/v=2/media_contents")
    assert W.latest_registry_version(spark, base) == 1 and W.read_registry(spark, base)[0].count() == 1
    assert W.save_registry_version(two, two, base) == 2 and W.read_registry(spark, base)[0].count() == 2
    assert W.read_registry(spark, base, 1)[0].count() == 1  # the backup
    assert W.save_registry_version(one, one, base, delta=one.limit(0)) == 2
    # an unreadable marker folder is an error, not "no registry"
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "_committed").write_text("x")
    with pytest.raises(Exception):
        W.save_registry_version(one, one, str(tmp_path / "bad" / "_committed"))


def test_cache_files_join_references(spark, tmp_path):
    from pagemill.operators import media as MO

    d = tmp_path / "tmp" / "a.org" / "docs" / "page"
    d.mkdir(parents=True)
    (d / "uuid-9.json").write_text(json.dumps({"description": "cached", "timestamp": 1700000000000, "model": "gpt-4o-mini"}))
    cache = FS.read_cache_json(spark, str(d), str(tmp_path / "tmp"))
    refs = MO.media_refs(spark.createDataFrame([(1, "https://a.org/docs/page", "![x](/img/uuid-9/pic.png)")], "page_id bigint, url string, markdown string"))
    data = spark.createDataFrame([], "url string, content binary, content_type string")
    reg = spark.createDataFrame([], "hash string, content string")
    r = MO.resolve_contents(MO.resolve_refs(refs, data), cache, reg).first()
    assert (r.content_source, r.content) == ("cache", "cached")


def test_equal_names_and_equal_bytes(spark):
    from pagemill.operators import media as MO

    pages = spark.createDataFrame([(1, "https://a.org/x/p", "![l](/x/logo.png)"), (2, "https://b.org/y/p", "![l](/y/logo.png) ![m](/same.png) ![n](/gone.png)")], "page_id bigint, url string, markdown string")
    data = spark.createDataFrame([("https://a.org/x/logo.png", bytearray(b"A"), "image/png"), ("https://b.org/y/logo.png", bytearray(b"B"), "image/png"),
                                  ("https://b.org/same.png", bytearray(b"A"), "image/png")], "url string, content binary, content_type string")
    none = spark.createDataFrame([], "page_dir string, cache_key string, model string, content string")
    reg = spark.createDataFrame([], "hash string, content string")
    r = MO.resolve_contents(MO.resolve_refs(MO.media_refs(pages), data), none, reg)
    by = {(x.page_id, x.raw_url): x for x in r.collect()}
    assert by[1, "/x/logo.png"].hash != by[2, "/y/logo.png"].hash and by[1, "/x/logo.png"].hash == by[2, "/same.png"].hash
    assert by[2, "/gone.png"].content_source == "failed" and by[2, "/gone.png"].hash is None
    assert sorted(x.n_refs for x in MO.enrichment_requests(r, data).collect()) == [1, 2]


def test_page_stream_equals_batch(spark, tables, tmp_path):
    cap = captures(tables)
    src = tmp_path / "captures"
    for k in range(2):
        cap.filter(F.pmod(F.col("attempt"), F.lit(2)) == k).write.parquet(str(src / f"b{k}"))
    q = S.start_page_stream(spark, str(src / "*"), str(tmp_path / "pages"), str(tmp_path / "ckpt"), "2024-06-01")
    q.awaitTermination()
    cur = S.current_pages(spark, str(tmp_path / "pages")).select("url", "markdown")
    usable = cap.filter(F.col("status").between(200, 299) & ~F.col("html").contains("Just a moment"))
    latest = usable.groupBy("url").agg(F.max_by("html", F.struct("fetched_at", "attempt")).alias("html"))
    batch = P.page_document(latest.select(F.xxhash64("url").alias("page_id"), "url", "html"), "2024-06-01").select("url", "markdown")
    assert _rows(cur) == _rows(batch)


def test_local_html_and_media_files(spark, tmp_path):
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "a.html").write_text("<html><head><title>A</title></head><body><article>x</article></body></html>")
    (tmp_path / "site" / "note.txt").write_text("not html")
    (tmp_path / "site" / "old.html.bak").write_text("not html")
    pages = FS.read_local_html(spark, str(tmp_path / "site")).collect()
    assert len(pages) == 1 and pages[0].url.startswith("file:///") and pages[0].url.endswith("/site/a.html")
    (tmp_path / "media").mkdir()
    (tmp_path / "media" / "one.png").write_bytes(b"dummy image content")
    (tmp_path / "media" / "two.mp3").write_bytes(b"dummy audio content")
    (tmp_path / "media" / "copy.png").write_bytes(b"dummy image content")
    m = {r.path.rsplit("/", 1)[1]: r for r in FS.read_media_files(spark, str(tmp_path / "media")).collect()}
    assert m["one.png"].content_type == "image/png" and m["two.mp3"].content_type == "audio/mpeg"
    assert m["one.png"].hash == m["copy.png"].hash != m["two.mp3"].hash


def test_registry_json_and_cache_json(spark, tmp_path):
    contents, occ = FS.read_registry_json(spark, str(tmp_path / "missing.json"))
    assert contents.count() == 0 and occ.count() == 0
    reg = {
        "entries": {
            "h1": {"type": "image", "hash": "h1", "content": "d",
                   "occurrences": [{"pagePath": "p1", "originalUrl": "u1", "timestamp": "2024-01-01T00:00:00.000Z"},
                                   {"pagePath": "p2", "originalUrl": "u2", "timestamp": "2024-01-02T00:00:00.000Z"}],
                   "firstProcessed": "2024-01-01T00:00:00.000Z", "lastUsed": "2024-01-02T00:00:00.000Z",
                   "metadata": {"originalUrl": "u1"}, "apiCost": 0.02}
        },
        "stats": {"totalFiles": 2},
    }
    (tmp_path / "reg.json").write_text(json.dumps(reg, indent=2))
    contents, occ = FS.read_registry_json(spark, str(tmp_path / "reg.json"))
    c = contents.first()
    assert c.hash == "h1" and c.n_occurrences == 2 and c.api_cost == 0.02
    assert [r.page_path for r in occ.orderBy("ts").collect()] == ["p1", "p2"]
    d = tmp_path / "cache" / "page"
    d.mkdir(parents=True)
    (d / "uuid-1.png.json").write_text(json.dumps({"description": "desc", "timestamp": 1700000000000, "model": "gpt-4o-mini"}))
    (d / "clip.mp3.json").write_text(json.dumps({"transcription": "words", "timestamp": 1700000000000, "model": "whisper-1"}))
    (d / "broken.json").write_text("{not json")
    rows = {r.cache_key: r for r in FS.read_cache_json(spark, str(tmp_path / "cache" / "*"), str(tmp_path / "cache")).collect()}
    assert rows["uuid-1.png.json"].content == "desc" and rows["clip.mp3.json"].media_type == "audio"
    assert rows["broken.json"].content is None


def test_writers(spark, tables, tmp_path):
    docs = P.page_document(tables.pages.limit(20), "2024-06-01")
    W.write_markdown_pages(docs, str(tmp_path / "md"))
    back = spark.read.parquet(str(tmp_path / "md"))
    assert back.count() == 20 and "domain" in back.columns
    W.write_page_stats(P.page_stats(docs, "2024-06-01"), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).count() == 20
    pieces = [("en", 0, 0, "# H\n"), ("en", 1, 0, "1. u\n"), ("en", 1, 1, "2. v\n"), ("en", 2, 0, "\n---\n\n"), ("en", 3, 0, "## u\n\nx"), ("en", 3, 1, "\n\n---\n\n## v\n\ny"), ("de", 0, 0, "# D\n")]
    W.write_merged(spark.createDataFrame(pieces[::-1], "site string, block int, part bigint, text string"), str(tmp_path / "merged"))
    files = sorted((tmp_path / "merged" / "site=en").glob("part-*"))
    assert "".join(f.read_text() for f in files).replace(W.LINE_SEP, "") == "".join(p[3] for p in pieces[:6])


def test_merged_parts_read_back_byte_for_byte(spark, tmp_path):
    pieces = [(site, b, p, f"{site} {b}.{p} é漢\n" * (1 + (b * 7 + p) % 5)) for site in ("en", "de") for b in range(4) for p in range(30)] + [("en", 4, 0, "")]
    df = spark.createDataFrame(pieces[::-1], "site string, block int, part bigint, text string").repartition(5)
    path = str(tmp_path / "merged")
    W.write_merged_parts(df, path)
    for site in ("en", "de"):
        rows = spark.read.parquet(f"{path}/parts").where(F.col("site") == site).orderBy("offset", "length").collect()
        got = b""
        for r in rows:
            assert r["offset"] == len(got)
            got += bytes(r["data"])
        assert got.decode() == "".join(t for s, _, _, t in sorted(pieces, key=lambda x: x[:3]) if s == site)
    assert W.merged_faults(spark, path).collect() == []
    bad = spark.read.parquet(f"{path}/parts").where("offset > 0 AND site = 'de'").withColumn("data", F.when(F.col("offset") < 100, F.lit(b"x")).otherwise(F.col("data")))
    bad.write.partitionBy("site").parquet(str(tmp_path / "bad" / "parts"))
    spark.read.parquet(f"{path}/manifest").write.parquet(str(tmp_path / "bad" / "manifest"))
    faults = W.merged_faults(spark, str(tmp_path / "bad")).where("site = 'de'").collect()
    assert {r["fault"] for r in faults} == {"missing", "altered"} and min(r["offset"] for r in faults) == 0


def test_site_run_end_to_end(spark):
    from pagemill.plans.site_run import site_run

    docs = spark.createDataFrame(
        [("root", "<sitemapindex><sitemap><loc>s1</loc></sitemap></sitemapindex>"),
         ("s1", "<urlset><url><loc>https://a.org/one</loc></url><url><loc>https://a.org/two</loc></url>"
                "<url><loc>https://a.org/three</loc></url></urlset>")],
        "loc string, xml string",
    )
    ok_html = '<html><head><title>One</title></head><body><article><p>Hi <img src="/img/uuid-9.png" alt="x"></p></article></body></html>'
    cap = spark.createDataFrame(
        [("https://a.org/one", 1, 200, "nginx", ok_html), ("https://a.org/two", 2, 503, "nginx", "down"),
         ("https://a.org/three", 3, 200, "nginx", "<html><body><article><p>Three</p></article></body></html>")],
        "url string, attempt bigint, status int, server string, html string",
    ).withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    reg = spark.createDataFrame([], "hash string, type string, content string")
    cache = spark.createDataFrame([], "page_dir string, cache_key string, media_type string, content string, model string")
    data = spark.createDataFrame([("https://a.org/img/uuid-9.png", bytearray(b"png bytes"), "image/png")], "url string, content binary, content_type string")
    run = site_run(docs, "root", cap, data, reg, cache, "2024-06-01")
    assert run.pages.count() == 2
    assert [r.url for r in run.failures.collect()] == ["https://a.org/two"]
    s = run.summary.first()
    assert (s.succeeded, s.failed, s.total) == (2, 1, 3)
    body = "".join(r.text for r in run.merged.orderBy("block", "part").collect())
    assert body.startswith("# Merged Documentation from Sitemap\n\nSource: root\n\n") and "1. https://a.org/one\n2. https://a.org/three\n\n---\n\n## one\n\n" in body
    assert body.index("## one") < body.index("\n\n---\n\n## three")
    req = run.requests.collect()
    assert len(req) == 1 and req[0].source_url == "https://a.org/img/uuid-9.png" and req[0].prompt.endswith("Alt text: x")
    assert req[0].data_url == "data:image/png;base64," + base64.b64encode(b"png bytes").decode()


def test_sinks_append(spark, tables, tmp_path):
    W.append_captures(captures(tables).limit(5), str(tmp_path / "cap"))
    W.append_captures(captures(tables).limit(5), str(tmp_path / "cap"))
    assert spark.read.parquet(str(tmp_path / "cap")).count() == 10
    cache = spark.createDataFrame([("d", "k.json", "image", "c", "m")], "page_dir string, cache_key string, media_type string, content string, model string")
    W.append_content_cache(cache, str(tmp_path / "cache"))
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 1


def test_rule_hook_preview_and_transcript(spark):
    from pagemill.functions import html as H
    from pagemill.functions import media as M
    from pagemill.functions.text import preview

    rules = H.MARKDOWN_RULES[:5] + [("mark", "(?i)</?mark>", "==")] + H.MARKDOWN_RULES[5:]
    df = spark.createDataFrame([("<p>a <mark>b</mark></p>", None)], "h string, t string")
    assert df.select(H.html_to_markdown(F.col("h"), rules).alias("m")).first().m == "a ==b=="
    assert df.select(preview(F.col("h"), 5).alias("p")).first().p == "<p>a "
    got = df.select(M.transcript_text(F.col("t"), F.struct(F.lit("w").alias("text"))).alias("x")).first().x
    assert got == '{"text":"w"}'


def test_sitemap_files_and_registry_export(spark, tmp_path):
    from pagemill.sources import sitemaps as SM

    d = tmp_path / "maps"
    d.mkdir()
    (d / "a.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
                             "<url><loc>https://a.org/1?x=1&amp;y=2</loc><lastmod>2024-01-02</lastmod></url>"
                             "<url><loc>https://a.org/2</loc></url></urlset>")
    (d / "idx.xml").write_text("<sitemapindex><sitemap><loc>https://a.org/a.xml</loc></sitemap></sitemapindex>")
    docs = SM.read_sitemap_files(spark, str(d))
    got = sorted((r.pos, r.loc, r.lastmod) for r in SM.urlset_entries(docs).collect())
    assert got == [(0, "https://a.org/1?x=1&y=2", "2024-01-02"), (1, "https://a.org/2", None)]
    assert [r.child for r in SM.index_edges(docs).collect()] == ["https://a.org/a.xml"]

    occ = spark.createDataFrame([("h1", "p1", "u1")], "hash string, page_path string, original_url string")
    contents = spark.createDataFrame([("h1", "image", "d")], "hash string, type string, content string")
    W.export_registry_json(contents, occ, str(tmp_path / "export"))
    back = spark.read.json(str(tmp_path / "export" / "entries")).first()
    assert back.hash == "h1" and back.content == "d"
    assert spark.read.json(str(tmp_path / "export" / "occurrences")).first().page_path == "p1"
