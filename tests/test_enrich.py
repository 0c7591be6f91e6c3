"""Enrichment of whole pages against the sequential definition: images first, then the audio links
of the text that results."""

from __future__ import annotations

import hashlib
import random
import re

from pagemill.operators import media as MO

IMAGE, LINK = r"!\[(.*?)\]\((.*?)\)", r"\[(.*?)\]\((.*?)\)"
FILES = ["a.png", "b.png", "c.png", "v.mp3", "w.MP3", "gone.png", "x.ogg"]
TEXTS = {
    "a.png": "Plain $1 \\ text",
    "b.png": "A figure [hear it](./v.mp3) and [open](",
    "c.png": "two ![inner](./a.png) lines\nand [again](./w.MP3) [x](./v.mp3) [",
    "v.mp3": "spoken [words](./w.MP3)",
    "x.ogg": "ogg ) ] words",
}


def _want(md: str, base: str) -> str:
    def put(m: re.Match, kind: str) -> str:
        raw = m[2]
        name = raw.removeprefix("./")
        if kind == "audio" and not re.search(r"(?i)\.(mp3|wav|ogg|m4a|aac)\Z", raw) or name not in TEXTS:
            return m[0]
        tag = "md_image-description" if kind == "image" else "md_audio-transcript"
        return f'{m[0]}\n\n<{tag} src="{base}{name}">{TEXTS[name]}</{tag}>\n\n'

    md = re.sub(IMAGE, lambda m: put(m, "image"), md)
    return re.sub(LINK, lambda m: put(m, "audio"), md)


def _inputs(spark, mds):
    pages = spark.createDataFrame([(i, f"https://s.org/d{i % 3}/p{i}", m) for i, m in enumerate(mds)], "page_id bigint, url string, markdown string")
    held = [(f"https://s.org/d{d}/{f}", f.encode(), None) for d in range(3) for f in FILES if f != "gone.png"]
    media = spark.createDataFrame(held, "url string, content binary, content_type string")
    known = spark.createDataFrame([(hashlib.sha256(f.encode()).hexdigest(), t) for f, t in TEXTS.items()], "hash string, content string")
    cache = spark.createDataFrame([], "page_dir string, cache_key string, model string, content string")
    return pages, media, cache, known


def test_enriched_pages_equal_the_sequential_definition(spark):
    rng = random.Random(4)
    parts = [f"{b}[{t}](./{f})" for b in ("", "!") for t in ("t", "") for f in FILES]
    parts += ["[", "](", ")", "]", "!", "\n", " x ", "[see ", "](./v.mp3)", "![a](b [c.png) d](./v.mp3)", "[a](![b](./b.png)"]
    mds = ["".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(150)] + [None, "", "![a](./v.mp3)", "[q ![a](./b.png) z](./x.ogg)"]
    pages, media, cache, known = _inputs(spark, mds)
    got = {r.page_id: r for r in MO.enrich_markdown(pages, media, cache, known).collect()}
    assert len(got) == len(mds)
    for i, md in enumerate(mds):
        assert got[i].markdown == md
        assert got[i].processed == (None if md is None else _want(md, f"https://s.org/d{i % 3}/")), md


def test_one_repartition_by_page(spark):
    plan = MO.enrich_markdown(*_inputs(spark, ["![a](./a.png)"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    # three lookups of the text's references (standing twice, for themselves and for their descriptions), three of the descriptions' links, then the text
    assert plan.count("LeftOuter") == 10


def test_empty_tables(spark):
    pages, media, cache, known = _inputs(spark, ["![a](./a.png)"])
    none = [d.limit(0) for d in (media, cache, known)]
    assert MO.enrich_markdown(pages, *none).first().processed == "![a](./a.png)"
    assert MO.enrich_markdown(pages.limit(0), media, cache, known).collect() == []
