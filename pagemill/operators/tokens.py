"""HTML token table and reader-mode scoring as relational operators.

`html_tokens` cuts every page into tag / text tokens with one linear, quote-aware
pattern (`nodes.page_tokens`) + `posexplode` and derives the nesting depth with a running-sum window over
the page's tokens (partitioned by page: a window never spans more than one
page). Containers are the depth-counting elements; a token's parent container
is found with a second window (`last(..., ignorenulls)` per page and level),
so no tree is ever built in Python.

Reader-mode contract (`main_content`): text blocks of at least 25 characters
outside links score 1 + commas + min(floor(len/100), 3); each block credits
its parent container fully and the grandparent by half; a container's score
is multiplied by (1 − link density of its direct text). The best container
of a page wins (ties: first in the page); a page with exactly one `<article>`
or `<main>` takes it directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import collapse_ws, decode_entities, js_trim
from pagemill.operators.nodes import PLAIN_TOKEN, page_tokens

# Elements that never change the nesting depth — void elements,
# elements often left unclosed (p, li, b) and inline markup (text inside them
# belongs to the enclosing block container).
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
UNCLOSED_TAGS = ["p", "li", "b"]
INLINE_TAGS = ["a", "i", "em", "strong", "span", "code", "small", "u", "font", "label", "abbr", "sub", "sup", "s",
               "q", "cite", "mark", "time"]
NON_COUNTING = VOID_TAGS + UNCLOSED_TAGS + INLINE_TAGS
MIN_BLOCK_CHARS = 25
SHORTCUT_TAGS = ["article", "main"]


#: Of the tokens that the node table is made from, these are dropped with all in them.
DROPPED = "(?is)\\A<(?:!--|(?:script|style|noscript)[ \\t\\n\\r\\f/>])"


def _tokens(html) -> "F.Column":
    """Tags (`>` in a quoted attribute is no end) and texts (a bare `<` is text) without comments, scripts and styles. Cut
    twice: once to find what is dropped, then what is left, so that texts around a comment are one."""
    kept = F.filter(page_tokens(html), lambda t: ~t.rlike(DROPPED))
    tokens = F.regexp_extract_all(F.array_join(kept, ""), F.lit(PLAIN_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: ~t.rlike("(?i)\\A<[a-z/!?]") | t.endswith(">"))  # cut off by the page's end


def html_tokens(pages: DataFrame, keep_raw: bool = False) -> DataFrame:
    """html_tokens(page_id, pos, kind, tag, depth, in_link, text, is_container[, raw])."""
    toks = pages.select("page_id", F.posexplode(_tokens("html")).alias("pos", "tok"))
    tok = F.col("tok")
    kind = (
        F.when(tok.rlike("(?i)\\A</[a-z]"), "close")
        .when(tok.rlike("\\A<[!?/]"), "decl")
        .when(tok.rlike("(?i)\\A<[a-z]"), "open")
        .otherwise("text")
    )
    tag = F.lower(F.regexp_extract(tok, "\\A</?([a-zA-Z][a-zA-Z0-9-]*)", 1))
    counting = ~F.col("tag").isin(*NON_COUNTING)
    delta = (
        F.when((F.col("kind") == "open") & counting & ~tok.rlike("/>\\z"), 1)
        .when((F.col("kind") == "close") & counting, -1)
        .otherwise(0)
    )
    link = F.when((F.col("kind") == "open") & (F.col("tag") == "a"), 1).when((F.col("kind") == "close") & (F.col("tag") == "a"), -1).otherwise(0)
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = toks.withColumn("kind", kind).withColumn("tag", tag).withColumn("delta", delta).withColumn("ld", link)
    return t.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        "kind",
        F.when(F.col("kind") == "text", F.lit(None).cast("string")).otherwise(F.col("tag")).alias("tag"),
        F.sum("delta").over(w).cast("bigint").alias("depth"),
        (F.sum("ld").over(w) > 0).alias("in_link"),
        F.when(F.col("kind") == "text", js_trim(decode_entities(collapse_ws(tok)))).alias("text"),
        (F.col("delta") == 1).alias("is_container"),
        *([tok.alias("raw")] if keep_raw else []),
    )


def with_parents(tokens: DataFrame) -> DataFrame:
    """Text and container tokens with `parent` (position of the enclosing
    container, NULL at top level) and `gparent` (the parent's parent).

    One pass, two windows, no self-join: containers register at their own
    level and look up their parent one level up, text looks up at its depth
    (window per page and level, `last(…, ignorenulls)`); the grandparent is
    then spread from each container to its direct text with a window per
    (page, container)."""
    t = tokens.filter(F.col("is_container") | (F.col("kind") == "text"))
    fields = [F.col(c) for c in ("pos", "kind", "tag", "depth", "in_link", "text", "is_container")]
    reg = F.when(F.col("is_container"), F.struct(F.col("depth").alias("lvl"), F.col("pos").alias("reg"),
                                                 F.lit(False).alias("lookup"), *fields))
    look = F.struct(
        F.when(F.col("is_container"), F.col("depth") - 1).otherwise(F.col("depth")).alias("lvl"),
        F.lit(None).cast("bigint").alias("reg"), F.lit(True).alias("lookup"), *fields,
    )
    rows = t.select("page_id", F.explode(F.filter(F.array(reg, look), lambda x: x.isNotNull())).alias("r")).select("page_id", "r.*")
    w = Window.partitionBy("page_id", "lvl").orderBy("pos", "lookup").rowsBetween(Window.unboundedPreceding, 0)
    withp = rows.withColumn("parent", F.last("reg", ignorenulls=True).over(w)).filter("lookup").drop("lvl", "reg", "lookup")
    key = F.when(F.col("is_container"), F.col("pos")).otherwise(F.col("parent"))
    w2 = Window.partitionBy("page_id", "key")
    return withp.withColumn("key", key).withColumn(
        "gparent", F.max(F.when(F.col("is_container"), F.col("parent"))).over(w2)
    ).drop("key")


def container_scores(tokens: DataFrame) -> DataFrame:
    """Per container: tag, level, direct text and link characters, link
    density and the reader score — one aggregation over per-token
    contributions (own row, credit to parent, half credit to grandparent)."""
    tp = with_parents(tokens)
    n = F.length("text")
    is_text = F.col("kind") == "text"
    block = is_text & ~F.col("in_link") & (n >= MIN_BLOCK_CHARS)
    s = (1 + (n - F.length(F.replace("text", F.lit(","), F.lit("")))) + F.least(F.floor(n / 100), F.lit(3))).cast("double")

    def contrib(cid, is_c, credit, tchars, lchars):
        return F.struct(cid.cast("bigint").alias("cid"), F.lit(is_c).alias("is_c"), credit.cast("double").alias("credit"),
                        tchars.cast("bigint").alias("tchars"), lchars.cast("bigint").alias("lchars"))

    own = F.when(F.col("is_container"), contrib(F.col("pos"), True, F.lit(0.0), F.lit(0), F.lit(0)))
    to_parent = F.when(is_text & F.col("parent").isNotNull(),
                       contrib(F.col("parent"), False, F.when(block, s).otherwise(F.lit(0.0)), n,
                               F.when(F.col("in_link"), n).otherwise(F.lit(0))))
    to_gparent = F.when(block & F.col("gparent").isNotNull(), contrib(F.col("gparent"), False, s / 2, F.lit(0), F.lit(0)))
    rows = tp.select(
        "page_id", F.when(F.col("is_container"), F.col("tag")).alias("ctag"),
        F.when(F.col("is_container"), F.col("depth")).alias("clevel"),
        F.explode(F.filter(F.array(own, to_parent, to_gparent), lambda x: x.isNotNull())).alias("c"),
    )
    agg = rows.groupBy("page_id", F.col("c.cid").alias("container_pos")).agg(
        F.max(F.col("c.is_c")).alias("is_c"),
        F.max(F.when(F.col("c.is_c"), F.col("ctag"))).alias("tag"),
        F.max(F.when(F.col("c.is_c"), F.col("clevel"))).alias("level"),
        F.sum("c.credit").alias("raw_score"),
        F.sum("c.tchars").cast("bigint").alias("text_chars"),
        F.sum("c.lchars").cast("bigint").alias("link_chars"),
    ).filter("is_c")
    ld = F.when(F.col("text_chars") > 0, F.col("link_chars") / F.col("text_chars")).otherwise(F.lit(0.0))
    return agg.select(
        "page_id", "container_pos", "tag", "level", "text_chars", "link_chars",
        F.round(ld, 6).alias("link_density"), F.round(F.col("raw_score") * (F.lit(1.0) - ld), 6).alias("score"),
    )


def choose_container(sc: DataFrame) -> DataFrame:
    """Per page: the only `<article>`/`<main>` if there is exactly one, else the
    best-scoring container (ties: first in the page)."""
    attrs = F.struct("container_pos", "tag", "level", "score", "link_density")
    short = F.col("tag").isin(*SHORTCUT_TAGS)
    per_page = sc.groupBy("page_id").agg(
        F.count_if(short).alias("n_short"),
        F.min(F.when(short, attrs)).alias("short"),
        F.max_by(attrs, F.struct("score", (-F.col("container_pos")).alias("neg_pos"))).alias("best"),
    )
    return per_page.select("page_id", F.when(F.col("n_short") == 1, F.col("short")).otherwise(F.col("best")).alias("c")).select(
        "page_id", "c.*"
    )


def _range(tokens: DataFrame, chosen: DataFrame, payload: str, keep) -> DataFrame:
    """(page_id, end_pos, items): tokens after the chosen container's open tag,
    up to the first later token outside it (its close tag)."""
    t = tokens.join(chosen.select("page_id", "container_pos", "level"), "page_id")
    after = F.col("pos") > F.col("container_pos")
    rng = t.groupBy("page_id").agg(
        F.min(F.when(after & (F.col("depth") < F.col("level")), F.col("pos"))).alias("end_pos"),
        F.collect_list(F.when(after & keep, F.struct("pos", F.col(payload).alias("v")))).alias("items"),
    )
    inside = F.filter(F.array_sort("items"), lambda x: F.col("end_pos").isNull() | (x["pos"] < F.col("end_pos")))
    return rng.select("page_id", F.transform(inside, lambda x: x["v"]).alias("items"))


def main_content(tokens: DataFrame) -> DataFrame:
    """Best container per page and its text (the text tokens of its range)."""
    chosen = choose_container(container_scores(tokens))
    rng = _range(tokens, chosen, "text", (F.col("kind") == "text") & (F.col("text") != ""))
    text = rng.select("page_id", F.array_join("items", " ").alias("text"))
    return chosen.join(text, "page_id", "left").select(
        "page_id", "container_pos", "tag", "score", "link_density", F.coalesce("text", F.lit("")).alias("text")
    )


def scored_main_html(pages: DataFrame) -> DataFrame:
    """(page_id, main_html): inner HTML of the chosen container, '' when no
    text block scored at all (reader mode found nothing)."""
    tokens = html_tokens(pages, keep_raw=True)
    chosen = choose_container(container_scores(tokens))
    rng = _range(tokens, chosen, "raw", F.lit(True))
    html = chosen.join(rng, "page_id", "left").select(
        "page_id",
        F.when(F.col("score") > 0, F.array_join(F.coalesce("items", F.array()), "")).otherwise(F.lit("")).alias("main_html"),
    )
    return pages.select("page_id").join(html, "page_id", "left").select(
        "page_id", F.coalesce("main_html", F.lit("")).alias("main_html")
    )
