"""Property tests: Spark column functions against plain-Python definitions on
generated inputs (one DataFrame per property, many examples per job)."""

from __future__ import annotations

import math
import re
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import text as TX
from pagemill.functions import urls as U
from pagemill.operators import costs as C

SAFE = "!#$%&'()*+,-./0123456789:;=?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_abcdefghijklmnopqrstuvwxyz|~"


def _apply(spark, col_fn, values, ddl="s string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r.x for r in df.select(col_fn(F.col(df.columns[0])).alias("x")).collect()]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=30), min_size=1, max_size=40))
def test_percent_encode_matches_python(spark, values):
    got = _apply(spark, U.percent_encode, values)
    assert got == [urllib.parse.quote(v, safe=SAFE) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n ab,.", max_size=40), min_size=1, max_size=40))
def test_word_and_line_counts(spark, values):
    words = _apply(spark, TX.word_count, values)
    lines = _apply(spark, TX.line_count, values)
    ws = " \t\n\r\f\x0b "
    assert words == [len([w for w in "".join(c if c not in ws else " " for c in v).split(" ") if w]) for v in values]
    assert lines == [len(v.split("\n")) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**13), min_size=1, max_size=50))
def test_usd_text_is_half_up_of_exact_value(spark, values):
    got = _apply(spark, C.usd4_text, values, "n bigint")
    want = []
    for n in values:
        c4 = (n + 50000) // 100000  # nano-USD → 1e-4 USD, half up
        want.append(f"{c4 // 10000}.{c4 % 10000:04d}")
    assert got == want
    assert all(math.isclose(float(g), n / 1e9, abs_tol=5e-5) for g, n in zip(got, values))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"[a-z]{1,8}(/[a-z0-9][a-z0-9.]{0,5}|/\.|/\.\.){0,4}/?", fullmatch=True), min_size=1, max_size=30))
def test_path_key_shape(spark, paths):
    import posixpath

    urls = [f"https://Host.example/{p}" for p in paths]
    got = _apply(spark, U.path_key, urls)
    for p, k in zip(paths, got):
        trimmed = posixpath.normpath("/" + p).strip("/") or "index"
        if trimmed == ".":
            trimmed = "index"
        base = posixpath.basename(trimmed)
        m = re.match(r"^.+(\.[^.]*)$", base)  # Node's extname: last dot not leading the name
        stem = base[: len(base) - len(m.group(1))] if m else base
        d = posixpath.dirname(trimmed)
        want = posixpath.normpath("/".join(x for x in ["tmp", "host.example", d, stem, base] if x))
        assert k == want
