"""URL scalar functions (Column → Column), all built-in expressions.

`host`/`path` follow the WHATWG URL results the reference relies on
(hostname lower-cased, path encoded and folded, empty path → '/'). URLs are cut
by pattern before they are encoded, so a space or a bar in a path is data, not
an error; a text that is no absolute URL gives NULL, and one bad row never
fails a task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import col_

SCHEME_RE = "\\A[a-zA-Z][a-zA-Z0-9+.\\-]*:"
ORIGIN_RE = "\\A([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)"
# Characters kept as they are when a resolved URL is serialised; everything
# else (non-ASCII, controls, space, quote, angle brackets, backtick, braces)
# is percent-encoded as UTF-8.
URL_SAFE_CHAR = "[!#-;=?-_a-z|~]"
#: In a path: `?`, `#` and `^` are encoded as well.
PATH_SAFE_CHAR = "[!$-;=@-\\]_a-z|~]"


#: scheme://[user@]authority, path, rest (query and fragment) of an absolute URL.
URL_RE = "\\A[ \\t\\n\\r]*([a-zA-Z][a-zA-Z0-9+.\\-]*:)//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"
HOST_RE = "\\A[ \\t\\n\\r]*[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^:/?#]*)"
# Default ports of the schemes met here.
DEFAULT_PORT = "\\A(http://[^/?#]*):80\\z|\\A(https://[^/?#]*):443\\z"


def host(url) -> Column:
    """`new URL(u).hostname`: lower-cased host, NULL when there is none."""
    return F.nullif(F.lower(F.regexp_extract(col_(url), HOST_RE, 1)), F.lit(""))


def fold_dot_segments(path) -> Column:
    """Remove `.` and `..` segments (also written `%2e`) from a '/'-rooted path,
    however many there are. Paths without such a segment skip the fold."""
    p = col_(path)
    segs = F.split(p, "/")

    def step(acc: Column, seg: Column) -> Column:
        s = F.replace(F.lower(seg), F.lit("%2e"), F.lit("."))
        return F.when(s == "..", F.regexp_replace(acc, "/[^/]*\\z", "")).when(s == ".", acc).otherwise(F.concat(acc, F.lit("/"), seg))

    folded = F.aggregate(F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0))), F.lit(""), step)
    last = F.replace(F.lower(F.element_at(segs, -1)), F.lit("%2e"), F.lit("."))
    folded = F.concat(folded, F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(p.rlike(DOT_SEGMENT), folded).otherwise(p)


DOT_SEGMENT = "(?i)/(?:\\.|%2e){1,2}(?:/|\\z)"


def path(url) -> Column:
    """`new URL(u).pathname`: percent-encoded, dot segments folded, '' becomes '/';
    NULL when the URL is not absolute."""
    c = col_(url)
    p = fold_dot_segments(percent_encode_path(F.regexp_extract(c, URL_RE, 3)))
    return F.when(c.rlike(URL_RE), F.regexp_replace(p, "\\A\\z", "/"))


def sanitize_path(p) -> Column:
    """Replace `< > : " | ? * \\` by `_`."""
    return F.translate(col_(p), '<>:"|?*\\', "________")


def _encoded(c: Column, safe: str) -> Column:
    enc = F.transform(
        F.split(c, ""),
        lambda ch: F.when(ch.rlike(f"\\A{safe}\\z"), ch).otherwise(F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")),
    )
    return F.when(c.rlike(f"[^{safe[1:]}"), F.array_join(enc, "")).otherwise(c)


def percent_encode_path(p) -> Column:
    """Path percent-encoding of a URL parser: controls, space, `"`, `#`, `<`, `>`, `?`, `` ` ``,
    `{`, `}`, `^` and everything beyond ASCII; `%` is kept, so nothing is encoded twice."""
    return _encoded(col_(p), PATH_SAFE_CHAR)


def percent_encode(s) -> Column:
    """Percent-encode (UTF-8, upper-case hex) every character outside the URL-safe
    ASCII set. Rows that need no encoding skip the per-character work."""
    return _encoded(col_(s), URL_SAFE_CHAR)


def drop_default_port(head) -> Column:
    return F.regexp_replace(col_(head), DEFAULT_PORT, "$1$2")


def origin(url) -> Column:
    """`scheme://host[:port]` of an absolute URL, lower-cased, without user info and default port ('' if none)."""
    head = F.regexp_replace(F.lower(F.regexp_extract(col_(url), ORIGIN_RE, 1)), "://[^@]*@", "://")
    return drop_default_port(head)


def _tail(rest: Column) -> Column:
    """A '/'-rooted path with query and fragment: the path is encoded and folded, the rest encoded."""
    p = F.regexp_extract(rest, "\\A[^?#]*", 0)
    return F.concat(fold_dot_segments(percent_encode_path(p)), percent_encode(F.regexp_extract(rest, "\\A[^?#]*(.*)\\z", 1)))


def normalize_absolute(u) -> Column:
    """`new URL(u).toString()` of an absolute http(s) URL: lower-case scheme and host, no default
    port, a folded and encoded path that is at least '/'."""
    c = col_(u)
    head = F.lower(F.regexp_extract(c, ORIGIN_RE, 1))
    rest = F.regexp_extract(c, "\\A[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*(.*)\\z", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(head != "", F.concat(drop_default_port(head), _tail(rest))).otherwise(c)


def resolve_against_origin(href, page_url, base: str = "origin") -> Column:
    """`new URL(href, base).toString()` for the href shapes met in pages: absolute,
    protocol-relative, root-relative and relative. `base='origin'` resolves relative ones
    against the page's origin (what the reference does), `base='page'` against the page."""
    h = F.regexp_replace(col_(href), "\\A[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+\\z", "")
    o = origin(page_url)
    scheme = F.regexp_extract(o, "\\A([a-z][a-z0-9+.\\-]*:)", 1)
    if base == "origin":
        folder, here = F.lit("/"), F.lit("/")
    elif base == "page":
        here = F.regexp_replace(F.regexp_extract(col_(page_url), URL_RE, 3), "\\A\\z", "/")
        folder = F.regexp_extract(here, "\\A(.*/)", 1)
    else:
        raise ValueError(f"base is 'origin' or 'page', not {base!r}")
    query = F.when(h.startswith("#"), F.regexp_extract(col_(page_url), "\\A[^?#]*([?][^#]*)", 1)).otherwise(F.lit("")) if base == "page" else F.lit("")
    rest = (
        F.when(h.startswith("/"), h)
        .when(h.startswith("?") | h.startswith("#") | (h == ""), F.concat(here, query, h))
        .otherwise(F.concat(folder, h))
    )
    return (
        F.when(h.startswith("//"), normalize_absolute(F.concat(scheme, h)))
        .when(h.rlike(SCHEME_RE), F.when(h.rlike("(?i)\\Ahttps?://"), normalize_absolute(h)).otherwise(h))
        .otherwise(F.concat(o, _tail(rest)))
    )


# dir (with its trailing '/'), stem, extension of a slash-trimmed path, with
# Node's `path.extname` rule (the last dot, not leading the name).
KEY_RE = "\\A((?:.*/)?)([^/]+?)((?:\\.[^./]*)?)\\z"


def path_key(url, base_dir: str = "tmp", filename: str | None = None) -> Column:
    """URL → `base/host/dirname(path)/stem/filename` (query and fragment dropped;
    empty path → `index`)."""
    p = F.regexp_replace(F.regexp_replace(path(url), "\\A/+|/+\\z", ""), "\\A\\z", "index")
    tail = F.regexp_replace(p, KEY_RE, "$1$2/" + (filename.replace("\\", "\\\\").replace("$", "\\$") if filename else "$2$3"))
    return F.regexp_replace(F.concat(F.lit(base_dir + "/"), host(url), F.lit("/"), tail), "/+", "/")


def dir_key(url, base_dir: str = "tmp") -> Column:
    """Asset directory of a URL: its path key without the file name."""
    return F.regexp_replace(path_key(url, base_dir), "/[^/]+\\z", "")


def markdown_paths(url, output_base: str = "output", processed: str = "pages"):
    """(tmp Markdown path, processed output path) of a page URL:
    `.html` → `.md`, processed = `output/pages/<last dir>/<file>`."""
    tmp_md = F.regexp_replace(path_key(url), "\\.html\\z", ".md")
    return tmp_md, F.regexp_replace(tmp_md, "\\A.*/([^/]+/[^/]+)\\z", f"{output_base}/{processed}/$1")


def merged_path(source, output_base: str = "output", merged: str = "merged") -> Column:
    """Path of a site's merged document: `<base>/<merged>/<sitemap name without extension>-merged.md`."""
    name = F.regexp_extract(F.regexp_replace(col_(source), "[/\\\\]+\\z", ""), "[^/\\\\]*\\z", 0)
    return F.concat(F.lit(f"{output_base}/{merged}/"), F.regexp_replace(name, "(.)\\.[^.]*\\z", "$1"), F.lit("-merged.md"))


def local_markdown_paths(file_path, root, output_base: str = "output"):
    """(intermediate, output) Markdown paths of a local page: its path relative to `root`, mirrored
    below `tmp` and below the output folder, without `.htm(l)`."""
    p = F.regexp_replace(col_(file_path), "\\A(?:file:)?/*", "/")
    r = F.regexp_replace(F.lit(root) if isinstance(root, str) else root, "/+\\z", "")
    inside = p.startswith(F.concat(r, F.lit("/")))
    rel = F.when(inside, F.substr(p, F.length(r) + 2)).otherwise(F.regexp_replace(p, "\\A/", ""))
    rel = F.regexp_replace(rel, "\\.html?\\z", "")
    return F.concat(F.lit("tmp/"), rel, F.lit(".md")), F.concat(F.lit(output_base + "/"), rel, F.lit(".md"))
