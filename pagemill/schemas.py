"""Explicit schemas: supplied tables and the tables this library produces.

Reads never infer a schema; every supplied table is read with the DDL below.
"""

from __future__ import annotations

# Supplied tables (read-only parquet under <sf_dir>/<name>.parquet).
SUPPLIED = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Tables of the web-corpus model (see README). Typed columns first.
CAPTURES = "url STRING, fetched_at TIMESTAMP_NTZ, attempt BIGINT, status INT, server STRING, html STRING"
SITEMAP_DOCS = "loc STRING, xml STRING"
SITEMAP_ENTRY = "array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"
MEDIA_OCCURRENCES = (
    "hash STRING, type STRING, page_path STRING, original_url STRING, ts TIMESTAMP_NTZ, "
    "content STRING, api_cost DOUBLE"
)
API_USAGE = (
    "page_id BIGINT, media_hash STRING, model STRING, prompt_tokens BIGINT, "
    "completion_tokens BIGINT, seconds DOUBLE"
)
PRICES = "model STRING, input_per_1k DOUBLE, output_per_1k DOUBLE, per_minute DOUBLE"
CONTENT_CACHE = "page_dir STRING, cache_key STRING, media_type STRING, content STRING, model STRING, ts TIMESTAMP_NTZ"
MEDIA_METADATA = (
    "struct<format:string,size:bigint,mimeType:string,width:int,height:int,duration:double,"
    "bitrate:bigint,channels:int,sampleRate:int,originalUrl:string>"
)
REGISTRY_ENTRY = (
    "struct<type:string,hash:string,content:string,"
    "occurrences:array<struct<pagePath:string,originalUrl:string,timestamp:string>>,"
    f"firstProcessed:string,lastUsed:string,metadata:{MEDIA_METADATA},apiCost:double>"
)
REGISTRY_FILE = f"entries map<string,{REGISTRY_ENTRY}>, stats string"
