"""Sitemaps, robots files and API specifications, read from stored documents; and crawling over a stored page graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import html_unescape
from ..operators.filters import domain_allowed, url_host
from ..plans.scenario import yaml_to_json
from ..registry import Registry
from ..shared import settled
from ..views import pages, table

R = Registry()

#: Where sitemaps and specifications are looked for, and the methods of an API.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml", "/robots.txt")
SPEC_PATHS = ("/openapi.json", "/openapi.yaml", "/swagger.json", "/swagger.yaml", "/api-docs", "/v2/api-docs", "/v3/api-docs", "/api/openapi.json", "/api/swagger.json", "/docs/openapi.json", "/swagger/v1/swagger.json", "/api/v1/openapi.json")
METHODS = ("get", "post", "put", "delete", "patch", "head", "options")

OPERATION = "struct<summary:string,tags:array<string>,parameters:array<struct<name:string,`in`:string,required:boolean,type:string,schema:struct<type:string>>>,requestBody:struct<content:map<string,string>>,consumes:array<string>,security:array<map<string,array<string>>>>"
SPEC = f"struct<openapi:string,swagger:string,host:string,basePath:string,schemes:array<string>,servers:array<struct<url:string>>,paths:map<string,struct<{','.join(f'`{m}`:{OPERATION}' for m in METHODS)}>>>"


def _tag(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?s)<{name}[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
    return F.when(inner != "", html_unescape(inner))


def sitemap_urls(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, loc, lastmod, changefreq, priority) of each document: its `url` blocks, or, if it is no XML, its lines that start with http."""
    blocks = F.regexp_extract_all(text_col, F.lit(r"(?s)<url(?:\s[^>]*)?>.*?</url>"), F.lit(0))
    lines = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("http"))
    plain = ~F.col(text_col).contains("<urlset") & ~F.col(text_col).contains("<sitemapindex")
    rows = documents.select(id_col, F.explode(F.when(plain, lines).otherwise(blocks)).alias("b"), plain.alias("plain"))
    loc = F.when(F.col("plain"), F.col("b")).otherwise(_tag(F.col("b"), "loc"))
    priority = F.coalesce(_tag(F.col("b"), "priority").try_cast("double"), F.lit(0.0))
    return rows.select(id_col, loc.alias("loc"), _tag(F.col("b"), "lastmod").alias("lastmod"), _tag(F.col("b"), "changefreq").alias("changefreq"), priority.alias("priority"))


def sitemap_children(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, child) of sitemap indexes: the documents that they name, to be joined with the stored ones, level by level."""
    blocks = F.regexp_extract_all(text_col, F.lit(r"(?s)<sitemap(?:\s[^>]*)?>.*?</sitemap>"), F.lit(0))
    return documents.select(id_col, F.explode(blocks).alias("b")).select(id_col, _tag(F.col("b"), "loc").alias("child"))


def all_sitemap_urls(stored: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Distinct urls below the roots; stored: (url, text), roots: (url). The first in order of (level, url) is kept.

    Indexes are followed to their end, or `depth` levels; a document is read once, so that indexes that name each other end too.
    """
    found = settled(roots.distinct().join(stored, "url").select("url", "text", F.lit(0).alias("level")))
    level, k = found, 0
    while depth is None or k < depth:
        k += 1
        names = sitemap_children(level, "url", "text").select(F.col("child").alias("url")).where("url is not null").distinct()
        level = settled(names.join(found.select("url"), "url", "left_anti").join(stored, "url").select("url", "text", F.lit(k).alias("level")))
        if not level.take(1):
            break
        found = found.unionByName(level)
    urls = sitemap_urls(found, "url", "text").join(found.select("url", "level").distinct(), "url")
    first = Window.partitionBy("loc").orderBy("level", "url")
    return urls.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "level")


def robots_sitemaps(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sitemap): the value behind the first colon of lines that start with `sitemap:`, whatever their case."""
    lines = documents.select(id_col, F.explode(F.split(text_col, "\n")).alias("line")).select(id_col, F.trim(F.regexp_replace("line", "\r$", "")).alias("line"))
    hit = lines.where(F.lower("line").startswith("sitemap:"))
    return hit.select(id_col, F.trim(F.expr("substr(line, instr(line, ':') + 1)")).alias("sitemap"))


def discovered(bases: DataFrame, responses: DataFrame, paths: tuple[str, ...], types: tuple[str, ...] = ()) -> DataFrame:
    """base and url of each well-known path for which a stored response has status 200 (and one of the content types)."""
    candidates = bases.select("base", F.explode(F.array(*[F.lit(p) for p in paths])).alias("path")).select("base", F.concat("base", "path").alias("url"))
    good = responses.where("status_code = 200")
    if types:
        good = good.where(F.lower("content_type").rlike("|".join(types)))
    return candidates.join(good.select("url").distinct(), "url", "left_semi")


def json_of_yaml(text: Column) -> Column:
    """JSON texts as they are, YAML texts as JSON, in Arrow batches; null for what is neither."""

    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else x if x.lstrip()[:1] in ("{", "[") else yaml_to_json(x))

    convert.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(convert, "string")(text)


def api_endpoints(documents: DataFrame, id_col: str, text_col: str, url_col: str | None = None, yaml: bool = False) -> DataFrame:
    """One row per path and method of JSON specifications (with yaml, of YAML ones as well), versions 2 and 3; documents that do not parse give none.

    The server is servers[0], else scheme, host and base path; a relative one is put behind the document's own origin.
    """
    if yaml:
        documents = documents.withColumn(text_col, json_of_yaml(F.col(text_col)))
    spec = documents.select(id_col, F.col(url_col).alias("__own") if url_col else F.lit("").alias("__own"), F.from_json(text_col, SPEC).alias("s")).where("s.paths is not null")
    old = F.concat(F.coalesce(F.get("s.schemes", F.lit(0)), F.lit("https")), F.lit("://"), F.coalesce("s.host", F.lit("")), F.coalesce("s.basePath", F.lit("")))
    server = F.coalesce(F.get("s.servers", F.lit(0))["url"], F.when(F.col("s.host").isNotNull(), old), F.col("s.basePath"), F.lit(""))
    origin = F.regexp_extract("__own", r"^[a-z]+://[^/?#]*", 0)
    server = F.regexp_replace(F.when(server.contains("://"), server).otherwise(F.concat(origin, server)), "/+$", "")
    paths = spec.select(id_col, server.alias("server"), F.explode("s.paths").alias("path", "item"))
    operations = F.array(*[F.struct(F.lit(m.upper()).alias("method"), F.col(f"item.{m}").alias("op")) for m in METHODS])
    one = paths.select(id_col, "server", "path", F.explode(F.filter(operations, lambda o: o["op"].isNotNull())).alias("o"))
    params = F.transform(F.coalesce(F.col("o.op.parameters"), F.array()), lambda p: F.struct(p["name"].alias("name"), p["in"].alias("location"), F.coalesce(p["required"], F.lit(False)).alias("required"), F.coalesce(p["type"], p["schema"]["type"], F.lit("string")).alias("type")))
    content = F.coalesce(F.get(F.array_sort(F.map_keys("o.op.requestBody.content")), F.lit(0)), F.get("o.op.consumes", F.lit(0)))
    return one.select(id_col, F.concat("server", "path").alias("url"), F.col("o.method").alias("method"), F.col("o.op.summary").alias("summary"), F.col("o.op.tags").alias("tags"), params.alias("params"), content.alias("content_type"))


def crawl(graph: DataFrame, start: str, max_depth: int = 3, max_urls: int = 1000, domains: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(url, depth) reached from start over stored edges (parent, url), breadth first; the first max_urls in order (depth, url).

    Each level is one join and one anti-join; the number of levels is bounded by max_depth.
    """
    edges = graph.where(domain_allowed(F.col("url"), domains or [], exclude))
    seen = graph.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    front = seen
    for depth in range(1, max_depth + 1):
        reached = edges.join(front.select(F.col("url").alias("parent")), "parent", "left_semi").select("url").distinct()
        front = settled(reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
    return seen.orderBy("depth", "url").limit(max_urls)


# --- Queries over documents made from pages ---------------------------------------------------------------------


def _sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sitemaps over all pages."""
    p = pages(spark, sf_dir)
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-0"), F.col("page_id") % 9 + 1, F.lit("</lastmod><priority>0."), F.col("page_id") % 10, F.lit("</priority></url>"))
    grouped = p.groupBy((F.col("page_id") % 10).alias("map_id")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("body"))
    return grouped.select("map_id", F.concat(F.lit('<?xml version="1.0"?><urlset>'), "body", F.lit("</urlset>")).alias("text"))


@R.query("sitemap_urls", "SELECT page_id % 10 AS map_id, url AS loc, '2024-01-0' || (page_id % 9 + 1) AS lastmod, CAST('0.' || (page_id % 10) AS DOUBLE) AS priority FROM pages")
def sitemap_urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap_urls(_sitemaps(spark, sf_dir), "map_id", "text").drop("changefreq")


@R.query("sitemap_union_distinct", "SELECT DISTINCT url AS loc FROM pages")
def sitemap_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = _sitemaps(spark, sf_dir).select(F.concat(F.lit("https://x/"), "map_id", F.lit(".xml")).alias("url"), "text")
    entries = F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(entries), ""), F.lit("</sitemapindex>")).alias("text")).select(F.lit("https://x/index.xml").alias("url"), "text")
    roots = spark.createDataFrame([("https://x/index.xml",)], "url string")
    return all_sitemap_urls(maps.unionByName(index), roots, 1).select("loc")


@R.query("robots_sitemaps", "SELECT page_id, url || '/map.xml' AS sitemap FROM pages")
def robots_sitemaps_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select("page_id", F.concat(F.lit("User-agent: *\nDisallow: /x\n  SiteMap: "), "url", F.lit("/map.xml\r\n")).alias("text"))
    return robots_sitemaps(p, "page_id", "text")


@R.query("sitemap_discovery", "SELECT 'https://h' || page_id AS base, 'https://h' || page_id || CASE page_id % 3 WHEN 0 THEN '/sitemap.xml' ELSE '/robots.txt' END AS url FROM pages WHERE page_id % 3 < 2")
def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select(F.concat(F.lit("https://h"), "page_id").alias("base"), (F.col("page_id") % 3).alias("k"))
    stored = p.select(F.concat("base", F.when(F.col("k") == 0, "/sitemap.xml").when(F.col("k") == 1, "/robots.txt").otherwise("/other")).alias("url"), F.lit(200).alias("status_code"), F.lit("text/xml").alias("content_type"))
    return discovered(p.select("base"), stored, SITEMAP_PATHS).select("base", "url")


@R.query("spec_discovery", "SELECT 'https://h' || page_id || '/openapi.json' AS url FROM pages WHERE page_id % 2 = 0")
def spec_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).select(F.concat(F.lit("https://h"), "page_id").alias("base"), (F.col("page_id") % 2).alias("k"))
    stored = p.select(F.concat("base", F.lit("/openapi.json")).alias("url"), F.lit(200).alias("status_code"), F.when(F.col("k") == 0, "application/json").otherwise("image/png").alias("content_type"))
    return discovered(p.select("base"), stored, SPEC_PATHS, ("json", "yaml", "text")).select("url")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    new = F.concat(F.lit('{"openapi":"3.0.0","servers":[{"url":"https://api.example.com/v'), "page_id", F.lit('/"}],"paths":{"/users":{"get":{"summary":"list","parameters":[{"name":"limit","in":"query","schema":{"type":"integer"}}]},"post":{"requestBody":{"content":{"application/json":{}}}}}}}'))
    old = F.concat(F.lit('{"swagger":"2.0","host":"h'), "page_id", F.lit('.example.com","basePath":"/v1","paths":{"/items/{id}":{"delete":{"tags":["x"],"parameters":[{"name":"id","in":"path","required":true,"type":"string"}]}}}}'))
    text = F.when(F.col("page_id") % 3 == 0, new).when(F.col("page_id") % 3 == 1, old).otherwise("not json")
    return p.select("page_id", text.alias("text"))


@R.query("openapi_endpoints", """SELECT page_id, 'https://api.example.com/v' || page_id || '/users' AS url, 'GET' AS method, 1 AS params FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'https://api.example.com/v' || page_id || '/users', 'POST', 0 FROM pages WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 'https://h' || page_id || '.example.com/v1/items/{id}', 'DELETE', 1 FROM pages WHERE page_id % 3 = 1""")
def openapi_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_endpoints(_specs(spark, sf_dir), "page_id", "text").select("page_id", "url", "method", F.size("params").alias("params"))


@R.query("yaml_endpoints", """SELECT page_id, 'https://y' || page_id || '.example.com/v1/things' AS url, 'GET' AS method, 'list things' AS summary, CAST(2 AS INTEGER) AS params FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'https://j/a', 'PUT', NULL, 0 FROM pages WHERE page_id % 4 = 1""")
def yaml_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications in YAML and in JSON, and texts that are neither."""
    k = F.col("page_id")
    yaml = F.concat(F.lit("openapi: 3.0.0\nservers:\n  - url: https://y"), k, F.lit(".example.com/v1\npaths:\n  /things:\n    get:\n      summary: list things\n      parameters:\n        - {name: a, in: query}\n        - {name: b, in: query}\n"))
    text = F.when(k % 2 == 0, yaml).when(k % 4 == 1, '{"swagger":"2.0","host":"j","paths":{"/a":{"put":{}}}}').otherwise("a: [b")
    specs = pages(spark, sf_dir).select("page_id", text.alias("text"))
    return api_endpoints(specs, "page_id", "text", yaml=True).select("page_id", "url", "method", "summary", F.size("params").alias("params"))


@R.query("nested_sitemaps", "SELECT DISTINCT url AS loc FROM pages")
def nested_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten sitemaps below a chain of seven indexes, the last of which names the first again; elements carry attributes."""
    name = lambda k: F.concat(F.lit("https://x/"), k, F.lit(".xml"))
    maps = _sitemaps(spark, sf_dir).select(name(F.col("map_id")).alias("url"), F.replace("text", F.lit("<url>"), F.lit('<url id="1">')).alias("text"))
    every = maps.agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), "")).scalar()
    k = spark.range(7).select((100 + F.col("id")).alias("k"))
    below = F.when(F.col("k") < 106, F.concat(F.lit('<sitemap n="1"><loc>'), name(F.col("k") + 1), F.lit("</loc></sitemap>"))).otherwise(F.concat(F.lit("<sitemap><loc>https://x/100.xml</loc></sitemap>"), every))
    chain = k.select(name(F.col("k")).alias("url"), F.concat(F.lit("<sitemapindex>"), below, F.lit("</sitemapindex>")).alias("text"))
    roots = spark.createDataFrame([("https://x/100.xml",)], "url string")
    return all_sitemap_urls(maps.unionByName(chain), roots).select("loc")


@R.query("endpoint_results", "SELECT 'openapi' AS type, 'integer' AS param_type, count(*) AS n FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 'openapi', 'string', count(*) FROM pages WHERE page_id % 3 = 1")
def endpoint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints as crawl results, with their parameters unnested."""
    e = api_endpoints(_specs(spark, sf_dir), "page_id", "text").select(F.lit("openapi").alias("type"), F.explode("params").alias("p"))
    return e.groupBy("type", F.col("p.type").alias("param_type")).agg(F.count("*").alias("n"))


@R.query("crawl_depths", """WITH RECURSIVE g AS (SELECT 'n' || o_custkey % 97 AS parent, 'n' || o_orderkey % 97 AS url FROM orders), w AS (SELECT 'n3' AS url, 0 AS depth UNION SELECT g.url, w.depth + 1 FROM w JOIN g ON g.parent = w.url WHERE w.depth < 2)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1""")
def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    graph = o.select(F.concat(F.lit("n"), F.col("o_custkey") % 97).alias("parent"), F.concat(F.lit("n"), F.col("o_orderkey") % 97).alias("url"))
    return crawl(graph, "n3", max_depth=2)


@R.query("url_hosts", "SELECT lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')) AS host, count(*) AS n FROM pages GROUP BY 1")
def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
