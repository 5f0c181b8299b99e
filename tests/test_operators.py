"""Single operators on small rows: the values of the fixtures, edges, and streams against their batch forms."""

import glob
import json
import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import scoring, similarity, templates, text
from quillstone.operators import baseline, coverage, extract, filters, joins, ordered, stats, variants
from quillstone.plans import scenario
from quillstone.sources import containers, documents, stores
from quillstone.streaming import stateful


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def age(folder, part):
    """Give the files written last their place in the order in which a stream reads files, which is that of their times."""
    for path in glob.glob(f"{folder}/part-*"):
        if os.path.getmtime(path) > 1_600_000_000:
            os.utime(path, (1_500_000_000 + part * 60,) * 2)


def values(spark, rows, schema, column):
    return [r.x for r in spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(k, *r) for k, r in enumerate(rows)], "k int, " + schema).orderBy("k").select(column.alias("x")).collect()]


MS = 1_000_000


def samples(spark, rows):
    made = [(k, datetime(2024, 1, 1, 0, 0, k), t * MS, n, status, "w " * words) for k, (t, n, words, status) in enumerate(rows)]
    return spark.createDataFrame(made, "seq long, ts timestamp_ntz, response_time_ns long, content_length long, status_code int, body string")


def test_baseline_statistics(spark):
    b = baseline.baseline_stats(samples(spark, [(100, 1000, 50, 200), (150, 1200, 60, 200), (200, 800, 40, 200)])).first()
    assert (b.n, b.avg_time_ns, b.min_time_ns, b.max_time_ns, b.avg_length, b.statuses) == (3, 150 * MS, 100 * MS, 200 * MS, 1000.0, [200])
    assert b.std_time_ns == int(np.sqrt(2 / 3 * 50**2) * MS)


@pytest.mark.parametrize(
    "multiples, probe, types",
    [((2, 10), (300, 1000, 200), ["slow_response"]), ((2, 10), (120, 1000, 200), []), ((10, 2), (100, 3000, 200), ["long_response"]), ((10, 10), (100, 1000, 500), ["unexpected_status"]), ((2, 2), (300, 3000, 500), ["slow_response", "long_response", "unexpected_status"])],
)
def test_anomalies(spark, multiples, probe, types):
    base = baseline.baseline_stats(samples(spark, [(100, 1000, 50, 200)] * 5))
    time, length, status = probe
    got = baseline.scored(samples(spark, [(time, length, 50, status)]), base, None, *multiples).first()
    assert got.types == types


def test_scores_and_classes(spark):
    score = lambda t, n, known, sim=None: one(spark, scoring.composite_score(F.lit(t), F.lit(n), F.lit(known), None if sim is None else F.lit(sim)))
    assert score(1.0, 1.0, True) == 0 and score(2.0, 1.0, True) == 25 and score(9.0, 9.0, True) == 100 and score(0.0, 0.0, True) == 0
    assert score(0.5, 0.5, True) == 0 and abs(score(1.0, 1.0, False) - 20) < 1e-9 and abs(score(1.0, 1.0, True, 50.0) - 15 / 0.7) < 1e-9
    classes = [(500, 0.0, False), (200, 70.0, False), (200, 40.0, True), (200, 1.0, True), (200, 1.0, False)]
    assert values(spark, classes, "s int, v double, a boolean", scoring.classification(F.col("s"), F.col("v"), F.col("a"))) == ["error", "anomaly", "interesting", "anomaly", "normal"]
    assert values(spark, [2.59, 0.5, 10.0, 33.0], "m double", scoring.multiple_text(F.col("m"))) == ["2.5", "0.5", "10+", "10+"]
    assert values(spark, [0, 5, 10, 20, 30, 50, 100, 150, 200, 250], "d int", scoring.tlsh_level(F.col("d"))) == ["identical", "nearly_same", "nearly_same", "very_similar", "very_similar", "similar", "similar", "somewhat_similar", "somewhat_similar", "different"]
    assert values(spark, [0, 1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 127, 128, 255], "h int", scoring.hit_bucket(F.col("h"))) == [0, 1, 2, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8]
    assert one(spark, scoring.timing_ratio(F.lit(500), F.lit(100))) == 5.0 and one(spark, scoring.timing_ratio(F.lit(5), F.lit(0))) is None


def test_filters(spark):
    hidden = lambda rows, reason: [x is not None for x in values(spark, rows, "n int", reason)]
    n = F.col("n")
    assert hidden([50, 100, 500, 1000, 1500], filters.number_filter(n, "length", 100, 1000)) == [True, False, False, False, True]
    assert hidden([100, 150, 200, 250, 300], filters.number_filter(n, "length", exact=(100, 200, 300))) == [True, False, True, False, True]
    words = values(spark, ["one two three", "a b c d e f g h i j k", ""], "t string", text.word_count(F.col("t")))
    assert words == [3, 11, 0] and values(spark, ["", "a", "a\nb\n"], "t string", text.line_count(F.col("t"))) == [0, 1, 3]
    assert hidden([200, 404], filters.status_filter(n, show=(200,), hide=(200,))) == [False, True]
    chain = {"a": F.when(n > 1, "big"), "b": F.when(n > 2, "bigger")}
    assert values(spark, [1, 2, 3], "n int", filters.chain_all(chain)) == [None, None, "all filters triggered"]
    assert values(spark, [1, 2, 3], "n int", filters.chain_any(chain)["name"]) == [None, "a", "a"]
    assert one(spark, filters.chain_any({})) is None and one(spark, filters.chain_all({})) is None


def test_urls(spark):
    allowed = filters.domain_allowed(F.col("u"), ["example.com"], [r"\.pdf$", "/admin/"])
    assert values(spark, ["http://example.com/page", "http://sub.example.com/", "http://other.com/", "http://example.com/f.pdf", "http://example.com/admin/x", "http://notexample.com/"], "u string", allowed) == [True, True, False, False, False, False]
    kind = filters.url_type(F.col("u"), F.col("c"))
    assert values(spark, [("/x", "application/json; charset=utf-8"), ("/x", "text/javascript"), ("/v1/data", ""), ("style.css", ""), ("/page", "text/html")], "u string, c string", kind) == ["api", "js", "api", "static", "page"]
    base = "http://example.com/dir/"
    assert [extract.resolved(base, x) for x in ("/other", "file.html", "http://a/b", "#x", "javascript:1", "mailto:a", "../up", "", None)] == ["http://example.com/other", base + "file.html", "http://a/b", "", "", "", "http://example.com/up", "", ""]


def test_type_inference(spark):
    cases = {
        '{"key": "value"}': "json", "[1, 2, 3]": "json", "<root>data</root>": "xml", "<html><p>": "html", "aaaa.bbbb.cccc": "jwt", "550e8400-e29b-41d4-a716-446655440000": "uuid",
        "test@example.com": "email", "https://example.com": "url", "12345": "integer", "-12345": "integer", "12.345": "float", "1.5e10": "float", "plain text": "string", "1234": "base64", "123456": "hex", "": "unknown", "{broken": "string",
    }
    assert values(spark, list(cases), "s string", text.inferred_type(F.col("s"))) == list(cases.values())
    assert values(spark, ["{x", "<a", "-", "12", "550e8400-e29b-41d4-a716-446655440000", "s"], "s string", text.quick_type(F.col("s"))) == ["json", "xml", "integer", "integer", "uuid", "string"]


def test_text_functions(spark):
    assert values(spark, [0, 999, 1000, 1500, 1_000_000, 1_500_000, 149_550, 648_050], "n long", text.number_text(F.col("n"))) == ["0", "999", "1.0K", "1.5K", "1.0M", "1.5M", "149.6K", "648.0K"]
    assert values(spark, [500_000, 50 * MS, 1500 * MS, 90_000 * MS, 5_400_000 * MS], "n long", text.duration_text(F.col("n"))) == ["500µs", "50ms", "1.5s", "1m30s", "1h30m"]
    assert values(spark, ["hello%20world", "test%2B123", "foo+bar", "no%encoding", "%zz%41"], "t string", text.url_decode_lenient(F.col("t"))) == ["hello world", "test+123", "foo bar", "no%encoding", "%zzA"]
    assert values(spark, ["1h2m3.5s", "250ms", "1µs", "-2s", "0", "5", "x"], "t string", text.duration_ns(F.col("t"))) == [3_723_500_000_000, 250 * MS, 1000, -2_000_000_000, 0, None, None]
    assert one(spark, text.html_unescape(F.lit("&lt;a&gt; &amp;lt; &#39;"))) == "<a> &lt; '" and one(spark, text.truncated(F.lit("abcdef"), 3)) == "abc..."


def test_similarity_vectors(spark):
    assert similarity.fnv1a(b"a") == 0xAF63DC4C8601EC8C and similarity.fnv1a(b"foobar") == 0x85944171F73967E8
    items = [b"", b"a", b"foobar", "ünï".encode(), b"x" * 100]
    assert similarity.fnv1a_many(items).tolist() == [similarity.fnv1a(x) for x in items]
    pairs = [(0xFFFF, 0xFFFF), (0xFFFE, 0xFFFF), (0xFFF0, 0xFFFF), (0, 0xFFFF), (-1, 0)]
    assert values(spark, pairs, "a long, b long", similarity.hamming(F.col("a"), F.col("b"))) == [0, 1, 4, 16, 64]
    page = "<html><body><div><p>Hello</p><p>World</p></div></body></html>"
    assert one(spark, similarity.html_paths(F.lit(page))) == ["html", "html>body", "html>body>div", "html>body>div>p", "html>body>div>p"]
    a, b, c = (x.encode() for x in ("The quick brown fox jumps over the lazy dog", "The quick brown fox jumps over the lazy cat", "Completely different content here"))
    near = lambda x, y: 1 - ((similarity.byte_simhash(x) ^ similarity.byte_simhash(y)) & (1 << 64) - 1).bit_count() / 64
    assert near(a, b) >= 0.7 and near(a, b) > near(a, c)
    assert (similarity.minhash(a) == similarity.minhash(b)).mean() >= 0.5
    assert similarity.feature_simhash([]) == 0 and np.uint64(np.int64(similarity.byte_simhash(b""))) == similarity.FNV64_OFFSET
    rows = spark.createDataFrame([(1, a.decode()), (2, "!!!"), (3, "")], "k int, t string").select("k", similarity.simhash_text(F.col("t")).alias("h"), similarity.word_ngrams(F.col("t")).alias("g")).orderBy("k").collect()
    assert rows[0].h == similarity.feature_simhash([g.lower().encode() for g in rows[0].g]) and rows[2].h == 0 and rows[1].g == ["!!!"]


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a = bytes(rng.integers(97, 123, 400).astype(np.uint8))
        b = a[:250] + bytes(rng.integers(97, 123, 150).astype(np.uint8))
        x, y = ({bytes(r) for r in similarity.byte_shingles(d)} for d in (a, b))
        truth = len(x & y) / len(x | y)
        assert abs((similarity.minhash(a, 512) == similarity.minhash(b, 512)).mean() - truth) < 3 / np.sqrt(512)


def test_banded_pairs_find_all(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 40)
    hashes = {int(h) for h in base} | {int(h) ^ (1 << int(rng.integers(63))) for h in base} | {int(h) ^ 7 for h in base}
    got = {(r.a, r.b) for r in similarity.hamming_pairs(spark.createDataFrame([(h,) for h in hashes], "h long"), 3).collect()}
    assert got == {(a, b) for a in hashes for b in hashes if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_lsh_candidates_hold_equal_texts(spark):
    rows = spark.createDataFrame([(1, "a text that is long enough"), (2, "a text that is long enough"), (3, "something else entirely, really")], "id int, t string")
    sig = rows.select("id", similarity.minhash_signature(F.col("t"), 100).alias("sig"))
    pairs = {(r.probe, r.candidate) for r in similarity.lsh_candidates(sig, sig, "id", "id").collect()}
    assert {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)} <= pairs and (1, 3) not in pairs


def test_tlsh():
    a = bytes(np.random.default_rng(0).integers(0, 256, 2000).astype(np.uint8))
    b = a[:1900] + b"z" * 100
    c = bytes(np.random.default_rng(9).integers(0, 256, 2000).astype(np.uint8))
    x, y, z = map(similarity.tlsh, (a, b, c))
    assert len(x) == 35 and similarity.tlsh_distance(x, x) == 0 and similarity.tlsh_distance(x, y) == similarity.tlsh_distance(y, x)
    assert similarity.tlsh_distance(x, y) < similarity.tlsh_distance(x, z)
    assert similarity.tlsh(b"short") is None and similarity.tlsh(b"a" * 500) is None


def test_extraction(spark):
    rules = [
        extract.Rule("id", "regex", r"""user_id["\s]*[:=]\s*["']?(\d+)"""), extract.Rule("name", "jsonpath", "data.user.name", transform="upper"), extract.Rule("item", "jsonpath", "items.0.id"),
        extract.Rule("status", "custom", "status_code"), extract.Rule("size", "custom", "body_length"), extract.Rule("loc", "header", "location"), extract.Rule("sid", "cookie", "PHPSESSID"), extract.Rule("need", "xpath", "//x", required=True), extract.Rule("dflt", "jsonpath", "no.such", default="d"),
    ]
    body = '{"user_id": "12345", "data": {"user": {"name": "John Doe"}}, "items": [{"id": "abc123"}]}'
    rows = spark.createDataFrame([(1, body, {"Location": "/next"}, {"PHPSESSID": "s1"}, 200, "application/json")], "id int, body string, headers map<string,string>, cookies map<string,string>, status_code int, content_type string")
    got = {r.name: r for r in extract.extracted(rows, rules, "id").collect()}
    assert {k: v.value for k, v in got.items()} == {"id": "12345", "name": "JOHN DOE", "item": "abc123", "status": "200", "size": str(len(body)), "loc": "/next", "sid": "s1", "need": None, "dflt": "d"}
    assert got["need"].error and not got["dflt"].found and got["dflt"].error is None
    assert extract.extracted_maps(rows, rules, "id").first()["values"]["item"] == "abc123"


def test_patterns_headers_and_links(spark):
    rows = spark.createDataFrame([(1, "sql syntax error; password: x; sql syntax"), (2, "fine")], "id int, body string")
    found = extract.pattern_matches(rows, "id", "body").collect()
    assert [(r.id, r.position) for r in found if r.type == "sql_error"] == [(1, 0), (1, 0)] and {r.id for r in found} == {1}
    headers = spark.createDataFrame([(1, {"Content-Type": "x"}), (2, {"Server": "s", "X-Powered-By": "p", "X-Frame-Options": ""})], "id int, headers map<string,string>")
    audit = extract.header_audit(headers, "id").collect()
    assert sum(r.id == 1 for r in audit) == 7 and {r.header for r in audit if r.issue == "disclosed"} == {"Server", "X-Powered-By"}
    assert [r.header for r in audit if r.issue == "empty"] == ["X-Frame-Options"]
    page = '<a href="/x">1</a><a href="#y">2</a><form action="go" method="post"><input name=q><select name=s></form><img src="i.png">'
    rows = spark.createDataFrame([(1, "http://h/d/", page), (2, None, None)], "id int, url string, html string")
    got = [(r.kind, r.url, r.method, r.inputs) for r in extract.links_and_forms(rows, "id", "url", "html").collect()]
    assert got == [("link", "http://h/x", None, None), ("link", "http://h/d/i.png", None, None), ("form", "http://h/d/go", "POST", "q,s")]


def test_length_assertion_quirk(spark):
    row = spark.createDataFrame([("abcdef", 200)], "body string, status_code int")
    met = lambda **k: row.select(extract.assertion("length", "", ">3", **k).alias("x")).first().x
    assert not met() and met(compare_lengths=True)


def test_coverage(spark):
    e = lambda *x: one(spark, coverage.edge_index(F.lit(x[0]), F.lit(x[1]), 1024))
    assert (e(100, 200), e(300, 400)) == (250, 262)
    entries = spark.createDataFrame([(k, f"h{k}", 10, k, False, False) for k in range(10)], "doc_id int, hash string, size long, edges long, is_seed boolean, favored boolean")
    kept = coverage.corpus_minimise(entries)
    assert kept.count() == 9 and [r.doc_id for r in kept.where("favored").collect()] == [9]
    s = coverage.corpus_stats(spark.createDataFrame([(5, True, False), (12, False, False), (1, False, True)], "size long, is_seed boolean, favored boolean")).first()
    assert (s.entries, s.total, s.mean, s.largest, s.smallest, s.favored, s.seeds) == (3, 18, 6, 12, 1, 1, 1)
    empty = coverage.corpus_stats(spark.createDataFrame([], "size long, is_seed boolean, favored boolean")).first()
    assert tuple(empty) == (0,) * 7
    rows = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    totals = {r.id: r.total for r in coverage.running_total(rows, "id", "v", 5).collect()}
    assert totals == {k: sum(j % 7 for j in range(k + 1)) for k in range(1000)}


def test_joins(spark):
    base = spark.createDataFrame([("u", 200, "abc123", 100, 50 * MS)], "url string, status_code int, content_hash string, content_length long, response_time_ns long")
    for row, changed in ((("u", 200, "abc123", 100, 50 * MS), False), (("u", 500, "abc123", 100, 50 * MS), True), (("u", 200, "def456", 100, 50 * MS), True), (("u", 200, "abc123", 100, 76 * MS), True), (("u", 200, "abc123", 100, 75 * MS), False)):
        assert joins.baseline_diff(spark.createDataFrame([row], base.schema), base, "url").first().has_changes is changed
    snap = lambda *rows: spark.createDataFrame(list(rows), "id string, name string, status string")
    diff = lambda a, b: {(r.name, r.from_status, r.to_status) for r in joins.snapshot_diff(a, b).collect()}
    assert diff(snap(("abc", "web", "running"), ("def", "db", "running")), snap(("abc", "web", "exited"), ("def", "db", "running"))) == {("web", "running", "exited")}
    assert diff(snap(("abc", "web", "running"), ("del123456789xyz", "x", "exited")), snap(("abc", "web", "running"))) == {("del123456789", "exited", "removed")}
    assert diff(snap(("abc", "web", "running")), snap(("abc", "web", "running"), ("new", "n", "running"))) == set()
    tasks = spark.createDataFrame([("low", 1, 1), ("high", 10, 2), ("medium", 5, 3), ("never", -1, 4)], "id string, priority int, seq int")
    assert [r.id for r in ordered.pop_order(tasks).collect()] == ["high", "medium", "low"]


def test_request_statistics(spark):
    rows = spark.createDataFrame([(100, None, 200), (200, None, 200), (50, "timeout", 200)], "response_time_ns long, error string, status_code int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01'"))
    s = stats.request_stats(rows).first()
    assert (s.total, s.success, s.failure, s.timeouts) == (3, 2, 1, 1)
    e = stats.request_stats(rows.limit(0)).first()
    assert (e.total, e.sum_ns, e.min_ns, e.max_ns) == (0, 0, stats.NO_REQUEST_NS, 0)
    sev = spark.createDataFrame([(x,) for x in ("high", "critical", "medium", "low", "info")], "severity string")
    assert tuple(stats.severity_rollup(sev).first()) == (5, 2, 1, 2)


def test_variants(spark):
    assert variants.flip_bits(b"\x00", 0) == b"\x80" and variants.flip_bytes(b"ab", 1) == b"a\x9d" and variants.add_at(b"\xff", 0, 1) == b"\x00"
    assert variants.put_at(b"abcd", 1, -1, 16) == b"a\xff\xffd" and variants.swap_bytes(b"abcd", 1) == b"acbd" and variants.clone_at(b"abc", 0, 2, 3) == b"abcab"
    with pytest.raises(ValueError):
        variants.flip_bits(b"a", 8)
    assert dict(variants.json_variants('{"b":1,"a":2}'))["key"] == '{"A":2,"b":1}' and variants.json_variants("no") == [] and variants.xml_variants("no") == []
    assert dict(variants.xml_variants("<a>t</a>"))["cdata"] == "<a><![CDATA[t]]></a>"
    rows = spark.createDataFrame([(1, "hello"), (2, ""), (3, None)], "id int, t string")
    a, b = (sorted(map(str, variants.variants(rows, "id", "t", 3, chain=2).collect())) for _ in range(2))
    assert a == b and len(a) == 9
    assert one(spark, variants.mixed_scripts(F.lit("pаy"))) and not one(spark, variants.mixed_scripts(F.lit("pay")))


def test_templates():
    v = {"user": "bob", "type": "error"}
    assert templates.substitute("{{user}} {{x:none}} {{y}} {{?type==error|bad|good}} {{?exists:z|1|2}} {{upper(ab)}}", v) == "bob none {{y}} bad 2 AB"
    assert templates.substitute("{{urlencode(a b*)}} {{base64(hi)}} {{nope(1)}}", {}) == "a%20b%2A aGk= {{nope(1)}}"
    a = templates.substitute("{{random_hex(12)}} {{random_int(3,5)}} {{uuid()}} {{seq(a,b)}}", {}, "s")
    assert a == templates.substitute("{{random_hex(12)}} {{random_int(3,5)}} {{uuid()}} {{seq(a,b)}}", {}, "s")
    assert 3 <= int(a.split()[1]) <= 5 and len(a.split()[2]) == 36


def test_scenario_machine(tmp_path, spark):
    steps = [{"name": "a", "assert": [{"type": "status", "expected": "200"}], "retry": {"count": 2, "on_status": [503]}, "extract": [{"name": "id", "type": "regex", "pattern": r"id=(\d+)", "group": 1}]}, {"name": "b", "condition": "id==7", "assert": []}, {"name": "c", "condition": "!exists:id"}]
    ok = {"status_code": 200, "body": "id=7"}
    taken, success, error = scenario.walk(steps, {("a", 0): {"status_code": 503, "body": ""}, ("a", 1): ok, ("b", 0): ok})
    assert [(t["step"], t["retries"]) for t in taken] == [("a", 1), ("b", 0)] and success and not error
    taken, success, error = scenario.walk(steps, {("a", 0): {"status_code": 500, "body": ""}})
    assert len(taken) == 1 and not success and "'a'" in error
    loop = [{"name": "a", "on_success": "a"}]
    assert scenario.walk(loop, {("a", 0): ok}, most=5)[1:] == (False, "max steps exceeded (possible infinite loop)")
    assert not scenario.walk([{"name": "a"}], {("a", 0): ok}, most=1)[1]  # reaching the limit fails even at the end
    (tmp_path / "s.json").write_text(json.dumps({"name": "n", "steps": [{"name": "a", "request": {"url": "u"}}]}))
    (tmp_path / "s.yaml").write_text("name: y\nsteps:\n  - name: a\n    request: {url: u}\nodd: 1\n")
    assert scenario.read_scenarios(spark, str(tmp_path), strict=True).select("scenario.name").collect()[0].name == "n"
    assert {"n"} <= {r.name for r in scenario.read_scenarios(spark, str(tmp_path)).select("scenario.name").collect()}


def test_documents_and_containers(spark):
    index = "<sitemapindex><sitemap><loc>m1</loc></sitemap><sitemap><loc>m2</loc></sitemap></sitemapindex>"
    stored = spark.createDataFrame([("i", index), ("m1", "<urlset><url><loc>http://a/?x=1&amp;y=2</loc><priority>0.5</priority></url><url><loc>http://b</loc></url></urlset>"), ("m2", "http://b\n http://c\nnot one")], "url string, text string")
    got = documents.all_sitemap_urls(stored, spark.createDataFrame([("i",)], "url string")).collect()
    assert {r["loc"]: r.priority for r in got} == {"http://a/?x=1&y=2": 0.5, "http://b": 0.0, "http://c": 0.0}
    spec = spark.createDataFrame([(1, '{"openapi":"3.0.0","servers":[{"url":"/v1/"}],"paths":{"/users":{"get":{"parameters":[{"name":"n","in":"query"}]},"post":{}}}}'), (2, "{broken")], "id int, t string").withColumn("own", F.lit("https://h.example.com/openapi.json"))
    rows = documents.api_endpoints(spec, "id", "t", "own").orderBy("method").collect()
    assert [(r.method, r.url, len(r.params)) for r in rows] == [("GET", "https://h.example.com/v1/users", 1), ("POST", "https://h.example.com/v1/users", 0)]
    assert rows[0].params[0].type == "string"
    lines = spark.createDataFrame([('[{"Service":"s","Status":"up"},{}]',), ("{bad",), ("",)], "line string")
    assert [(r.name, r.status, r.ports) for r in containers.compose_services(lines).collect()] == [("s", "up", "")]


def test_stores(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# list\nalpha\n\n beta \n")
    assert sorted(r.value for r in stores.read_wordlist(spark, str(tmp_path / "words.txt")).collect()) == ["alpha", "beta"]
    entries = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("old", 1, "c")], "key string, created int, value string").withColumn("expires", F.when(F.col("key") == "old", F.expr("timestamp_ntz'2020-01-01'")))
    stores.cache_store(entries, str(tmp_path / "cache"))
    live = stores.cache_live(spark, str(tmp_path / "cache"), F.expr("timestamp_ntz'2024-01-01'")).collect()
    assert [(r.key, r.value) for r in live] == [("k", "b")]
    rows = spark.createDataFrame([(1, "high", "time", "d" * 600), (2, "low", "status", "<b>"), (3, "high", "time", "x")], "id int, severity string, type string, description string")
    content = stores.report(rows)
    assert content["severity"] == {"high": 2, "low": 1} and len(content["anomalies"][0]["description"]) == 503
    made = stores.Reports().all(content, datetime(2024, 1, 2, 3, 4, 5))
    assert sorted(made) == ["report_20240102_030405.html", "report_20240102_030405.json", "report_20240102_030405.md"]
    assert json.loads(made["report_20240102_030405.json"])["found"] == 3 and "&lt;b&gt;" in made["report_20240102_030405.html"] and "| high | 2 |" in made["report_20240102_030405.md"]
    corpus = spark.createDataFrame([("h1", "queue"), ("h2", "crashes")], "hash string, kind string")
    stores.write_corpus(corpus, str(tmp_path / "corpus"))
    assert [r.hash for r in stores.read_corpus(spark, str(tmp_path / "corpus"), "crashes").collect()] == ["h2"]


FOLDS = {
    "status": (stateful.status_changes, "seq long, from_status string, to_status string"),
    "throttle": (stateful.throttle(50.0), "seq long, allowed boolean"),
    "bucket": (stateful.token_bucket(1, 2), "seq long, allowed boolean"),
    "pool": (stateful.pool_put, "seq long, action string, size int"),
    "learn": (stateful.learn_then_score(3), "seq long, skew double"),
}


@pytest.mark.parametrize("name", sorted(FOLDS))
def test_stream_equals_batch(spark, tmp_path, name):
    fold, schema = FOLDS[name]
    rows = [(k, k % 3, float(k * 20), "ab"[k // 4 % 2], "v" + str(k % 4), 100 + k) for k in range(60)]
    kinds = "seq long, key int, t double, status string, value string, response_time_ns long"
    for part in range(3):  # three files in order, one per micro-batch
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], kinds).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        age(tmp_path / "in", part)
    wanted = stateful.in_batch(spark.createDataFrame(rows, kinds), "key", ["seq"], fold, schema)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stateful.in_stream(stream, "key", ["seq"], fold, schema).writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table(f"out_{name}")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect())) and wanted.count() > 0


def test_pool_limits():
    state = {}
    for k in range(150):
        out = stateful.pool_put(state, {"seq": k, "t": float(k), "value": str(k)})
    assert out[0]["action"] == "replaced" and len(state["entries"]) == 100 and state["entries"][0][0] == "50"
    assert stateful.pool_put(state, {"seq": 1, "t": 10_000.0, "value": "x"})[0] == {"seq": 1, "action": "added", "size": 1}


def test_lru():
    fold, state = stateful.lru_cache(10), {}
    do = lambda op, key, t=0.0, size=4: fold(state, {"seq": 0, "op": op, "key": key, "t": t, "size": size, "ttl": 5.0})[0]
    do("set", "a"), do("set", "b")
    assert do("get", "a")["result"] == "hit" and do("set", "c")["evicted"] == 1 and do("get", "b")["result"] == "miss" and do("get", "a", 6.0)["result"] == "miss"


def test_event_time_stream_drops_late_rows(spark, tmp_path):
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    kinds = "ts timestamp, status_code int, response_time_ns long"
    for part, rows in enumerate(([(at(1), 200, 5), (at(2), 500, 7)], [(at(40), 200, 1)], [(at(41), 200, 1)], [(at(1), 200, 9), (at(59), 200, 1)])):
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        age(tmp_path / "in", part)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.windowed_stats(stream).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    first = spark.table("late").orderBy("window").first()
    assert (first.n, first.success, first.sum_ns) == (2, 1, 12)


def test_fingerprints_of_whole_documents_and_pages(spark, tmp_path):
    """Against byte-by-byte hashing: long texts and pages, and the shortest ones."""
    import hashlib
    import random

    from quillstone import catalogue

    def fnv(data, start, prime, bits):
        for b in data:
            start = (start ^ b) * prime % (1 << bits)
        return start

    def vote(features, least):
        hashes = [fnv(f, 14695981039346656037, 1099511628211, 64) for f in features]
        h = sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in hashes) >= least)
        return h - (1 << 64) if h >> 63 else h

    rng = random.Random(8)
    made = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(n))
    texts = dict(enumerate([made(900), made(40), made(2)]))
    htmls = {k: f"<html><body><p>{t}</p></body></html>" for k, t in texts.items()} | {9: "ab"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, "http://same.example/", h) for k, h in htmls.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()

    grams = {k: [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or w for k, w in ((k, t.split()) for k, t in texts.items())}
    assert {(r.doc_id, r.place): r.gram for r in run("word_ngrams_documents")} == {(k, i): g for k, gs in grams.items() for i, g in enumerate(gs, 1)}
    assert {r.doc_id: r.h for r in run("simhash_text_documents")} == {k: vote([g.encode() for g in gs], 1) for k, gs in grams.items()}
    data = {k: h.encode() for k, h in htmls.items()}
    assert {r.page_id: (r.md5, r["size"], r.fnv32) for r in run("content_fingerprint_html")} == {k: (hashlib.md5(d).hexdigest(), len(d), fnv(d, 2166136261, 16777619, 32)) for k, d in data.items()}
    assert {r.page_id: r.h for r in run("simhash_bytes_html")} == {k: vote([d[i : i + 4] for i in range(max(1, len(d) - 3))], 0) for k, d in data.items()}
