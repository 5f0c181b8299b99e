"""Operators on pages and embeddings: main text, url filter, nearest neighbours."""

import re
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.llm import adscan, queries, tagpath, urlmodel

SF = "/root/testdata/sf0.01"


def article(page):
    """A brute-force reading of the test pages: what stands in the article element."""
    import html

    start = page.find("<article>")
    body = page[start + 9 :].split("</article>")[0] if start >= 0 else ""
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in parts if x)


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = tagpath.extract_main_text(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == article(source[r.page_id].html) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<div><p>x &lt;b&gt; &amp;copy;", "x <b> &copy;"),
        ("<main><h1>T</h1><p>Long enough, really.</p><aside>no</aside><form>f</form></main><script>1<2</script>", "T\n\nLong enough, really."),
        ("<body><div class='nav menu'><a href=x>Home</a></div><div class=content><h2>Title</h2><p>Some long text, with commas, and so on.</p><p>Another one, long too.</p></div><div id='comments'><p>First, great.</p></div><footer>c</footer>", "Title\n\nSome long text, with commas, and so on.\n\nAnother one, long too."),
        ("<article><p>one<br>two &nbsp; three</p><div class='cookie-notice'>ok</div></article>", "one two three"), ("<p " + "x" * 99, ""),
    ],
)
def test_main_text_cases(page, text):
    assert tagpath.main_text(page) == text


def test_main_text_of_hostile_pages_stays_fast():
    for page in ("<div>" * 30000 + "x", '<a b="' * 20000 + "x", "<b>" * 5000 + "</i>" * 5000 + "x", "<!--" * 20000, "<script>" * 20000, "<" * 50000):
        tagpath.main_text(page)


def test_page_operators_take_odd_rows(spark):
    rows = [(1, None, None, "z"), (1, None, None, "z"), (2, "no scheme", "", "z"), (None, "http://x", "<p>hi there", "z"), (4, "HTTP://User@A.example.COM:80/EN/?q#f", "<p>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumns({"score": F.lit(1), "host": F.lit("h")})
    assert tagpath.extract_main_text(pages).count() == 5
    judged = urlmodel.filter_urls(pages, queries.URL_RULES).collect()
    assert len(judged) == 5 and {r.verdict for r in judged} <= {"allow", "block"}
    by = {r.page_id: r for r in judged}
    assert (by[1].host, by[1].path, by[1].rule) == ("", "", None) and (by[2].host, by[2].path) == ("", "")
    assert (by[4].host, by[4].path) == ("user@a.example.com:80", "/EN/")
    assert tagpath.extract_main_text(pages.limit(0)).count() == 0 and urlmodel.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_url_rules_and_models(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    rows = urlmodel.filter_urls(pages, queries.URL_RULES).collect()
    for r in rows:
        rest = urls[r.page_id].split("://", 1)[1]
        authority = re.match(r"[^/?#]*", rest)[0]
        host, path = authority.lower(), re.match(r"[^?#]*", rest[len(authority) :])[0]
        fits = [x for x in rules if ("." + host).endswith("." + x.split("/")[0]) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (rules[rule] if rule else "allow" if r.score >= r.threshold else "block")
    decided = [r for r in rows if r.rule]
    assert np.mean([(r.score >= r.threshold) == (r.verdict == "allow") for r in decided]) > 0.9


def test_url_model_against_brute_force():
    rng = np.random.default_rng(0)
    texts = ["///" + "".join(rng.choice(list("ab./"), rng.integers(0, 12))) for _ in range(40)]
    counts = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 3):
            pair = counts.setdefault(t[i : i + 4], [0, 0])
            pair[k % 2] += 1
    table = urlmodel.log_ratios([(g, a, b) for g, (a, b) in counts.items()])
    size = len(urlmodel.ALPHABET)

    def probability(which, context, symbol):
        p = 1 / size
        for order in range(0, 4):
            ctx = context[3 - order :]
            seen = {}
            for g, c in counts.items():
                if g[3 - order : 3] == ctx and c[which]:
                    seen[g[3]] = seen.get(g[3], 0) + c[which]
            kinds = max(1, len(seen))
            p = (seen.get(symbol, 0) + kinds * p) / (sum(seen.values()) + kinds)
        return p

    for gram in list(counts)[:60]:
        code = 0
        for c in gram:
            code = code * size + urlmodel.ALPHABET.index(c)
        wanted = np.log(probability(0, gram[:3], gram[3])) - np.log(probability(1, gram[:3], gram[3]))
        assert abs(table[code] - wanted) < 1e-4
    means = urlmodel.mean_ratios(texts, table)
    for t, m in zip(texts, means):
        codes = [urlmodel.ALPHABET.index(c) for c in t]
        own = [table[((codes[i] * size + codes[i + 1]) * size + codes[i + 2]) * size + codes[i + 3]] for i in range(len(t) - 3)]
        assert abs(m - (np.mean(own) if own else 0.0)) < 1e-6


def brute(ids, x, asks, k=20):
    out = {}
    for j in np.flatnonzero(asks):
        scores = x @ x[j]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[j]][:k]
        out[int(ids[j])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def test_neighbours_recall_and_order(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = vectors.toArrow()
    ids, x = data["vec_id"].to_numpy(), np.array(data["embedding"].to_pylist(), np.float64)
    wanted = brute(ids, x, ids % 20 == 0)
    got = {}
    for r in adscan.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in w}) for q, w in wanted.items())
    assert hits / sum(map(len, wanted.values())) >= 0.9
    where = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        rows = [found[r] for r in sorted(found)]
        assert sorted(found) == list(range(1, len(rows) + 1)) and rows == sorted(rows, key=lambda v: (-v[1], v[0]))
        assert all(v != q and abs(s - float(x[where[v]] @ x[where[q]])) < 1e-9 for v, s in rows)


def test_neighbours_with_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(0, 60)] + [(100, [0.5, 0.5, 0.0]), (120, [0.0, -1.0, 2.0]), (140, None), (160, []), (180, [0.0, 0.0, 0.0]), (200, [nan, 1.0, 0.0]), (220, [inf, 1.0, 0.0]), (240, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (260, [None, 1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(0), "list": F.lit(1), "id": F.lit("x")})
    got = {}
    for r in adscan.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, v) for i, v in rows[:62]]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    wanted = brute(ids, x, ids % 20 == 0)
    assert {q: [(v, s) for _, v, s in sorted(f)] for q, f in got.items()} == wanted
    few = vectors.where("vec_id in (0, 1, 100)")
    assert adscan.nearest_neighbours(few, F.col("vec_id") % 20 == 0).count() == 4
    assert adscan.nearest_neighbours(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert adscan.nearest_neighbours(vectors.where("vec_id = 180"), F.lit(True)).count() == 0


def test_names_of_elements():
    page = "<article><div class='post-header'><h1>Title</h1></div><p data-id='ad' data-class='menu'>Kept, all of it.</p><div class='ad'>x</div><div hidden>y</div></article>"
    assert tagpath.main_text(page) == "Title\n\nKept, all of it."


def test_recall_holds_with_many_more_lists_than_probes(spark):
    """Vectors without any cluster structure, 375 lists: 24 probes would find less than half of the neighbours."""
    x = np.random.default_rng(3).normal(size=(6000, 64))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in adscan.nearest_neighbours(rows, F.col("vec_id") % 30 == 0, parameters=adscan.Parameters(rows_per_list=16)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k in range(0, len(x), 30):
        scores = x @ x[k]
        scores[k] = -np.inf
        hits += len(got[k] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got), hits / (20 * len(got))


def test_adaptive_scan_without_confidence_is_exact():
    """An infinite epsilon keeps all of the k nearest, whatever the limits, the chunks and the candidates allowed."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(700, 33)), rng.normal(size=(40, 33))
    columns = [np.ascontiguousarray(x[:, k : k + 8]) for k in range(0, 33, 8)]
    apart = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    for allowed in (None, rng.random((40, 700)) < 0.3):
        inside = apart if allowed is None else np.where(allowed, apart, np.inf)
        for limits in (np.full(40, np.inf), np.sort(inside, axis=1)[:, 30], np.sort(inside, axis=1)[:, 3]):
            j, c = adscan.adaptive_scan(q, columns, limits, 10, np.inf, allowed, chunk=128)
            pairs = set(zip(j.tolist(), c.tolist()))
            for k in range(40):
                assert all((k, int(v)) in pairs for v in np.argsort(inside[k])[:10] if inside[k, v] <= limits[k])
            assert allowed is None or allowed[j, c].all()


@pytest.mark.parametrize("kind", ["gaussian", "lognormal", "clustered", "hot"])
@pytest.mark.parametrize("rows_per_list", [512, 64])
def test_recall_by_kind_of_data(spark, kind, rows_per_list):
    """30,000 vectors, production parameters but for the lists; the hot kind has a third of all rows near one point."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(30_000, 64))
    if kind == "lognormal":
        x *= np.exp(rng.normal(size=(len(x), 1)))
    elif kind == "clustered":
        x = rng.normal(size=(300, 64))[rng.integers(0, 300, len(x))] * 4 + x
    elif kind == "hot":
        x[::3] = x[0] + 0.2 * x[::3]
    folder = tempfile.mkdtemp(prefix="spark-vectors-")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), f"{folder}/v.parquet", row_group_size=4096)
    rows = spark.read.parquet(f"{folder}/v.parquet")
    got = adscan.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, parameters=adscan.Parameters(rows_per_list=rows_per_list)).toPandas()
    found = got.groupby("query_id")["vec_id"].apply(set)
    hits, queries = 0, range(0, len(x), 100)
    for k in queries:
        scores = x @ x[k]
        scores[k] = -np.inf
        hits += len(found[k] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert len(found) == len(x) // 20 and (got.groupby("query_id").size() == 20).all()
    assert hits >= 0.9 * 20 * len(queries), hits / (20 * len(queries))


@pytest.mark.parametrize("kind", ["lognormal", "shifted", "both"])
def test_no_task_meets_all_queries(spark, kind, monkeypatch):
    """Norms that differ much, a mean far from 0: all queries share a list, yet no group has more than its share of them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(30_000, 16)) * (np.exp(rng.normal(size=(30_000, 1))) if kind != "shifted" else 1) + (5 if kind != "lognormal" else 0)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>").repartition(4)
    seen, deal = [], adscan._dealt

    def watched(queries, counts, candidates, index):
        q, c = deal(queries, counts, candidates, index)
        seen.append((q.groupBy("block").count().agg(F.max("count")).first()[0], q.groupBy("block", "part").count().agg(F.max("count")).first()[0], c.groupBy("block", "part").count().agg(F.max("count")).first()[0], q.join(c, ["block", "part"], "left_anti").count()))
        return q, c

    monkeypatch.setattr(adscan, "_dealt", watched)
    p = adscan.Parameters(asking=128, block=1_024)
    got = adscan.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, parameters=p).toPandas()
    assert seen[0][0] > 400 and all(part <= 2 * p.asking and mine <= 1.3 * p.block and alone == 0 for _, part, mine, alone in seen)
    found = got.groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for k in range(0, len(x), 100):
        scores = x @ x[k]
        scores[k] = -np.inf
        hits += len(found[k] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 300, hits / 6_000


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(1500, 24)), np.repeat(rng.normal(size=(3, 24)), 60, axis=0)])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in adscan.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, parameters=adscan.Parameters(rows_per_list=32, block=128, exact=True)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 9))
    wanted = brute(np.arange(len(x)), x, np.arange(len(x)) % 20 == 0)
    assert {q: [f[r] for r in sorted(f)] for q, f in got.items()} == {q: [(v, round(s, 9)) for v, s in w] for q, w in wanted.items()}
