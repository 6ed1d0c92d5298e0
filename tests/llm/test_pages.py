"""URL filters and main text."""

import html
import re
import time

import duckdb
import numpy as np
import pytest

from tilewright.llm import htmlmain as H
from tilewright.llm import urlfilter as U
from tilewright.llm.htmllabels import PAGES


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x=/en/", "x://É.com/en/", "https://example.com/en/70", "https://notexample.com/en/70", "http://m.example.com", "http://a.net/de/8#f", "http://example.net/de/81", "http://org/es/", "http://x.org/es", "http://x.org?/es/", "http://a.com:80/en/", "http://a.com/en/\n/x", "a://b://c/d"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(df).collect()}
    for i, u in enumerate(URLS):
        host, path = slow_url(u)
        fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None)
        margin = sum(w for b, w in enumerate(U.plain_fit()[:-1]) if b in U.plain_buckets(host, path)) + U.plain_fit()[-1]
        assert got[i].p_block == pytest.approx(1 / (1 + np.exp(-margin)), abs=2e-4)
        assert got[i].verdict == (max(fits)[2] if fits else "block" if got[i].p_block > 0.5 else "allow")
    assert U.judge(df.limit(0)).count() == 0


def test_weights_equal_the_plain_loop(spark):
    assert U.fit(spark) == pytest.approx(U.plain_fit(), abs=2e-6)


def test_labelled_urls_are_learned(spark):
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(U.LABELLED)], "page_id long, url string")
    got = {r.page_id: r.p_block > 0.5 for r in U.judge(df, rules=()).collect()}
    assert [got[i] for i in range(len(U.LABELLED))] == [bool(y) for *_, y in U.LABELLED]


def test_plan_has_no_python(spark, sf_dir):
    plan = U.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.sql(U.sql()).df().sort_values("page_id")
    got = U.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).toPandas().sort_values("page_id")
    for c in want.columns:
        assert got[c].fillna("-").tolist() == want[c].fillna("-").tolist()


@pytest.fixture(scope="module")
def extractor():
    return H.Extractor()


def plain_text(markup):
    return " ".join(re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", markup))).split())


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_labelled_pages(extractor, k):
    want = " ".join(map(plain_text, re.findall(r"\[\[(.*?)\]\]", PAGES[k], re.S)))
    assert extractor.text(PAGES[k].replace("[[", "").replace("]]", "")) == want


def test_pages_left_out_of_training():
    """Trained without a page, the extractor still finds most of its words and few others."""
    for k in range(len(PAGES)):
        e = H.Extractor(PAGES[:k] + PAGES[k + 1 :])
        want = " ".join(map(plain_text, re.findall(r"\[\[(.*?)\]\]", PAGES[k], re.S))).split()
        got = e.text(PAGES[k].replace("[[", "").replace("]]", "")).split()
        assert len(set(got) & set(want)) >= 0.9 * len(set(want)) and len(set(got) - set(want)) <= 0.2 * len(set(want))


def test_whole_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for p in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", p.html, re.S)[1])
        texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", x).replace("<b>", ""))).strip() for x in parts)
        want = " ".join(x for x in texts if x)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<p>", ""), ("just some plain words here", "just some plain words here"), ("<article>a&amp;b &lt;c&gt; &eacute;&#233; &am &amp x<", "a&b <c> éé &am & x<"),
    ("<article><h1>Hi</h1><div class='ad'>buy buy buy buy</div><p>te<b>x</b>t\n  here</article><footer>f f</footer>", "Hi text here"), ("<nav><a href=x>only menu</a></nav>", ""),
    ("<article><p>one<br>two<!-- no --><script>x</script><p>three", "one two three"), ("<div class=comments><article>nice</article></div><main>T</main>", "T"), ("<article>" + "w " * 100_000 + "</article>", ("w " * 100_000).strip()),
])
def test_odd_pages(extractor, page, want):
    assert extractor.text(page) == want


def test_scan_equals_all_runs(extractor):
    rng = np.random.default_rng(0)
    for _ in range(50):
        row = [(("#", "article", "a b", 0), ("#", "nav", "x", 0), ("<div>", "", "", 0))[int(i)] for i in rng.integers(0, 3, 14)]
        value = [len(t.split()) * extractor.score(w, k) if w == "#" else extractor.score(w, k) for w, k, t, _ in row]
        best = max([0.0, *(sum(value[i:j]) for i in range(14) for j in range(i + 1, 15))])
        a, b = extractor.region(row)
        assert sum(value[a:b]) == pytest.approx(best)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "<article>x</article>", "t"), (2, "u", "<article>x</article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in H.extract(df).collect()) == [(1, ""), (2, "x"), (2, "x")]
    assert H.extract(df.limit(0)).count() == 0


def test_hosts_left_out():
    """An eighth of the hosts at a time, judged by a fit that has not seen them."""
    fold, right = np.random.default_rng(0).permutation(len(U.LABELLED)) % 8, []
    for f in range(8):
        w = U.plain_fit(tuple(r for r, k in zip(U.LABELLED, fold) if k != f))
        right += [(sum(w[b] for b in U.plain_buckets(h, p)) + w[-1] > 0) == bool(y) for (h, p, y), k in zip(U.LABELLED, fold) if k == f]
    assert np.mean(right) >= 0.9
    w = U.plain_fit()
    for host in ("ads-track.example.org", "www.adult-x.example.net", "spam-farm.example.org", "casino-win.example.net"):
        assert sum(w[b] for b in U.plain_buckets(host, "/fr/4711.html")) + w[-1] > 0


def test_pages_that_never_close_are_scanned_once():
    for part in ('<a "x ', "<a href='x ", "<p", "<!-- ", "<div><p></span>", "</p", "<div>", "<b a=b=c ", "<button>", '<i x="1" ', "< ", "<!a", "</ "):
        t = []
        for n in (20_000, 80_000):
            begin = time.process_time()
            H.tokens(part * n)
            t.append(time.process_time() - begin)
        assert t[1] < 12 * max(t[0], 0.02), part


def test_scanner():
    words = lambda page: [t for what, _, t, _ in H.tokens(page) if what == "#"]
    assert words('a<b class="x>y" id=\'>\' data-q=a="z">c</b>d') == ["a", "c", "d"]
    assert words("1 < 2 <!-- x > --> 3 <?php x ?> 4 <!DOCTYPE html> 5 </> 6") == ["1 ", "<", " 2 ", " 3 ", " 4 ", " 5 ", " 6"]
    assert words("a <p title='x") == ["a "] and words("a <script> b < c </script > d") == ["a ", " d"]
