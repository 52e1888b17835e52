import random

import pytest

from parlance.llm import html_extract, url_filter
from parlance.llm.html_extract import main_text
from parlance.llm.queries import URL_RULES
from tests.llm.helpers import python_free


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain &lt;b&gt; &amp; text", "plain <b> & text"),
    ("<p>a\n  b<p>c", "a b\nc"), ("<p>a <b>b</p><p>c</b> d", "a b\nc d"),
    ("<article><h1>T</h1><p>x<br>y</p></article><footer>f</footer>", "T\nx y"),
    ("<header>h</header><main><header><h1>T</h1></header><p>x</main>", "T\nx"),
    ("<nav>m</nav><div class='side-bar'>kept</div><div id=sidebar>s</div><p>x", "kept\nx"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>x<!-- <p>no --></p>", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\n1 2\n3"),
    ("<article><p>x</p><section id='comments'><p>no</p></section></article>", "x"),
    ("<form><p>no</p><input></form><p title='a > b'>x</p>", "x"),
    ("<p>x<p>unclosed <", "x\nunclosed <"), ("<article><p>x &am", "x &am"),
    ("<title>no</title><p>caf&eacute; &#233;&#x1F600;", "café é😀"),
])
def test_main_text(html, text):
    assert main_text(html) == text


def test_deep_nesting_and_junk_do_not_fail():
    assert main_text("<div>" * 50_000 + "x") == "x"
    assert main_text("<p title=don't>it's <b class='a>b' id=\"<p>\">here</b>") == "it's here"
    for junk in ("<a ", "<a x=\"", "<a x='", "</", "<!--", "<p a=b"):
        main_text(junk * 20_000)
    rng = random.Random(3)
    for _ in range(300):
        main_text("".join(rng.choice(["<", ">", "p", "/", "!--", "-->", "a=\"", "'", "&", "x ", "<p>", "</p>", "<script>"]) for _ in range(40)))


def page(host, body, at):
    return (at, f"https://{host}/{at}", f"<html><body>{body}</body></html>")


def test_subtrees_that_recur_on_a_host_go(spark, with_clashes):
    shared = "<div class='z'><span>Follow our paper</span></div>"
    rows = [page("a.org", f"{shared}<div><p>own {i}</p></div>", i) for i in range(6)]
    rows += [page("b.org", f"{shared}<div><p>other {i}</p></div>", 10 + i) for i in range(2)]
    # Copies of an article are its own text and stay.
    rows += [page("a.org", "<article><p>copied</p></article>", 20 + i) for i in range(5)]
    rows += [(30, None, None), (31, "no host", "<p>y</p>"), (31, "no host", "<p>y</p>"), (None, "https://a.org", "")]
    pages = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r.page_id, r.text) for r in got.collect()]
    texts = dict(found)
    assert len(found) == len(rows)
    assert all(texts[i] == f"own {i}" for i in range(6))
    assert all(texts[10 + i] == f"Follow our paper\nother {i}" for i in range(2))
    assert all(texts[20 + i] == "copied" for i in range(5))
    assert texts[30] == "" and texts[31] == "y" and texts[None] == ""


@pytest.mark.parametrize("body", [
    "<article><div class='entry'><p>copied</p></div></article>",
    "<article><p class='lead'>copied</p></article>",
    "<div class='entry'><p>copied</p></div>",
])
def test_copied_pages_keep_their_text(spark, body):
    shared = "<div class='z'><span>Follow our paper</span></div>"
    rows = [page("a.org", f"<div class='ad'>ad {i}</div>{shared}{body}", i) for i in range(5)]
    rows += [page("a.org", f"{shared}<div><p>own {i}</p></div>", 10 + i) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert texts == {i: "copied" for i in range(5)} | {10 + i: f"own {i}" for i in range(5)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).collect() == []
    assert url_filter.judged_urls(pages, rules=URL_RULES).collect() == []


def expected_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, None if best is None else ("block" if best.block else "allow")


def test_rules_and_trees(spark, with_clashes):
    rng = random.Random(5)
    hosts = ("Example.NET", "a.example.net", "net", "xnet", "example.com", "b.example.org", "org", "example.netx", "É.org")
    paths = ("", "/", "/en/1", "/en", "/de/2?x=1&y=2", "/fr/3#f", "?q=/en/", "#top", "/es/4/")
    urls = [f"https://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += [None, "", "no url", "://", "a://b://c/de/", "http://example.com/de/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])]
    got = url_filter.judged_urls(
        with_clashes(spark.createDataFrame(rows, "page_id long, url string")), rules=URL_RULES
    )
    assert python_free(got)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, rule, verdict = expected_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn_lexical_labels(spark):
    rng = random.Random(9)
    bad = [f"http://win-{rng.randrange(10**6)}.biz/{rng.randrange(10**9)}?a=1&b=2&c=3" for _ in range(400)]
    good = [f"https://news{rng.randrange(9)}.org/story/{rng.choice('abcdef')}" for _ in range(400)]
    labelled = spark.createDataFrame([(u, True) for u in bad[:300]] + [(u, False) for u in good[:300]], "url string, block boolean")
    test = spark.createDataFrame([(u,) for u in bad[300:] + good[300:]], "url string")
    got = {r.url: r.verdict for r in url_filter.judged_urls(test, labelled).collect()}
    right = sum(got[u] == "block" for u in bad[300:]) + sum(got[u] == "allow" for u in good[300:])
    assert right >= 0.95 * 200


def test_suffixes_outside_the_sample_count(spark):
    rng = random.Random(4)
    hosts = ["".join(rng.choices("abcdefghij", k=6)) + ".org" for _ in range(200)]
    bad = dict(zip(hosts, [True, False] * 100, strict=True))
    url = lambda h: f"https://{h}/x/{rng.choice('abcdef')}{rng.choice('abcdef')}"
    labelled = spark.createDataFrame([(url(h), bad[h]) for h in hosts for _ in range(10)], "url string, block boolean")
    test = spark.createDataFrame([(url(h), bad[h]) for h in hosts], "url string, bad boolean")
    got = url_filter.judged_urls(test, labelled, how=url_filter.UrlModel(max_labelled=100)).collect()
    assert sum((r.verdict == "block") == r.bad for r in got) >= 190


def test_labels_of_one_kind(spark):
    test = spark.createDataFrame([("https://a.org/x",)], "url string")
    for kind in (True, False):
        labelled = spark.createDataFrame([("https://b.org", kind)], "url string, block boolean")
        assert url_filter.judged_urls(test, labelled).first().verdict == ("block" if kind else "allow")
