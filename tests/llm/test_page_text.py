"""Page text: structure, differencing and odd pages."""

import random

from parqyard.llm import page_text


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_longest_common_subsequence(monkeypatch):
    rnd = random.Random(8)
    for limit in (1 << 28, 12):
        for _ in range(600):
            a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 14))] for _ in "ab")
            if limit == 12:  # halving, by the same arithmetic as on very long pages
                monkeypatch.setattr(page_text, "HELD", 12)
            got = page_text.common(a, b)
            rest = iter(b)
            assert len(got) == lcs(a, b) and got == sorted(set(got)) and all(a[i] in rest for i in got)


def test_lines():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- <p>no</p> --><div class="top ad">buy</div><div id="cookie-notice">ok?</div>
    <article><h1>A &amp; B</h1><p>one<br>two <b>bold</b>\n  end<p>open<ul><li>x<li>y</ul><div class="comments"><p>reader</p></div><form><p>f</p></form></article>
    <aside>side</aside><p>outside</p><footer>&copy; me</footer></body></html>"""
    found = page_text.lines(page)
    assert [(t, m) for t, m, bad in found if not bad] == [("A & B", True), ("one two bold end", True), ("open", True), ("x", True), ("y", True), ("outside", False)]
    assert [t for t, _, bad in found if bad] == ["menu", "buy", "ok?", "reader", "f", "side", "© me"]
    assert page_text.lines(None) == page_text.lines("") == [] and page_text.lines("a &lt;b&gt; &#233; < c") == [("a <b> é < c", False, False)]
    assert page_text.lines("<article><p>cut <a href='x") == [("cut", True, False)] and page_text.lines("<p>a<p>b</div></p>") == [("a", False, False), ("b", False, False)]


def _main(page):
    return [t for t, _, bad in page_text.lines(page) if not bad]


def test_broken_and_misleading_markup():
    assert _main("<p class=it's>Hello I don't stop</p><p>next</p>") == ["Hello I don't stop", "next"]
    assert _main("<p title=\"a > b\" data-x='>'>one</p><P CLASS=ad>two</P><p a=\">three</p>") == ["one", "three"]
    for wrapper in ('class="comments-enabled"', 'class="post search-results"', 'id="main-ad-free"', "class=sidebar", "class='ads' id=comments"):
        assert _main(f"<div {wrapper}><article><p>kept</p><div class='cookie-notice'>gone</div></article></div><div class=comments><article>said</article></div>") == ["kept"]
    assert _main("<form><p>the whole page is in one form</p></form><p>x</p>") == ["the whole page is in one form", "x"]
    assert _main("<p>a longer text than the advert</p><div class='site-footer'>small</div>") == ["a longer text than the advert"]
    for part in ("<a ", "<a b=\"", "<div class='", "<", "<!--", "</b", "<p "):
        for end in ("", ">"):
            page_text.lines("<div>" * 2000 + "<b>" * 5000 + part * 100_000 + end)  # quadratic time would take minutes


def test_extract(spark):
    shell = "<html><body><div>Site name</div><div>Home</div>{}<div>All rights</div></body></html>"
    rows = [(i, f"http://h.org/a/{i}?q={i}", shell.format(f"<p>story {i}</p><p>more {i}</p>")) for i in range(20)]
    rows += [(100, "http://other.org/x", shell.format("<p>lonely</p>")), (101, None, None), (None, "http://z.org/1", "<article><p>same</p></article>"), (102, "http://z.org/2", "<article><p>same</p></article>"), (102, "http://z.org/2", "<article><p>same</p></article>")]
    rows += [(103, "http://long.org/", "<p>" + "</p><p>".join(f"line {i % 50}" for i in range(3000))), (104, "http://long.org/b", "<p>" + "</p><p>".join(f"line {i % 7}" for i in range(3000)) + "<p>own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as host", "2 as rid")
    got = page_text.extract(df.repartition(3)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(text[i] == f"story {i}\nmore {i}" for i in range(20))
    assert text[100] == "Site name\nHome\nlonely\nAll rights" and text[101] == "" and text[None] == text[102] == "same"
    assert text[104].endswith("own")
    assert {r["n_template"] for r in got if r["page_id"] is not None and r["page_id"] < 20} == {3}
    assert page_text.extract(df.limit(0)).count() == 0


def test_extract_by_brute_force(spark):
    """Random hosts: pairing, alignment and the rule for copies as plain Python does them."""
    rnd = random.Random(3)
    rows, blocks = [], {}
    for i in range(120):
        host, path = f"h{rnd.randrange(4)}", f"/{rnd.choice('ab')}{rnd.choice('xyz')}{rnd.choice('xyz')}/{i:03}"
        top, low = ([f"menu {host} {j}" for j in range(rnd.randint(0, 3))], [f"foot {host} {j}" for j in range(rnd.randint(0, 3))])
        own = [f"own {i} {j}" for j in range(rnd.randint(0, 4))] + ([f"said by {host}"] if rnd.random() < 0.5 else [])
        if rows and rnd.random() < 0.15:
            text = blocks[i] = blocks[i - 1]
        else:
            text = blocks[i] = top + own + low
        rows.append((i, f"https://{host}{path}", "".join(f"<p>{x}</p>" for x in text)))
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], r[0]))
    want = {}
    for k, (i, url, _) in enumerate(order):
        start = lambda u: len([1 for n in range(1, len(url) + 1) if u[:n] == url[:n]])  # noqa: B023, E731
        near = [order[j] for j in (k + 1, k - 1) if 0 <= j < len(order) and order[j][1].split("/")[2] == url.split("/")[2]]
        shared = set()
        for j, other, _ in sorted(near, key=lambda r: -start(r[1])):
            if lcs(blocks[i], blocks[j]) < len(blocks[i]):
                shared = set(page_text.common([hash(x) for x in blocks[i]], [hash(x) for x in blocks[j]]))
                break
        want[i] = "\n".join(x for n, x in enumerate(blocks[i]) if n not in shared)
    got = {r["page_id"]: r["text"] for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == want and len({len(x) for x in want.values()}) > 5
