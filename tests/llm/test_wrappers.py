import random

from isobar.llm import wrappers as module
from isobar.llm.wrappers import Kind, extract, host, induce, main_text, match, outline, parse
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, text string, host string, wrapper string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", "w") for r in rows], PAGES)


def site(n, body, extra=""):
    return (
        f"<html><head><title>T{n}</title><script>var x='</p><p>no';</script></head><body><div class=top>My Site</div>"
        f"<nav><a href=/>Home {n}</a></nav><div class=box><h2>{n} things</h2>{body}</div><div class=legal>All rights</div>{extra}</body></html>"
    )


def test_constant_nodes_are_template_and_slots_are_content(spark):
    rows = [(n, f"http://Example.org/{n}", site(n, f"<p>Text {n} &amp; more.<p>Second\n {n}")) for n in range(40)]
    rows += [(100, "http://other.net/", "<body><article><h1>A</h1><p>b<br>c</p><aside>no</aside><div class='ad x'>ad</div></article><p>out</p>")]
    result = {r.page_id: r for r in main_text(pages(spark, rows)).collect()}
    assert len(result) == 41
    for n in range(40):
        assert result[n].text == f"{n} things\n\nText {n} & more.\n\nSecond {n}"
        assert result[n].n_chars == len(result[n].text)
    assert result[100].text == "A\n\nb c"


def test_given_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    result = {r.page_id: r.text for r in main_text(table).collect()}
    for page in table.collect():
        article = page.html.split("<article>")[1].split("</article>")[0]
        ours = "".join(result[page.page_id].split())
        theirs = outline([parse(article)])
        assert ours == "".join("".join(_texts(theirs)).split())


def _texts(kind):
    for node in kind.nodes:
        stack = [node]
        while stack:
            part = stack.pop(0)
            if isinstance(part, str):
                yield part
            else:
                stack = list(part.children) + stack


def test_noise_is_left_out():
    html = (
        "<body><header>Head</header><div id='cookie-notice'>Cookies</div><main><header><h1>Title</h1></header><p>One <b>two</b> three"
        "<form><p>Mail</p></form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><section class=comments><p>Reader</p></section>"
        "<p hidden>secret</p><p style='display: none'>none</p><textarea>typed</textarea><!-- <p>old</p> --></main><footer>Foot</footer></body>"
    )
    assert extract(html, None) == "Title\n\nOne two three\n\na\n\nb\n\nc\n\nd"


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, None, ""), (3, "x", "plain text &lt;b&gt; &#233; &nbsp; end"), (4, "http://a/", "<div>" * 4000 + "deep" + "</div>" * 4000),
        (5, "http://a/", "<p>broken <b>bold<p>next</i></p></div><"), (6, "http://a/", "<script>only"), (6, "http://a/", "<script>only"),
        (None, "http://u:p@A.b:80/q", "<p>no id"), (7, "http://a/", "<body>" + "".join(f"<p>{i}</p><div>{i}</div>" for i in range(2000))),
        (8, "http://a/", "<a b='>'>q</a>"),
    ]
    result = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    assert result[1] == result[2] == result[6] == "" and result[3] == "plain text <b> é end"
    assert result[4] == "deep" and result[5] == "broken bold\n\nnext\n\n<" and result[None] == "no id" and result[8] == "q"
    assert result[7].startswith("0\n\n0\n\n1")
    assert main_text(pages(spark, [])).collect() == []
    assert main_text(pages(spark, rows)).count() == len(rows)


def test_hosts(spark):
    urls = spark.createDataFrame([("HTTP://u:p@A.b:80/q",), (None,), ("x",), ("https://c.d?e",)], "url string")
    assert [r[0] for r in urls.select(host(F.col("url"))).collect()] == ["a.b", "", "", "c.d"]


def test_matching_counts_nodes_in_order():
    def tree(html):
        return outline([parse(html)])

    a = tree("<div><p>1</p><ul><li>2</li></ul><p>3</p></div>")
    assert match(a, tree("<div><p>x</p><p>y</p></div>"))[0] == 3
    assert match(a, a)[0] == 6
    assert match(a, Kind("other", False))[0] == 0
    assert len(induce(["<p>a</p>", "<p>b</p>"])) > 0


def test_names_that_only_hold_a_word_of_purpose_are_content():
    html = (
        "<article><h2 id='related-work'>Related work</h2><p class='ad-hoc'>Made for this</p><p class='notice-of-proof'>Proof</p>"
        "<p>Let <math><mi>x</mi></math> be</p><div class='related-links'>More</div><div id='adBanner_2'>Buy</div><p class='site-footer'>Foot</p>"
        "<div class='comment-list'><p>Reader</p></div><p class='cookieNotice'>Cookies</p><p class='x share-buttons'>Share</p><p class='advertising-law'>Law</p></article>"
    )
    assert extract(html, None) == "Related work\n\nMade for this\n\nProof\n\nLet x be\n\nLaw"


def test_every_page_of_a_host_counts(spark):
    """A text is template by all pages of a host, not by some: a page that has another text there keeps it."""
    def page(h, n):
        legal = f"Only here {h}" if n == 17 else "All rights"
        return f"<body><div class=top>My Site</div><div class=box><p>Text {h} {n}</p></div><div class=legal>{legal}</div></body>"

    rows = [(100 * h + n, f"http://h{h}/{n}", page(h, n)) for h in range(12) for n in range(40)]
    result = {r.page_id: r.text for r in main_text(pages(spark, rows + rows[:100])).collect()}
    for h in range(12):
        for n in range(40):
            assert result[100 * h + n] == f"Text {h} {n}" + (f"\n\nOnly here {h}" if n == 17 else "")


def test_wrappers_of_slices_are_joined(spark, monkeypatch):
    """As slices of any size give it, nodes are counted over all of a host's pages; copies count once."""
    rows = [(n, "http://a/", site(n, f"<p>Text {n}", f"<div class=x{n // 4}>Four</div>")) for n in range(60)]
    rows += [(200 + n, "http://c/", site(n, f"<p>Text {n}", f"<div class=x{n // 2}>Pair</div>")) for n in range(60)]
    rows += [(n, "http://b/", "<body><p>Copy</p></body>") for n in range(100, 105)]
    small = pages(spark, rows)
    one = {r.page_id: r.text for r in main_text(small).collect()}
    assert one[0] == "0 things\n\nText 0" and one[200] == "0 things\n\nText 0\n\nPair" and one[100] == "Copy"
    monkeypatch.setattr(module, "SLICE", 2)
    monkeypatch.setattr(module, "FAN", 2)
    assert {r.page_id: r.text for r in main_text(small).collect()} == one
    made = {r.host: module._unpack(r.wrapper) for r in module.wrappers(small.select(host(F.col("url")).alias("host"), "html")).collect()}
    assert made["a"].seen == 60 and made["b"].seen == 1


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    a = outline([parse("<div><p>1</p><ul><li>2</li></ul><p>3</p><div><p>4</p></div></div>")])
    b = outline([parse("<div><p>x</p><div><p>y</p><ul></ul></div><p>z</p></div>")])
    first = match(a, b), match(a, a)
    monkeypatch.setattr(module, "_FORMS", 1)
    for kind in (a, b):
        kind.form = None
    assert (match(a, b), match(a, a)) == first


def _grown(rng, width, depth, labels):
    kind = Kind(rng.choice(labels), False)
    kind.children = [_grown(rng, rng.randint(0, 3), depth - 1, labels) for _ in range(width if depth else 0)]
    return kind


def _brute(a, b):
    """Nodes that can be paired, from the definition."""
    if a.label != b.label:
        return 0
    best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + _brute(x, y))
    return best[-1][-1] + 1


def test_many_children_are_matched_each_with_each():
    rng = random.Random(3)
    for n, m in ((70, 90), (200, 30), (30, 200), (65, 65)):
        a, b = (_grown(rng, k, 2, "abcd") for k in (n, m))
        b.label = a.label
        score, pairs = match(a, b)
        assert score == _brute(a, b) == 1 + sum(_brute(a.children[i], b.children[j]) for i, j in pairs)
        assert all(i < k and j < l for (i, j), (k, l) in zip(pairs, pairs[1:]))
        assert match(a, a)[0] == match(a, _copied(a))[0] == _brute(a, a)


def _copied(kind):
    copy = Kind(kind.label, kind.noise)
    copy.children = [_copied(c) for c in kind.children]
    return copy


def test_rows_and_cells_find_the_same_pairs(monkeypatch):
    rng = random.Random(4)
    for n in range(200):
        labels = "abcdef"[:rng.randint(1, 6)]
        a, b = (_grown(rng, rng.choice((0, 1, 2, 9, 25)), rng.randint(1, 3), labels) for _ in "ab")
        b.label = a.label
        if n % 4 == 0:
            b.children = [c for c in a.children if rng.random() < 0.8] + b.children[:n % 3]
        found = []
        for pairs in (10**9, -1):
            monkeypatch.setattr(module, "PAIRS", pairs)
            module._scores.clear()
            found.append((module._paired(a, b), module._paired(b, a), module._paired(a, b, False)[0]))
        assert found[0] == found[1]


def test_pages_of_many_blocks_are_aligned_as_wholes(spark):
    """A block that some pages have at the start too is not taken for the one at the end, which would leave all others alone."""
    def page(n, blocks):
        parts = "".join(f"<h3>Part {i}</h3><p>Text {n} {i}</p>" for i in range(blocks))
        return f"<body>{'<div class=x>Front</div>' if n % 2 else ''}{parts}<div class=x>End</div></body>"

    rows = [(100 * h + n, f"http://h{h}/{n}", page(n, (20, 60)[h])) for h in range(2) for n in range(12)]
    result = {r.page_id: r.text for r in main_text(pages(spark, rows)).collect()}
    for h in range(2):
        for n in range(12):
            assert result[100 * h + n] == "\n\n".join(f"Text {n} {i}" for i in range((20, 60)[h]))
