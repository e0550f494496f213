import math
import os
from collections import Counter, defaultdict

import pytest

from factloom.llm import html

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages, **kw):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], SCHEMA)
    return {r.page_id: r for r in html.extracted(rows).collect()}


def test_blocks_references_and_white_space(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
    <!-- no > comment --><article><h1>A &amp; B&nbsp;&copy; &#233;</h1><p><b>one<br>two   <i>th</i>ree<p>four &lt;tag&gt;
    <ul><li>x<li>y</ul><table><tr><td>c<td>d</table><script>var t = "</p>"; if (a<b) {}</script>
    <blockquote><p>quote</p></blockquote>tail</article><footer>&copy; f</footer>"""
    got = texts(spark, [("http://h.example/1", page)])[0]
    assert got.text == "A & B © é\none two three\nfour <tag>\nx\ny\nc\nd\nquote\ntail"
    assert got.n_chars == len(got.text)


@pytest.mark.parametrize("noise", ['<div class="comments"><p>{}</p></div>', "<aside>{}</aside>", '<div id="cookie-notice">{}</div>', "<form><p>{}</p><button>go</button></form>", '<section class="ad-slot-3">{}</section>', '<div role="navigation">{}</div>', "<p hidden>{}</p>", "<script>{}</script>", '<div class="site-footer">{}</div>'])
def test_noise_inside_the_article(spark, noise):
    page = f"<body><main><h1>Title</h1><p>Body.</p>{noise.format('gone')}<p>End.</p></main></body>"
    assert texts(spark, [("http://h.example/", page)])[0].text == "Title\nBody.\nEnd."


def test_repeated_branches_of_a_site_go(spark):
    page = lambda i: f"<html><body><div class='zq'><span>Welcome to our site</span></div><div class='kk'><h1>Head {i}</h1><p>Fresh words {i} {i * 7}.</p><p>And {i * 31} more.</p></div><div class='xv'><p>Call us at once</p></div></body></html>"
    many = texts(spark, [(f"https://Site.example:80/{i}", page(i)) for i in range(200)])
    for i in range(200):
        assert many[i].text == f"Head {i}\nFresh words {i} {i * 7}.\nAnd {i * 31} more."
    one = texts(spark, [("https://other.example/", page(3))])[0]
    assert "Fresh words 3 21." in one.text


def test_passages_that_pages_share_stay(spark):
    page = lambda i: f"<body><article><h1>Head {i}</h1><p>The very same passage.</p><p>Own {i}.</p></article></body>"
    got = texts(spark, [(f"http://a.example/{i}", page(i)) for i in range(60)])
    assert all(got[i].text == f"Head {i}\nThe very same passage.\nOwn {i}." for i in range(60))


def test_odd_pages(spark):
    pages = [(None, None), ("", ""), ("x", "no markup at all"), ("http://h/", "<p>open <b>never"), ("http://h/", "<div>" * 500 + "deep"), ("http://h/", "</p></div><p>a</p>"), ("http://h/", "<br/><p>a < b</p>"), ("http://h/", "<p>" + "long " * 40_000)]
    got = texts(spark, pages)
    assert [got[i].text for i in range(7)] == ["", "", "no markup at all", "open never", "deep", "a", "a < b"]
    assert got[7].n_chars == len("long " * 40_000) - 1
    assert texts(spark, []) == {}


def test_deep_nesting_loses_no_text(spark):
    deep = "<div>" * 100
    pages = [
        f"<div id=page><main><h1>Head</h1>{deep}inside<nav>menu</nav><form>field</form>{'</div>' * 100}<p>after</p></main></div>",
        f"<main>{'<div>' * 100_000}<p>one<aside>gone</aside><p>two{'</div></i>' * 100_000}<p>after</main>outside",
    ]
    got = texts(spark, [(f"http://h{i}.example/", p) for i, p in enumerate(pages)])
    assert got[0].text == "Head\ninside\nafter"
    assert got[1].text == "one\ntwo\nafter"
    assert max(len(node.path()) for node, _ in html.layouts(html.parsed(pages[1]))) <= html.PATH_DEPTH + 2


@pytest.mark.parametrize(("n", "around"), [(10, "<div class='kk'>{}</div>"), (40, "<div class='kk'>{}</div>"), (20, "<article>{}</article>"), (40, "<article>{}</article>")])
def test_rotating_boilerplate_goes(spark, n, around):
    page = lambda i: "<body>" + around.format(f"<div class='zq'>Offer {'AB'[i % 2]} of the day</div><h1>Head {i}</h1><p>Fresh {i}.</p><div class='xv'>Call us</div>") + "</body>"
    got = texts(spark, [(f"http://a.example/{i}", page(i)) for i in range(n)])
    assert [got[i].text for i in range(n)] == [f"Head {i}\nFresh {i}." for i in range(n)]


def test_fresh_text_under_names_of_layout_stays(spark):
    page = lambda i: f"<body><div class='modal-widget'><h1>Head {i}</h1><p>Fresh {i}.</p></div><div class='banner'>Buy now</div><div class='comments'><p>I think {i}</p></div></body>"
    got = texts(spark, [(f"http://a.example/{i}", page(i)) for i in range(20)])
    assert [got[i].text for i in range(20)] == [f"Head {i}\nFresh {i}." for i in range(20)]


def test_statistics_never_empty_a_page(spark):
    one = "<body><article><h1>Head</h1><p>The only text.</p></article><div>foot</div></body>"
    own = lambda i: f"<body>Own text {i}<div class='a'>top</div><div class='b'>mid</div><div class='c'>end</div></body>"
    got = texts(spark, [("http://a.example/", one)] * 30 + [(f"http://b.example/{i}", own(i)) for i in range(30)])
    assert all(got[i].text == "Head\nThe only text." for i in range(30))
    assert all(got[30 + i].text == f"Own text {i}" for i in range(30))


def slow_trees(pages):
    """(host, path) -> pages, content, freedom by the definitions, from whole paths."""
    shapes, texts, seen = defaultdict(Counter), defaultdict(Counter), Counter()
    hosts = Counter(host for host, _ in pages)

    def path(node):
        return () if node.parent is None else (*path(node.parent), node.style)

    for host, page in pages:
        root = html.parsed(page)
        for key in {(path(n), s) for n, s in html.layouts(root)}:
            shapes[host, key[0]][key[1]] += 1
        found = {(path(n), t) for n, t in html.blocks(root)}
        for p, t in found:
            texts[host, p][t] += 1
        seen.update({(host, p) for p, _ in found})

    def entropy(counts):
        total = sum(counts)
        return -sum(n / total * math.log(n / total, total) for n in counts) if total > 1 else 1.0

    out = {}
    for (host, p), n in seen.items():
        if hosts[host] > 1:
            words = texts[host, p]
            content = 1 - sum(k * math.log(k, n) for k in words.values()) / sum(words.values()) if n > 1 else 1.0
            freedom = max(entropy(shapes[host, p[:i]].values()) for i in range(len(p) + 1) if (host, p[:i]) in shapes)
            out[host, p] = (n, content, freedom)
    return out


def site(i):
    rows = "".join(f"<p>Text {i} {j}.</p>" for j in range(i % 5)) + ("<ul><li>a<li>b</ul>" if i % 3 else "")
    return f"<body><nav><ul>{'<li><a>Menu</a>' * (3 + i % 2)}</ul></nav><div class='b c'>Note {i % 4}</div><article class=x{i}><h1>Head {i}</h1>{rows}</article><footer>end</footer></body>"


def test_trees_by_their_definitions(spark):
    pages = [(f"h{i % 3}.example", site(i)) for i in range(40)] + [("one.example", site(1)), ("", "<p>a")]
    rows = spark.createDataFrame([(i, f"http://{h}/{i}" if h else None, p) for i, (h, p) in enumerate(pages)], SCHEMA)
    got = html.trees(html.outlined(rows)).collect()
    want = slow_trees(pages)
    measured = sorted((r.host, r.pages, round(r.content, 9), round(r.freedom, 9)) for r in got)
    assert measured == sorted((h, n, round(c, 9) + 0.0, round(f, 9) + 0.0) for (h, _), (n, c, f) in want.items())
    assert all(r.composite == pytest.approx(r.content * (0.25 + 0.75 * r.freedom)) for r in got)


def test_the_tree_and_tags_differ(spark, monkeypatch):
    """On hosts whose tags and names tell nothing, what is left without any tree is another
    text on every page, menus and notices included."""
    def page(i):
        return f"<body><div class='q1'>Top {'ABC'[i % 3]}</div><div class='q2'><h2>Head {i}</h2><p>Fresh {i}.</p></div><div class='q3'>End</div></body>"

    sites = [(f"http://a.example/{i}", page(i)) for i in range(30)]
    by_tree = texts(spark, sites)
    monkeypatch.setattr(html, "ruled", lambda forest: forest.where("false").select("host", "id", "pages", "content").withColumnRenamed("content", "importance"))
    by_tags = texts(spark, sites)
    for i in range(30):
        assert by_tree[i].text == f"Head {i}\nFresh {i}."
        assert by_tags[i].text == f"Top {'ABC'[i % 3]}\nHead {i}\nFresh {i}.\nEnd"


def test_the_tree_decides(spark):
    """Without the trees' statistics nearly every page keeps its menu and footer."""
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    by_tree = {r.page_id: r.text for r in html.extracted(pages).collect()}
    by_tags = {r.page_id: r.text for r in html.extracted(pages, statistics=False).collect()}
    assert sum(by_tree[i] != by_tags[i] for i in by_tree) > 0.9 * len(by_tree)
    assert all(len(by_tree[i]) < len(by_tags[i]) for i in by_tree if by_tree[i] != by_tags[i])


def test_the_tree_overrules_tags(spark):
    """A form around the whole page, fresh text in an aside, and boilerplate in an article."""
    def page(i):
        body = "".join(f"<p>Fresh {i} {j}.</p>" for j in range(1 + i % 7))
        return f"<body><form><nav>Menu</nav><aside><h1>Head {i}</h1>{body}</aside><article><p>Subscribe now</p></article></form></body>"

    got = texts(spark, [(f"http://a.example/{i}", page(i)) for i in range(30)])
    assert [got[i].text for i in range(30)] == ["\n".join([f"Head {i}", *(f"Fresh {i} {j}." for j in range(1 + i % 7))]) for i in range(30)]


@pytest.mark.parametrize("html_text", [
    '<article><div class="post-header"><h1>Title</h1></div><p>Body.</p></article>',
    '<article><header><h1>Title</h1></header><section class="search-results-discussion"><p>Body.</p></section></article>',
    '<article><h1>Title</h1><p title="a hidden gem" data-x=\'display:none\'>Body.</p></article>',
    '<article><h1>Title</h1><p style="overflow: hidden ;">Body.</p></article>',
    '<article><h1>Title</h1><p>Body.</p>' + "<div>" * 70 + "<nav>MENU</nav>" + "</div>" * 70 + "</article>",
    '<article><h1>Title</h1><p style="color:red; display : none">x</p><p aria-hidden=true>x</p><p>Body.</p></article>',
    '<article><h1>Title</h1><p>Body.</p><div class="reader-comments"><article class="comment">I say</article></div><div id="AdSlot3">buy</div></article>',
])
def test_names_and_attributes(spark, html_text):
    alone = texts(spark, [("http://h.example/", f"<body>{html_text}</body>")])
    assert alone[0].text == "Title\nBody."


@pytest.mark.parametrize(("html_text", "want"), [
    ('<section class="reply"><h2>An essay</h2><p>In reply to another.</p></section>', "An essay\nIn reply to another."),
    ('<div class="promo-wrapper"><h1>Title</h1><p>Para.</p><div class="comments"><p>I say</p></div></div><div class="ad">Buy</div>', "Title\nPara."),
    ('<div class="comment"><main><p>Body.</p></main></div><footer>end</footer>', "Body."),
    ('<article><h1>Title</h1><p class="comment">A remark.</p><p>See <span class="ad">the advert</span> of 1900.</p><aside class="ad">Buy</aside></article>', "Title\nA remark.\nSee the advert of 1900."),
    ('<article><h1>Title</h1><label>Exhibit A</label><form><label>Name</label><input></form></article>', "Title\nExhibit A"),
    ('<div class="ad">Only this</div><script>x</script>', "Only this"),
    ('<article><h1>Title</h1><p>Body.</p></article><ol class="commentlist"><li class="comment"><p>I say</p></ol><p class="ad">Buy</p>', "Title\nBody."),
])
def test_names_of_adverts_and_comments_are_weighed(spark, html_text, want):
    assert texts(spark, [("http://h.example/", f"<body>{html_text}</body>")])[0].text == want


def test_scans_that_are_split_differently(spark, tmp_path, monkeypatch):
    """What is outlined by one split of the files is packed by another: every page keeps
    the rules of its own host, where what one repeats is what the other writes afresh."""
    def page(host, i):
        a, b = (f"Fresh {i} {i * 7}.", "Call us at once") if host == "a" else ("Call us at once", f"Fresh {i} {i * 7}.")
        return f"<body><div class='x'><p>{a}</p></div><div class='y'><p>{b}</p></div></body>"

    rows = [(2 * i + (h == "b"), f"http://{h}.example/{i}", page(h, i)) for h in "ab" for i in range(40)] + [(999, "http://a.example/3", page("a", 3))] * 3
    spark.createDataFrame(rows, SCHEMA).repartition(12).write.parquet(f"{tmp_path}/pages")
    whole = html.packed

    def resplit(pages):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.files.openCostInBytes", "256m")
        return whole(spark.read.parquet(f"{tmp_path}/pages"))

    monkeypatch.setattr(html, "packed", resplit)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = html.extracted(spark.read.parquet(f"{tmp_path}/pages")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 83
    assert all(r.text == f"Fresh {r.url.split('/')[-1]} {int(r.url.split('/')[-1]) * 7}." for r in got)


def slow_rules(forest):
    """(host, id) -> pages, importance by the definition of ``ruled``."""
    scale = {}
    for host in {r.host for r in forest}:
        of = [r for r in forest if r.host == host and r.pages > 1]
        weight = sum(r.chars * r.composite for r in of)
        if weight > 0:
            scale[host] = sum(r.chars * r.composite**2 for r in of) / weight
    own = {(r.host, r.id): (r.pages, min(1.0, r.composite / scale[r.host])) for r in forest if r.host in scale}
    out = {}
    for (host, i), (pages, value) in own.items():
        rest = [(n, v) for (h, j), (n, v) in own.items() if j == i and h != host and n > 1]
        times = sum(n for n, _ in rest)
        elsewhere = sum(n * v for n, v in rest) / times if times else 0.0
        heard = min(html.ELSEWHERE, times)
        out[host, i] = (pages + heard, (pages * value + heard * elsewhere) / (pages + heard))
    return out


def test_rules_and_what_they_keep_by_their_definitions(spark):
    pages = [(f"h{i % 4}.example", site(i)) for i in range(60)] + [("h9.example", site(1)), ("h9.example", site(2))]
    rows = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], SCHEMA)
    forest = html.trees(html.outlined(rows)).collect()
    got = {(r.host, r.id): (r.pages, r.importance) for r in html.ruled(html.trees(html.outlined(rows))).collect()}
    want = slow_rules(forest)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    shown = {r.page_id: r.text for r in html.extracted(rows).collect()}
    for i, (host, page) in enumerate(pages):
        kept, plain = [], []
        for node, text in html.blocks(html.parsed(page)):
            n, importance = want[host, node.id]
            weight = html.MOST_WEIGHT * n * n / (n * n + html.HALF_PAGES**2)
            prior = html.NOISE if node.noise else html.MAIN if node.main else html.UNKNOWN
            kept += [text] if (1 - weight) * prior + weight * importance >= html.THRESHOLD else []
            plain += [text] if not node.noise and not node.named and node.main else []
        assert shown[i] == "\n".join(kept or plain)


def test_names_are_kept_whole(spark):
    """Styles that differ only in a seventh class or after 120 characters are two nodes."""
    names = " ".join(f"class{c}" * 6 for c in "abcdefg")
    page = lambda i: f"<body><div class='{names} tail-x'>Same notice</div><div class='{names} tail-y'><p>Fresh {i}</p></div></body>"
    got = texts(spark, [(f"http://a.example/{i}", page(i)) for i in range(12)])
    assert [got[i].text for i in range(12)] == [f"Fresh {i}" for i in range(12)]


def test_extra_columns_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None, "<p>a", "x", 1), (1, None, "<p>a", "x", 1), (None, "u", None, None, None)], SCHEMA + ", text string, row long")
    got = html.extracted(rows)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
