import random

from evidentia.llm import pages
from evidentia.llm.queries import op10_page_differencing

from .conftest import prose


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_is_kept_and_frame_is_not(spark):
    body = """<header>Head</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies</div>
    <article><header><h1>The &amp; title</h1></header><p>One <b>bold</b>&nbsp;line<br>on.<p>Two&#33; <script>if (a < b) { x("</p>") }</script>
    <aside>Aside</aside><div class="ad">Buy</div><form><input><label>Name</label></form><div id="comments"><p>First!</p></div><p>Three</article>
    <div class="sidebar">Side</div><footer>&copy; Foot</footer>"""
    got = pages.extracted(spark.createDataFrame([(1, "http://a.example/x", page(body))], "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_chars) for r in got] == [("The & title One bold line on. Two! Three", 40)]


def test_neighbours_decide_where_nothing_is_marked(spark):
    rng = random.Random(1)
    frame_a, frame_b = "<div>Home</div><div>About us</div>", "<div>All rights</div>"
    rows, want = [], {}
    for i in range(30):
        text = [prose(rng, 12), prose(rng, 9)]
        url = f"https://{'one' if i % 3 else 'two'}.example/{'ab'[i % 2]}/{i:02d}?q={i}"
        rows.append((i, url, page(f"{frame_a}<div><p>{text[0]}</p><p>{text[1]}</p></div>{frame_b}")))
        want[i] = " ".join(text)
    rows.append((99, "https://lonely.example/", page(f"{frame_a}<p>Only page</p>")))
    want[99] = "Home About us Only page"
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in pages.extracted(docs).collect()} == want


def test_longest_common_subsequence_equals_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = sorted(pages.shared_lines(a, b))
        assert len(found) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_a_copied_article_stays(spark):
    text = "<article><p>Same words here</p></article>"
    rows = [(i, f"http://h.example/{i}", page(f"<nav>Menu {i}</nav>{text}")) for i in range(6)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["Same words here"] * 6


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "no host", ""), (1, "no host", ""), (2, "http://x.example/", "<p>a < b &amp c <!-- x"), (3, "http://x.example/", "<div>" * 3000 + "deep"), (4, "http://x.example/", "text only " * 50_000), (5, "http://x.example/", "<article></article><p>rest</p>"), (6, "http://x.example", "<script>never ends")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extracted(docs).collect()}
    assert got == {None: "", 1: "", 2: "a < b & c", 3: "deep", 4: ("text only " * 50_000).strip(), 5: "rest", 6: ""}
    assert pages.extracted(docs).count() == 8 and pages.extracted(docs.limit(0)).count() == 0


def test_names_of_frames(spark):
    kept = ['<div class="has-sidebar">', '<article class="post comments-open">', '<main id="content" class="with-footer">', '<p class="document">', '<div class="entry">']
    gone = ['<div class="commentlist">', '<div id="topnav">', '<ul class="mainMenu">', '<div class="siteFooter">', '<article class="comment">', '<div class="x cookieBar">', '<div role="banner">', '<p hidden>', '<section class="page-header">']
    for tag in kept + gone:
        lines = pages.lines_of(f"<body>{tag}text</body>")
        assert [x.frame for x in lines] == [tag in gone], tag
    inner = pages.lines_of('<article class="post"><h1 class="post-header">Head</h1><article class="comment x">Reply</article></article>')
    assert [(x.text, x.frame) for x in inner] == [("Head", False), ("Reply", True)]


def test_no_article_is_lost_by_names_or_broken_markup():
    """Heads without an end tag, headings and paragraphs with the names of frames, names that deny, and unquoted quotes."""
    cases = [
        ("<html><head><title>T</title><meta charset=x><body><article><p>kept</p></article>", "kept"),
        ("<html><head><title>T</title><article><p>kept</p></article>", "kept"),
        ('<article><h2 id="related-work">Related work</h2><p id="share-prices">Prices</p><p class="notice">Note</p></article>', "Related work Prices Note"),
        ('<article><p>One</p><p class="ad big">Buy</p><div class="share-bar">Share</div><p class="sponsored">x</p></article>', "One"),
        ('<div class="ad-free"><article><p>kept</p></article></div>', "kept"),
        ('<div class="menu-page banner"><article><p>kept</p><div class="ad">no</div></article></div>', "kept"),
        ('<section class="comments"><article><p>reply</p></article></section><div>body</div>', "body"),
        ("<article><p title=it's>kept</p><p data-x=a\"b title='> x'>too</p></article>", "kept too"),
        ('<article><a href=/x/ title="a > b">link</a> <i class=\'c\'>it</i></article>', "link it"),
    ]
    for page_, want in cases:
        assert pages.main_text(pages.lines_of(page_), None) == want, page_


def test_longer_names_and_topics_take_no_text_away():
    """Names with other words, ids that are topics, and articles that names alone would leave empty."""
    cases = [
        ('<article><section id="login-flow"><p>How login works.</p></section></article>', "How login works."),
        ('<article><p>One</p><section id="copyright-law">Two</section></article>', "One Two"),
        ('<article><p>One</p><div class="share-price-table">Two</div></article>', "One Two"),
        ('<article><p>One</p><table class="menu-prices"><tr><td>Two</td></tr></table></article>', "One Two"),
        ('<main id="search-results"><p>A b</p></main>', "A b"),
        ('<article hidden="until-found"><p>A b</p></article>', "A b"),
        ("<article hidden><p>A b</p></article><p>out</p>", "out"),
        ('<article><div class="notice">All there is</div></article>', "All there is"),
        ('<article><div class="ad">Buy</div></article>', ""),
        ('<article><p>One</p><div class="cookie-notice">no</div><div class="related-posts">no</div><div id="comments">no</div><div class="share-bar">no</div></article>', "One"),
        ('<article><p>One</p><div class="td-share-x"><a href="/a">Share on one</a> <a href="/b">Share on two</a></div></article>', "One"),
        ('<article><p>One</p><div class="login-steps">Open <a href="/a">the page</a> and then write your name there.</div></article>', "One Open the page and then write your name there."),
        ('<div id="login-flow"><p>No article, but text.</p></div><div class="menu">x</div>', "No article, but text."),
    ]
    for page_, want in cases:
        assert pages.main_text(pages.lines_of(page_), None) == want, page_


def test_what_the_neighbour_shares_decides_on_names_in_doubt():
    first, second = ('<article><p>{0}</p><section id="copyright-box"><p>Words of the site</p></section><div class="menu-prices"><p>Soup {0}</p></div></article>'.format(x) for x in ("one", "two"))
    assert pages.main_text(pages.lines_of(first), pages.lines_of(second)) == "one Soup one"
    assert pages.main_text(pages.lines_of(first), pages.lines_of(first)) == "one Words of the site Soup one"
    assert pages.main_text(pages.lines_of(first), None) == "one Words of the site Soup one"


def brute(rows):
    """The text of each page from (page_id, url, parts): neighbours by sorting, common lines by a table over all pairs.

    parts: (kind, line), of which only the kind's rule is known here: kept, gone, doubt (one container a line) or plain
    (outside of any article, of a page without one)."""
    order = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3].split("?")[0], r[0]))
    out = {}
    for i, (page_id, url, parts) in enumerate(order):
        host, path = url.split("/")[2], "/" + url.split("/", 3)[3].split("?")[0]
        best, length = None, -1
        for j in (i - 1, i + 1):
            if 0 <= j < len(order) and order[j][1].split("/")[2] == host:
                other = "/" + order[j][1].split("/", 3)[3].split("?")[0]
                n = next((k for k in range(min(len(path), len(other))) if path[k] != other[k]), min(len(path), len(other)))
                if n > length:
                    best, length = order[j], n
        a, b = [x for _, x in parts], [x for _, x in best[2]] if best else []
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a) - 1, -1, -1):
            for y in range(len(b) - 1, -1, -1):
                table[x][y] = 1 + table[x + 1][y + 1] if a[x] == b[y] else max(table[x + 1][y], table[x][y + 1])
        shared, x, y = set(), 0, 0
        while x < len(a) and y < len(b):
            if a[x] == b[y]:
                shared.add(x)
                x, y = x + 1, y + 1
            elif table[x + 1][y] >= table[x][y + 1]:
                x += 1
            else:
                y += 1
        kept = [k for k, (kind, _) in enumerate(parts) if kind == "kept"]
        copied = 2 * sum(k in shared for k in kept) > len(kept)
        text = [line for k, (kind, line) in enumerate(parts) if kind == "kept" or kind == "doubt" and (copied or k not in shared) or kind == "plain" and k not in shared]
        out[page_id] = " ".join(text)
    return out


def test_whole_query_equals_brute_force(spark, tmp_path):
    """Random pages of several hosts, with and without articles, of which frames repeat and some articles are copies."""
    rng = random.Random(9)
    forms = {
        "kept": ["<p>{}</p>", "<div><p>{}</p></div>", '<section id="intro">{}</section>', "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"],
        "gone": ["<nav>{}</nav>", '<div class="ad">{}</div>', "<aside>{}</aside>", '<div class="share-buttons">{}</div>', '<div class="cookie-notice">{}</div>', "<form>{}</form>"],
        "doubt": ['<section id="notice">{}</section>', '<div class="copyright-text-of-all">{}</div>', '<table class="menu-prices"><tr><td>{}</td></tr></table>'],
        "plain": ["<p>{}</p>", "<div>{}</div>", "<td>{}</td>"],
    }
    common = [f"Line {i} of the site" for i in range(8)]
    rows, html, articles = [], [], []
    for i in range(120):
        inside = rng.random() < 0.6
        if inside and articles and rng.random() < 0.2:
            parts = rng.choice(articles)
        else:
            own = [(rng.choice(["kept", "kept", "gone", "doubt"]) if inside else rng.choice(["plain", "plain", "gone"]), f"own {i} {k} {prose(rng, 3)}") for k in range(rng.randint(1, 6))]
            own += [("gone" if inside and rng.random() < 0.3 else "doubt" if inside else "plain", x) for x in sorted(rng.sample(common, rng.randint(0, 4)))]
            parts = [("kept", f"head {i}"), *own] if inside else own
        if inside:
            articles.append(parts)
        body = "".join(rng.choice(forms[kind]).format(line) for kind, line in parts)
        url = f"https://{rng.choice('xyz')}.example/{rng.choice(['a', 'ab', 'b/c'])}/{rng.randrange(40)}?q={i}"
        rows.append((i, url, parts))
        html.append((i, url, page(f"<article>{body}</article>" if inside else body), 1, "x"))
    spark.createDataFrame(html, "page_id long, url string, html string, host int, key string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = op10_page_differencing(spark, str(tmp_path)).collect()
    assert {r.page_id: r.text for r in got} == brute(rows) and len(got) == 120
    assert all(r.n_chars == len(r.text) for r in got)
