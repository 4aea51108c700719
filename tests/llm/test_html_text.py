import random

import numpy as np
from sessionlens.llm import html_text

SCHEMA = "page_id bigint, url string, html string, host string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p") for i, u, h in rows], SCHEMA)


ARTICLE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><!-- ad --><div class="ad">buy <div>now</div></div><article><h1>Head &amp; more</h1><p><b>bold<br><p>one\n  two&nbsp;three</p><div class="comments">c</div><form>f</form></article><footer>&copy; f</footer>'


def alone(source):
    return html_text.main_text(html_text.Page(html_text.lines(source)))


def test_article():
    assert alone(ARTICLE) == "Head & more\nbold\none two three"


def test_article_heads_and_names():
    body = '<header>site</header><article><header><h1>Title</h1></header><div class="post-header">By me</div><div class="related-work">Earlier work</div><div class="related-posts">more</div><div class="comment-list">c</div><div id="share-buttons">s</div><div class="ad-2">a</div><p>end</p></article>'
    assert alone(body) == "Title\nBy me\nEarlier work\nend"


def test_damaged_pages_end():
    for h in ("<", "<a", "<div class='x", '<p a="b>text', "a<b", "<!--", "<script>", "</div></nav>", "<nav>x<article>y", "<" * 20_000, "<p>" * 20_000, "< p > &#1234567; &bad;", "<svg>x" * 200_000, "</svg" * 50_000 + "<svg>", "<title>" * 50_000 + "</title"):
        alone(h)
    assert alone("<nav>x<article>y") == "y" and alone("<svg>a<p>b<svg>c</svg>d") == "d" and alone("<svg>a<p>b") == "a\nb"


def brute(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def shared(a, b):
    pairs = html_text.aligned(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and sorted(j for _, j in sorted(pairs)) == [j for _, j in sorted(pairs)]
    return {i for i, _ in pairs}


def test_shared_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        keep = sorted(shared(a, b))
        assert len(keep) == brute(a, b)
        it = iter(b)
        assert all(a[k] in it for k in keep)


def test_differencing_without_articles(spark):
    page = lambda body: f"<body><div>Site name</div><p>{body}</p><div>All rights</div></body>"
    rows = [(1, "http://h.org/a/1", page("first")), (2, "https://H.org/a/2?x", page("second")), (3, "http://other.org/a", page("alone")), (4, "http://h.org/a/2", page("second")), (5, None, None), (6, "", ""), (7, "http://z.org/1", ARTICLE), (7, "http://z.org/1", ARTICLE)]
    got = html_text.extract(pages(spark, rows).coalesce(1)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[1] == "first" and text[5] == text[6] == ""
    assert text[3] == "Site name\nalone\nAll rights" and text[7] == "Head & more\nbold\none two three"
    assert all(r["n_chars"] == len(r["text"]) for r in got) and html_text.extract(pages(spark, [])).count() == 0


def test_many_matches_align_too(monkeypatch):
    a, b = ["x"] * 1100 + ["a"] + ["y", "x"] * 20, ["b"] + ["x"] * 1100 + ["c"] + ["x", "y"] * 20
    assert sum(line == other for line in a for other in b) > html_text.MOST_MATCHES
    assert len(shared(a, b)) == html_text._lengths(np.array(a), np.array(b))[-1] > 1100
    rng = np.random.default_rng(0)
    cases = [tuple([str(k) for k in rng.integers(0, 4, int(rng.integers(0, 40)))] for _ in range(2)) for _ in range(200)]
    whole = [len(shared(a, b)) for a, b in cases]
    monkeypatch.setattr(html_text, "MOST_MATCHES", 5)
    for (a, b), n in zip(cases, whole, strict=True):
        found = shared(a, b)
        it = iter(b)
        assert len(found) == n and all(any(a[k] == line for line in it) for k in sorted(found))


def test_site_lines_inside_articles():
    # every article of the host has the same line, which goes; a quoted one, and a copy's lines, stay
    article = lambda k, more="": f"<nav>menu {k}</nav><article><p>part {k}</p><p>tail {k}</p><p>Read on our site</p>{more}</article>"
    sources = [article(k, "<p>quoted</p>" if k in (2, 3) else "") for k in range(8)] + [article(7)]
    pages_there = [html_text.Page(html_text.lines(x)) for x in sources]
    for k, page in enumerate(pages_there):
        for other in pages_there[max(0, k - html_text.REACH) : k]:
            html_text.meet(other, page)
    texts = [html_text.main_text(p) for p in pages_there]
    assert texts[3] == "part 3\ntail 3\nquoted" and texts[4] == "part 4\ntail 4" and texts[0] == "part 0\ntail 0\nRead on our site"
    few = [html_text.Page(html_text.lines(article(1))) for _ in range(9)]
    for k, page in enumerate(few):
        for other in few[:k]:
            html_text.meet(other, page)
    assert all(html_text.main_text(p) == "part 1\ntail 1\nRead on our site" for p in few)


def whole(rows):
    """The query by brute force: all pages in one list."""
    held = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3].split("?")[0], r[0]))
    made = [html_text.Page(html_text.lines(h)) for _, _, h in held]
    for k, page in enumerate(made):
        for j in range(max(0, k - html_text.REACH), k):
            if held[j][1].split("/")[2] == held[k][1].split("/")[2]:
                html_text.meet(made[j], page)
    out = {}
    for (i, _, _), page in zip(held, made, strict=True):
        kept = []
        for line, verdict in zip(page.own, html_text.verdicts(page), strict=True):
            if verdict == "text":
                kept.append(line.text)
        out[i] = "\n".join(kept)
    return out


def test_query_equals_brute_force_however_it_is_dealt(spark, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "site", "more"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 2)))
    rows = []
    for k in range(240):
        body = "".join(f"<p>{line()}</p>" for _ in range(rng.randint(1, 6)))
        inner = f"<article>{body}<p>signed by the host</p></article>" if k % 3 else body
        rows.append((k, f"http://{rng.choice('aab')}.org/{rng.randint(0, 400)}", f"<nav>{line()}</nav><div>{line()}</div>{inner}<footer>host</footer>"))
    want = whole(rows)
    monkeypatch.setattr(html_text, "LEAST_CHUNK", 16)
    monkeypatch.setattr(html_text, "GROUP", 4)
    for parts in (1, 5):
        got = html_text.extract(pages(spark, rows).repartition(parts)).collect()
        assert len(got) == 240 and {r["page_id"]: r["text"] for r in got} == want
    assert any("signed by the host" in t for t in want.values()) and any(t and "signed" not in t for k, t in want.items() if k % 3)


def test_inline_chrome_leaves_its_line_whole():
    kept = lambda page: [line.text for line in html_text.lines(page) if not line.chrome]
    assert kept('<article><p>One <span class="ad">x</span> two three</p></article>') == ["One two three"]
    assert kept("<article><p>Press <button>OK</button> to go on</p><p>end</p></article>") == ["Press to go on", "end"]
    assert kept('<p>a<span class="ad">x <b>y</b> <span>z</span><div>w</div></span>b</p>') == ["ab"]
    assert kept('<p>a <button>left open<article><p>b</p></article> c') == ["a", "b", "c"]
    assert kept("<p>a <button>left open") == ["a"]
    assert [line.text for line in html_text.lines("<p>a <button>x</button> b</p>")] == ["x", "a b"]
