import html as entities
import math
import random
import re
import time

import pytest

from flowloom.llm import html_text

from .helpers import rows_of, save, words


def article(k, n=4):
    r = random.Random(k)
    return [words(100 * k + j, r.randint(12, 80)) for j in range(n)]


SHELLS = {
    "article": '<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>Head line</h1>%s</article><footer>© foot</footer></body></html>',
    "divs": '<html><body><div id="menu"><a href=/1>One</a> <a href=/2>Two</a></div><div class="content"><h1>Head line</h1>%s</div><div class="sidebar"><p>Popular now</p><a href=/x>Other story</a></div><div class="footer">foot</div></body></html>',
    "table": '<table><tr><td><a href=/1>One</a><a href=/2>Two</a></td><td><h1>Head line</h1>%s</td></tr></table>',
    "comments": '<body><header><a href=/>Site</a></header><main><h1>Head line</h1>%s</main><div class="comments"><p>First! I think this is a rather long reader comment about the piece above, is it not so.</p></div><aside>See also</aside><form><label>Mail</label><input></form></body>',
    "notice": '<body><div class="cookie-notice">We use cookies to make this site work for you.</div><div class="ad">Buy now</div><section><h1>Head line</h1>%s</section></body>',
}


@pytest.mark.parametrize("shell", SHELLS)
def test_article_without_what_surrounds_it(shell):
    for k in range(8):
        parts = article(k, 1 + k % 5)
        body = "".join(f"<p>{entities.escape(p)} &amp; <b>bold</b>{'<br>' if k % 2 else ''}</p>\n" for p in parts)
        want = " ".join(["Head line", *[f"{p} & bold" for p in parts]])
        assert html_text.main_text(SHELLS[shell] % body) == want


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("<!-- only -->", ""), ("plain   text\n here", "plain text here"),
        ("<p>a<p>b", "a b"), ("<p>x &lt;y&gt; &eacute;&#233;&#x1F600;", "x <y> éé😀"), ("<script>never closed", ""),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<div><p>un<b>bro</b>ken</div>", "unbroken"), ("<", "<"), ("</p></div>", ""),
    ],
)
def test_odd_pages(source, text):
    assert html_text.main_text(source) == text


def test_deep_and_long_pages_end():
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"
    long = "word " * 200_000
    assert html_text.main_text(f"<body><p>{long}</p></body>") == long.strip()
    html_text.main_text("<p " * 50_000)
    html_text.main_text("<a href='" * 20_000)


PROSE = "".join(f"<p>{words(k, 40)}</p>" for k in range(3))
TEXT = " ".join(words(k, 40) for k in range(3))


@pytest.mark.parametrize("name", ["no-sidebar", "content ads-free", "social-history", "tags-explained", "related", "post-comments"])
def test_class_words_do_not_delete_the_article(name):
    page = f'<body><nav><a href=/>x</a></nav><div class="{name}">{PROSE}</div><div class="footer">foot text</div></body>'
    assert html_text.main_text(page) == TEXT


@pytest.mark.parametrize("name", ["ad", "cookie-notice", "reader-comments", "sidebar_left", "newsletterSignup", "box related"])
def test_named_parts_inside_the_article_go(name):
    page = f'<body><div class="page"><h1>Head</h1>{PROSE}<div class="{name}"><p>{words(9, 12)}</p><p>{words(10, 8)}</p></div></div></body>'
    assert html_text.main_text(page) == "Head " + TEXT
    assert html_text.main_text(page.replace('div class="page"', "article").replace("</div></body>", "</article></body>")) == "Head " + TEXT


def test_menus_in_main_go_and_sibling_articles_stay():
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(8)) + "</ul>"
    assert html_text.main_text(f"<body><main>{menu}<h1>Head</h1>{PROSE}</main></body>") == "Head " + TEXT
    two = f"<body>{menu}<article><h2>A</h2>{PROSE}</article><article><h2>B</h2><p>{words(7, 50)}</p></article></body>"
    assert html_text.main_text(two) == f"A {TEXT} B {words(7, 50)}"
    cited = f'<body><article>{PROSE}<p>See <a href="/x">{words(8, 3)}</a></p></article></body>'
    assert html_text.main_text(cited) == f"{TEXT} See {words(8, 3)}"


@pytest.mark.parametrize("unit", [("<b>", "</i>"), ("<b>", "<p>x"), ("<div>", "</span>"), ("<a href=x>", "<li>y"), ("<ul>", "<li>"), ("<table><tr>", "</td>")])
def test_unbalanced_tags_take_linear_time(unit):
    began = time.process_time()
    html_text.main_text(unit[0] * 60_000 + unit[1] * 60_000)
    assert time.process_time() - began < 15


def random_tree(r, depth=0):
    """``(tag, children)`` with text children; tags whose ends are never implied."""
    kids = []
    for _ in range(r.randint(1, 4)):
        if depth > 3 or r.random() < 0.4:
            kids.append(words(r.randint(0, 999), r.randint(1, 30)))
        else:
            kids.append(random_tree(r, depth + 1))
    return ("a" if depth and r.random() < 0.25 and all(isinstance(k, str) for k in kids) else r.choice(["div", "section", "blockquote"]), kids)


def html_of(node):
    return node if isinstance(node, str) else f"<{node[0]}>{' '.join(map(html_of, node[1]))}</{node[0]}>"


def measured(node, in_link, out, body_share):
    """Recursive reference: ``(C, T, LC, LT)`` of a node; appends ``(density, sum)`` in page order."""
    in_link |= node[0] == "a"
    at = len(out)
    out.append(None)
    c, t, lc, lt, total, own = 0, 1, 0, int(in_link), 0.0, 0
    for kid in node[1]:
        if isinstance(kid, str):
            own += len(kid.replace(" ", ""))
        else:
            below = measured(kid, in_link, out, body_share)
            total += below[4]
            c, t, lc, lt = (x + y for x, y in zip((c, t, lc, lt), below))
    c, lc = c + own, lc + own * in_link

    def density(c, t, lc, lt):
        base = math.log(1 + math.log(c / max(c - lc, 1) * lc + body_share * c + math.e))
        return c / t * math.log(max(1, c / max(lc, 1) * t / max(lt, 1))) / base

    if own:
        total += density(own, 1, own * in_link, int(in_link))
    d = density(c, t, lc, lt) if c else 0.0
    out[at] = (d, total)
    return c, t, lc, lt, d


def test_densities_equal_the_formula_on_random_trees():
    r = random.Random(11)
    for _ in range(60):
        tree = ("body", [random_tree(r) for _ in range(r.randint(1, 4))])
        page = html_text.Page(html_of(tree))
        page.settle()
        c, _, lc, *_ = measured(tree, False, [], 0.0)
        want = []
        measured(tree, False, want, lc / c)
        density, sums, _ = page.densities(1, True)
        assert density[1:] == pytest.approx([d for d, _ in want]) and sums[1:] == pytest.approx([s for _, s in want])


def test_query_keeps_every_row(spark, tmp_path):
    rows = [(1, "u1", SHELLS["article"] % "<p>alpha beta gamma delta</p>"), (1, "u1", SHELLS["article"] % "<p>alpha beta gamma delta</p>"), (2, None, None), (None, "u3", ""), (4, "u4", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    save(pages, tmp_path, "pages")
    got = rows_of(html_text.query(spark, str(tmp_path)), "page_id", "url", "text", "n_chars")
    text = "Head line alpha beta gamma delta"
    assert got == sorted([(1, "u1", text, len(text)), (1, "u1", text, len(text)), (2, None, "", 0), (None, "u3", "", 0), (4, "u4", "x", 1)], key=lambda r: tuple((x is None, str(x)) for x in r))


def test_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    assert html_text.query(spark, str(tmp_path)).count() == 0


def test_link_lists_have_less_density_than_prose():
    page = html_text.Page("<body><div><a href=/1>one two three</a><a href=/2>four five six</a></div><div><p>" + words(1, 60) + "</p></div></body>")
    assert page.article() == words(1, 60)
    assert not re.search("one two", page.article())


def test_visible_text_of_rare_elements_stays():
    """Formulas, examples and fallback text are text; the contract leaves none of them out."""
    line = "This is a long sentence of an article that has many words in it. "
    page = f"<article><p>{line * 4}</p><p>So <math><mi>E</mi><mo>=</mo>mc2</math> holds.</p><xmp>a < b &amp; c</xmp><p>{line}</p></article>"
    assert html_text.main_text(page) == f"{(line * 4).strip()} So E=mc2 holds. a < b &amp; c {line.strip()}"
    assert html_text.main_text("<p>see <svg><text>axis</text></svg> and <object>part</object></p>") == "see axis and part"
    assert html_text.main_text("<noframes><p>x y</p></noframes>") == "x y"


@pytest.mark.parametrize("footer", [
    "<div>Copyright 2024 Example Inc. All rights reserved.</div>", "<div>&copy; Example, 2019-2024</div>", "<div>&copy; 2024 Example</div><section>Privacy Policy | Terms</section>",
])
@pytest.mark.parametrize("shell", ["<body><article>%s</article>%s</body>", "<body>%s%s</body>", "<body><div>%s</div>%s</body>", "<body><div>%s%s</div></body>"])
def test_plain_footers_go(shell, footer):
    line = "This is a long sentence of an article that has many words in it, and on it goes. "
    text = "".join(f"<p>{line * 4}</p>" for _ in range(3)) + "<p>In 1976 the law on copyright changed.</p>"
    want = " ".join([line * 4] * 3).replace("  ", " ") + "In 1976 the law on copyright changed."
    assert html_text.main_text(shell % (text, footer)) == want
    assert html_text.main_text(f"<body>{footer}</body>") != ""
    own = f"<article>{text}<p>All rights reserved.</p></article>"  # a paragraph of the article is none
    assert html_text.main_text(own + footer) == want + " All rights reserved."
