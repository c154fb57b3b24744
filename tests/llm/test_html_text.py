import math
import random

import numpy as np
import pytest

from tickloom.llm import html_text

from .helpers import clashing

PAGE = """<!DOCTYPE html><html><head><title>Site title</title><style>p{{}}</style><script>var x = "</p>";</script></head>
<body class="has-sidebar"><header><a href="/">Site name</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- comment -->
<article><header><h1>The  headline</h1></header>{body}<form><label>Mail</label><input><button>Go</button></form></article>
<aside>Side text that goes on for a while, so that it looks like text.</aside>
<section id="comments"><p>First! A reader comment of some length, longer than the article itself may be.</p></section>
<footer>&copy; 2024 &middot; Footer</footer></body></html>"""


def test_article_alone():
    body = "<p>First <b>bold</b>\n text &amp; more&nbsp;&eacute;.<br>After break.<p>Unclosed <i>second.</p><div class='ad'>Buy now!</div><ul><li>item one<li>item two</ul><p>Ok.</p>"
    assert html_text.main_text(PAGE.format(body=body)) == "The headline\nFirst bold text & more é. After break.\nUnclosed second.\nitem one\nitem two\nOk."


def test_no_semantic_tags():
    text = "This is a sentence of the story that is long enough to count as content. " * 3
    page = f"<body><div class=menu><a>a</a><a>b</a></div><div id=story><p>{text}</p><p>Short.</p><p>{text}</p></div><div class=footer>foot</div></body>"
    assert html_text.main_text(page) == "\n".join([text.strip(), "Short.", text.strip()])


def test_sections_of_unequal_length():
    text = "This is a sentence of the story that is long enough to count as content. " * 3
    want = [f"{i} {text.strip()}" for i in range(16)]
    first, second = (want[:12], want[12:])
    section = lambda ps: f"<div class=section><h2>Part</h2>{''.join(f'<p>{p}</p>' for p in ps)}<p>Short.</p></div>"
    page = f"<body><div class=menu><a>a</a><a>b</a></div><div id=content>{section(first)}{section(second)}</div><div class=footer>foot</div></body>"
    assert html_text.main_text(page) == "\n".join(["Part", *first, "Short.", "Part", *second, "Short."])


def test_class_marks_alone_do_not_empty_a_page():
    text = "All of the text lies in an element with an unlucky class. " * 5
    assert html_text.main_text(f"<div class='widget'><p>{text}</p></div>") == text.strip()


TEXT = "This is a sentence of the story that is long enough to count as content. "
BODY = f"<h2>Part one</h2><p>{TEXT * 2}</p><p>Short.</p><p>{TEXT * 4}</p><ul><li>one thing</li><li>another thing</li></ul><p>{TEXT}</p>"
WANT = ["Part one", (TEXT * 2).strip(), "Short.", (TEXT * 4).strip(), "one thing", "another thing", TEXT.strip()]
COMMENTS = f"<h3>Comments</h3><div class='comment'><p>First! {TEXT * 3}</p></div><div class='comment'><p>{TEXT * 2}</p></div>"
MENU = "<ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li><li><a href=/c>About us</a></li></ul>"


@pytest.mark.parametrize(
    "page",
    [
        # borders by divs with ids alone
        f"<body><div id=header><h1>The Site</h1></div><div id=menu>{MENU}</div><div id=content>{BODY}</div><div id=sidebar><h3>Recent</h3><p>{TEXT}</p></div><div id=comments>{COMMENTS}</div><div id=footer>Imprint</div></body>",
        # no class, id or tag says what is content
        f"<body><div><div>{MENU}</div></div><div>{BODY}</div><div>{MENU}</div><div>All rights reserved</div></body>",
        # a mark around the whole page, a notice, comments
        f"<div class='page has-sidebar'><div class=cookie-notice>We use cookies.</div><article>{BODY}</article><section class=comments>{COMMENTS}</section></div>",
        f"<div class=widget>{MENU}{BODY}</div>",
        # adverts, boxes and forms between the paragraphs
        f"<main>{BODY.replace('<ul>', f'<div class=ad>Buy it now, it is cheap!</div><aside>{TEXT}</aside><form><p>Subscribe</p><input></form><div class=related-posts><a href=x>Another story</a></div><ul>')}</main>",
        # tags of the article's own, a last word that overrules
        f"<main><div class=tags-article>{BODY}</div><div class=post-tags><a href=x>storytelling</a> <a href=y>sentences</a></div></main>",
        # what is hidden, and what a reader does not see
        f"<body><article><template><p>{TEXT}</p></template><div style='display: none'><p>{TEXT}</p></div>{BODY}<script>var x = '{TEXT}';</script><p hidden>{TEXT}</p></article></body>",
    ],
)
def test_layouts(page):
    assert html_text.main_text(page).split("\n") == WANT


def test_headline_in_a_header_of_its_own():
    for around in ("div", "article"):
        page = f"<body><nav>{MENU}</nav><{around}><div class=entry-header><h1>The headline</h1></div><div class=entry-content>{BODY}</div></{around}><footer>f</footer></body>"
        assert html_text.main_text(page).split("\n") == ["The headline", *WANT]


def random_page(rnd):
    """Marked and unmarked parts around an article with long and short paragraphs."""
    paragraphs = [" ".join(rnd.choice(["word", "some", "of", "it", "sentences"]) for _ in range(rnd.choice([3, 30, 80]))) for _ in range(rnd.randint(4, 9))]
    inner = "".join(f"<p>{p}</p>" for p in [TEXT, *paragraphs])
    return f"<body><nav>{MENU}</nav><div class=ad>{TEXT}</div><div>{MENU}</div><{(tag := rnd.choice(['article', 'div']))}>{inner}</{tag}><footer>{TEXT}</footer></body>", [TEXT.strip(), *paragraphs]


def test_clusters_equal_plain_loops():
    """Ratios, smoothing between marks and the threshold by plain loops."""
    rnd = random.Random(4)
    for _ in range(30):
        page = html_text.parsed(random_page(rnd)[0])
        ratios = [len(x.text) / max(1, x.tags) for x in page.lines]
        marked = [x.at.parent.parent.tag == "nav" or x.at.tag in ("div", "footer") for x in page.lines]
        values = []
        for i, own in enumerate(marked):
            reach = [j for j in range(max(0, i - 3), min(len(ratios), i + 4)) if all(marked[k] == own for k in range(min(i, j), max(i, j) + 1))]
            weights = [math.exp(-0.5 * ((i - j) / html_text.SIGMA) ** 2) for j in reach]
            smooth = sum(w * ratios[j] for w, j in zip(weights, reach, strict=True)) / sum(weights)
            values.append(math.log1p(smooth * (html_text.DOUBT if own else 1)))
        assert np.allclose(html_text.line_values(page), values)
        low, high = min(values), max(values)
        for _ in range(50):
            a, b = [v for v in values if v < (low + high) / 2], [v for v in values if v >= (low + high) / 2]
            low, high = sum(a) / len(a) if a else low, sum(b) / len(b)
        assert html_text.upper_cluster(np.array(values)).tolist() == [v >= (low + high) / 2 for v in values]


def test_clusters_decide():
    """Other clusters give other texts: the lower cluster, all lines, or lines by chance."""
    rnd = random.Random(5)
    pages = [random_page(rnd) for _ in range(100)]
    changed = [0, 0, 0]
    for html, want in pages:
        assert html_text.main_text(html).split("\n") == want
        chosen = html_text.upper_cluster(html_text.line_values(html_text.parsed(html)))
        for k, other in enumerate((~chosen, chosen | True, np.array([rnd.random() < 0.5 for _ in chosen]))):
            changed[k] += html_text.content_lines(html_text.parsed(html), other) != want
    assert changed[0] > 95 and changed[1] > 95 and changed[2] > 30


def test_long_and_deep_pages():
    paragraphs = [f"{i} {TEXT}".strip() for i in range(20_000)]
    assert html_text.main_text(f"<nav>{MENU}</nav><article>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article>").split("\n") == paragraphs
    assert html_text.main_text("<div>" * 5000 + "<p>deep</p>" * 3000).count("deep") == 3000


def test_bad_pages():
    for page in (None, "", "   ", "<", "<p", "<!--", "<![bad[", "</p></div>", "<script>x", "&#xFFFFFFF;", "<b>" * 3000):
        assert isinstance(html_text.main_text(page), str)
    assert html_text.main_text("plain  text\n only") == "plain text only"
    assert html_text.main_text("<p>a<![ odd</p>").startswith("a")


def test_slices_change_nothing(monkeypatch):
    page = PAGE.format(body="<p>Text &amp; entities &eacute; <b>bold</b> here.</p>" * 30)
    want = html_text.main_text(page)
    monkeypatch.setattr(html_text, "SLICE", 7)
    assert html_text.main_text(page) == want


def test_report(spark):
    rows = [(1, "u1", PAGE.format(body="<p>Some text.</p>")), (2, None, None), (None, "u3", ""), (1, "u1", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = clashing(pages.selectExpr("*", "'clash' text", "1 n_chars"))
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.page_report(pages).collect())
    assert got == [("1", "u1", "The headline\nSome text.", 23), ("1", "u1", "x", 1), ("2", "None", "", 0), ("None", "u3", "", 0)]
    assert html_text.page_report(pages.limit(0)).collect() == []
    kept = html_text.extract(pages).selectExpr("row.*", "text found").collect()
    assert all(r.text == r.asDict()["_"] == "clash" for r in kept) and sorted(r.found for r in kept) == sorted(g[2] for g in got)
