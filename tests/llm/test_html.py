import html as entities
import math
import random
import re

import pytest

from lumenframe.llm.html import main_text
from lumenframe.llm.queries import op1_text_density
from tests.llm.helpers import DATA

LONG = "This is the article's own text, long enough to count as content, with commas and so on."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("  \n", ""),
        ("plain &amp; simple\ntext", "plain & simple text"),
        (f"<body><nav><a href=a>Home</a><a href=b>News</a></nav><div id=content><h2>Title</h2><p>{LONG}<p>{LONG}</div><footer>(c)</footer>", f"Title\n{LONG}\n{LONG}"),
        (f"<article><header><h1>Head</h1></header><p>{LONG}</p></article><header>Site</header>", f"Head\n{LONG}"),
        (f"<main><h1>H</h1><div><p>{LONG}</p><p>{LONG} <a href=x>link</a></p></div></main>", f"H\n{LONG}\n{LONG} link"),
        (f"<article><p>{LONG}</p><div class='ad-slot'>Buy now, cheap and good, a lot of text here, and more of it.</div><p>a&nbsp; b\n\tc</p></article>", f"{LONG}\na b c"),
        (f"<article><p>{LONG}</p><section id=comments><p>First! {LONG}</p></section><form><p>Your name</p></form></article>", LONG),
        (f"<div class=cookieNotice>{LONG}</div><div role=navigation>{LONG}</div><aside>{LONG}</aside><article><p>x</p></article>", "x"),
        ("<article><p>a<br>b</p><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "a b\none\ntwo\n1\n2"),
        ("<article><p>1 &lt; 2 &#233; &#x41;</p><script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --></article>", "1 < 2 é A"),
        ("<article><p>never closed <b>bold <i>both</b> text", "never closed bold both text"),
        ("<p", ""),
        ("</div></p>text<", "text<"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_every_article_over_the_threshold_is_content():
    """One section has the node with the largest sum; the others qualify by their density, and stay whole."""
    part = lambda i, n: f"<article><h2>Part {i}</h2>{f'<p>{LONG}</p>' * n}<p>ok {i}</p></article>"
    text = lambda i, n: "\n".join([f"Part {i}", *[LONG] * n, f"ok {i}"])
    want = "\n".join([text(0, 9), text(1, 2), text(2, 3)])
    links = "<div><ul><li><a href=a>More</a><li><a href=b>Others</a></ul></div>"
    parts = part(0, 9) + part(1, 2) + part(2, 3)
    for page in (f"<body>{parts}{links}</body>", f"<main>{parts}{links}</main>", f"<body><section>{part(0, 9)}</section><div>{part(1, 2)}{part(2, 3)}</div>{links}"):
        assert main_text(page) == want


def test_text_beside_an_article_is_content():
    text = f"<p>{LONG}</p>"
    page = f"<body><div><p>{LONG * 2}</p><p>{LONG * 2}</p></div><article><h1>T</h1>{text * 9}<p>End.</p></article></body>"
    assert main_text(page) == "\n".join([LONG * 2] * 2 + ["T"] + [LONG] * 9 + ["End."])


@pytest.mark.parametrize(
    "attributes",
    ["class='content has-sidebar'", "class='post no-comments'", "class=elementor-widget-container", "id='search-result'", "title='A hidden gem'", "data-id='search'", "class=widget", "data-role=banner title='class=ad'", "id=discussion"],
)
def test_containers_that_hold_the_text_stay(attributes):
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    assert main_text(f"<body><nav>Menu</nav><div {attributes}>{text}</div><div class=sidebar><p>Side.</p></div></body>") == f"{LONG}\n{LONG}"
    assert main_text(f"<article><p {attributes}>{LONG}</p><p>End.</p></article>") == ("End." if "discussion" in attributes else f"{LONG}\nEnd.")


def test_words_inside_other_attributes_drop_nothing():
    for attributes in ("title='A hidden gem'", "data-id='search'", "alt='role=dialog'", "class=has-sidebar"):
        assert main_text(f"<article><p>{LONG}</p><p {attributes}>Short.</p></article>") == f"{LONG}\nShort."


@pytest.mark.parametrize("name", ["sidebar", "site-footer", "ad-slot", "cookieNotice", "comments-area", "comment-list", "social share", "site-header"])
def test_named_furniture_goes(name):
    for key in ("class", "id"):
        assert main_text(f"<body><div {key}='{name}'><p>Not this text.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}"


def test_long_comments_go_beside_an_article():
    for page in ("<article><p>{0}</p>{1}</article>", "<article><p>{0}</p></article>{1}"):
        assert main_text(page.format(LONG, f"<div class=comments>{f'<p>{LONG}</p>' * 9}</div>")) == LONG


def test_deep_nesting():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_given_pages_against_their_articles(spark):
    """In these pages the article element holds the whole text: a plain reading of it must agree."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in op1_text_density(spark, DATA).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)


def test_the_article_element_decides_nothing(spark):
    """Density alone finds the same text when no element is named article."""
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        assert main_text(re.sub(r"(</?)article", r"\1div", r.html or "")) == main_text(r.html)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p title="unclosed>Some text here</p>', "Some text here"),
        (f'<div><p title="unclosed>{LONG}</p><p class="x">{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f"<div><p title='a > b'>{LONG}</p></div>", LONG),
        (f"<body><div id=content class='post share'><p>{LONG}</p><p>{LONG}</p></div><p>Tiny.</p></body>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><p class='alert-level'>Level four.</p><section class='related-work'><p>{LONG}</p></section></article>", f"{LONG}\nLevel four.\n{LONG}"),
        (f"<article><p>{LONG}</p></article><div class='user-remarks'><p>{LONG}</p></div>", LONG),
    ],
)
def test_broken_quotes_and_loose_words(page, want):
    assert main_text(page) == want


def plain(body):
    """The text of a DOM of (tag, children) by the formulas, read from scratch for every node."""

    def below(n):
        return [x for c in n[1] if isinstance(c, tuple) for x in [c, *below(c)]]

    chars = lambda n: sum(len(c) if isinstance(c, str) else chars(c) for c in n[1])
    links = lambda n: chars(n) if n[0] == "a" else sum(links(c) for c in n[1] if isinstance(c, tuple))
    share = links(body) / chars(body) if chars(body) else 0

    def density(n):
        c, lc, t, lt = chars(n), links(n), max(1, len(below(n))), max(1, sum(x[0] == "a" for x in below(n)))
        if not c:
            return 0.0
        base = math.log(max(1.1, math.log(c / max(1, c - lc) * lc + share * c + math.e)))
        return max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * (t / lt))) / base)

    total = lambda n: sum(density(c) for c in n[1] if isinstance(c, tuple) and c[0] != "a") or density(n) * 1e-9
    best = lambda n: max([n, *below(n)], key=total)  # noqa: E731  the first of equals is the outermost

    def path(n, goal):
        return [n] if n is goal else next(([n, *p] for c in n[1] if isinstance(c, tuple) and (p := path(c, goal))), [])

    threshold = min(map(density, path(body, best(body))))
    marked = [id(best(n)) for n in [body, *below(body)] if density(n) >= threshold]
    out = []

    def text(n):
        for c in n[1]:
            out.append(c) if isinstance(c, str) else (out.append("\n"), text(c), out.append("\n")) if c[0] != "a" else text(c)

    def take(n):
        if id(n) in marked:
            out.append("\n"), text(n), out.append("\n")
        else:
            [take(c) for c in n[1] if isinstance(c, tuple)]

    take(body)
    return "\n".join(x for x in "".join(out).split("\n") if x)


def test_random_pages_against_the_formulas():
    r = random.Random(4)
    words = lambda: " ".join("".join(r.choice("abcde") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 30)))

    def node(depth):
        kids = [node(depth - 1) if depth and r.random() < 0.6 else words() if r.random() < 0.8 else ("a", [words()]) for _ in range(r.randint(1, 4))]
        return (r.choice(["div", "section", "div", "blockquote"]) if depth else "p", kids if depth else [words()])

    write = lambda n: f"<{n[0]}>{''.join(c if isinstance(c, str) else write(c) for c in n[1])}</{n[0]}>"
    for _ in range(300):
        body = ("body", [node(r.randint(0, 4)) for _ in range(r.randint(1, 4))])
        assert main_text(write(body), grow=False) == plain(body), write(body)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_articles_in_parts(tag):
    """Title and sections of 2, 8 and 1 paragraphs: all twelve blocks, and nothing around them."""
    parts = "".join(f"<section>{f'<p>{LONG}</p>' * n}</section>" for n in (2, 8, 1))
    around = "<nav><a href=a>Home</a></nav>{}<div class=sidebar><p>Side.</p></div><div><ul><li><a href=b>More</a><li><a href=c>Others</a></ul></div><footer>(c)</footer>"
    want = "\n".join(["Title"] + [LONG] * 11)
    assert main_text(f"<{tag}><h1>Title</h1>{parts}</{tag}>") == want
    assert main_text(f"<body>{around.format(f'<{tag}><h1>Title</h1>{parts}</{tag}>')}</body>") == want
    assert main_text(f"<body><div class=page>{around.format(f'<{tag}><h1>Title</h1>{parts}</{tag}>')}</div></body>") == want


@pytest.mark.parametrize("node", ["<p class='remark'>{}</p>", "<p id='banner'>{}</p>", "<div class='notice'>{}</div>", "<blockquote class=replies>{}</blockquote>"])
def test_names_alone_drop_nothing_in_an_article(node):
    said = "A remark that belongs here."
    assert main_text(f"<article><p>{LONG}</p>{node.format(said)}<p>{LONG}</p></article>") == f"{LONG}\n{said}\n{LONG}"
    linked = "<a href=a>One place</a> <a href=b>another place</a> more"
    assert main_text(f"<article><p>{LONG}</p>{node.format(linked)}<p>{LONG}</p></article>") == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["feedback", "user-opinions", "reader_comments", "userFeedback"])
def test_reader_comments_beside_the_text(name):
    said = "".join(f"<div><b>Someone</b><p>{LONG} {i}</p></div>" for i in range(6))
    for page in ("<body><article><p>{0}</p></article>{1}</body>", "<body><main><article><p>{0}</p></article>{1}</main></body>"):
        assert main_text(page.format(LONG, f"<div class='{name}'>{said}</div>")) == LONG


#: Whole pages whose text was marked by hand: what stands between { and }.
MARKED = [
    "<html><head><title>x</title></head><body><div id=top><a href=/>Site</a> <a href=/a>A</a></div><div id=wrap><div class=post><h1>{A day out}</h1><div class=text><p>{We went out early, while it was still dark, and saw the sun rise.}</p><h2>{Noon}</h2><p>{By noon it was hot. We sat under a tree and ate.}</p></div><div class=text><p>{In the evening we came back.}</p></div></div></div><div id=bottom><a href=/i>Imprint</a></div></body></html>",
    "<body><header><h1>Site name</h1></header><main><h1>{Bread}</h1><section><h2>{Flour}</h2><p>{Take a pound of flour, and sieve it twice, so that no lumps stay in it.}</p></section><section><h2>{Water}</h2><ul><li>{half a pint, warm}</li><li>{a little more later, if the dough stays dry}</li></ul></section></main><aside><p>Other recipes of this week, with many words in them, more than you would think.</p></aside></body>",
    "<body><table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><p>{The first paragraph of a page that is laid out by a table.}</p><p>{The second one, which is about as long as the first one.}</p></td></tr></table></body>",
    "<body><nav>Menu</nav><div><div><p>{Short.}</p></div><div><p>{A much longer paragraph that holds most of what this page has to say to its readers.}</p><p>{And one more of that kind, to be sure that it is found.}</p></div></div><div class=share><a href=t>Tell a friend</a></div></body>",
]


@pytest.mark.parametrize("page", MARKED)
def test_pages_marked_by_hand(page):
    assert main_text(re.sub("[{}]", "", page)).split("\n") == re.findall(r"\{(.*?)\}", page)
