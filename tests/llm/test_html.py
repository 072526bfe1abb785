import re
from html.parser import HTMLParser

import pytest

from tessera.llm import html
from tessera.llm.html import extracted, main_text

LONG = "The quick brown fox is not one of the many that were in the house when it was all for the best, and so they said to us that it is what it is, with more of the same in the next of all the days that they had."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<p>" + LONG, LONG),
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p><b>{LONG}<br>More.<p>Short.</article><footer>&copy; x</footer>", f"A & B\n\n{LONG}\n\nMore.\n\nShort."),
        (f"<body><div class='sidebar'><p>{LONG}</p></div><div><p>{LONG}</p><p>Tiny one.</p><p>{LONG}</p></div><div id=comments><p>{LONG}</p></div>", f"{LONG}\n\nTiny one.\n\n{LONG}"),
        (f"<main><p>{LONG}</p><div class='cookie-notice'>We use cookies</div><form><p>{LONG}</p></form><script>var a='</p>';</script></main>", LONG),
        (f"<article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section><aside>{LONG}</aside></article>", LONG),
        ("<article><p>a\n\t b&nbsp;c&#233;&#x41;</p><!-- <p>no</p> --></article>", "a b céA"),
        (f"<div><a href=1>one</a> | <a href=2>two</a> | <a href=3>three</a></div><p>{LONG}</p>", LONG),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


TEASER = "<article class=card><h3><a href=x>Another story of the day</a></h3><p>A few lines on it.</p></article>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div><h1>Title</h1><p>{LONG}</p><p>Tiny one.</p><p>{LONG}</p></div><div>{TEASER}{TEASER}</div>", f"Title\n\n{LONG}\n\nTiny one.\n\n{LONG}"),
        (f"<div>{TEASER}</div><p>{LONG}</p><p>{LONG}</p>", f"{LONG}\n\n{LONG}"),
        (f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>", f"Title\n\n{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><p><a href=x>More of this and that</a></p><p>Photo: someone</p><p><a href=y>Buy it</a></p><p>{LONG}</p></article>", f"{LONG}\n\n{LONG}"),
    ],
)
def test_two_passes_decide_with_and_without_articles(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "attrs,gone",
    [
        ("class='overflow-hidden'", False), ("class=visually-hidden-focusable", False), ('aria-hidden="false"', False), ("title='hidden'", False), ("data-style='display:none'", False),
        ("hidden", True), ("class=a hidden=''", True), ("HIDDEN=until-found", True), ("aria-hidden=true", True), ("style='color:red; display : none'", True),
    ],
)
def test_hidden_elements(attrs, gone):
    assert main_text(f"<body><article {attrs}><p>{LONG}</p></article>") == ("" if gone else LONG)
    assert main_text(f"<body {attrs}><p>{LONG}</p>") == ("" if gone else LONG)


@pytest.mark.parametrize(
    "name,gone",
    [
        ("content no-sidebar", False), ("post ad-free", False), ("two-columns with-menu", False), ("has-sidebar", False), ("download-area", False),
        ("ad", True), ("post comments", True), ("site-footer", True), ("left_sidebar", True), ("cookie-notice", True),
    ],
)
def test_class_names(name, gone):
    assert main_text(f"<body><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div>") == (LONG if gone else f"{LONG}\n\n{LONG}")


PROSE = "It was the one that they had in the house when all of us were there for the first time, and so it is."


@pytest.mark.parametrize(
    "block,want",
    [
        ('<h2 id="cookies">Cookies</h2>', "Cookies"), (f'<section id="related-work"><p>{PROSE}</p></section>', PROSE), (f'<section id="search"><p>{PROSE}</p></section>', PROSE), (f'<p class="ad-hoc">{PROSE}</p>', PROSE),
        ("<p>See <a href=x>a link of some length</a> for the details of it.</p>", "See a link of some length for the details of it."), ("<p>The © sign is used in law.</p>", "The © sign is used in law."),
        (f'<section id="comments"><p>{PROSE}</p></section>', ""), (f'<section class="comments"><p>{PROSE}</p></section>', ""), (f'<div id="related"><p>{PROSE}</p></div>', ""), ('<p id="share"><a href=x>Post</a> <a href=y>Mail</a></p>', ""),
        ("<p><a href=x>More of this and that and of the other</a> <a href=y>and of all of it</a></p>", ""), ('<p class="ad-slot">Buy shiny things today!</p>', ""), ("<p><a href=x>Read more stories</a></p>", ""),
    ],
)
def test_marks_need_a_second_sign_in_running_text(block, want):
    around = f"<body><nav>x</nav><article><h1>T</h1><p>{LONG}</p>{{}}<p>{LONG}</p></article><footer>f</footer>"
    assert main_text(around.format(block)) == "\n\n".join(filter(None, ["T", LONG, want, LONG]))


class Second:
    """The two passes once more, over the blocks, written the plain way: a list of decisions, and a walk in both directions."""

    def __init__(self, blocks):
        self.blocks = blocks

    def stops(self, b):
        found = re.findall(r"[^\W\d_]+", b.text.lower())
        return sum(w in html.STOP_WORDS for w in found) / len(found) if found else 0.0

    def decide(self, b, names_count):
        marked = b.aside == 3 or (names_count and b.aside == 2) or (b.aside == 1 and (b.links > 0 or self.stops(b) < 0.10))
        if marked:
            return False
        one_link = b.article and b.links == 1 and b.link_chars < 0.7 * len(b.text) and self.stops(b) >= 0.10 and b.tag not in ("h1", "h2", "h3", "h4", "h5", "h6")
        if b.link_chars > 0.2 * len(b.text) and not one_link:
            return False
        if "©" in b.text and len(b.text) < 200 and not b.article:
            return False
        if len(b.text) < 70:
            return False if b.link_chars and self.stops(b) < 0.10 else "short"
        if self.stops(b) >= 0.22:
            return True if len(b.text) > 200 else "near"
        if self.stops(b) >= 0.10:
            return "near"
        return "short" if b.article else False

    def labels(self):
        first = [self.decide(b, True) for b in self.blocks]
        if True not in first and any(b.aside == 2 for b in self.blocks):
            first = [self.decide(b, False) for b in self.blocks]
        good_articles = {b.article for b, f in zip(self.blocks, first) if f is True}
        out = []
        for i, (b, f) in enumerate(zip(self.blocks, first)):
            if isinstance(f, bool):
                out.append(f)
                continue
            if not good_articles:
                out.append(f == "near" or b.article > 0)
                continue
            sides = []
            for walk in (range(i - 1, -1, -1), range(i + 1, len(self.blocks))):
                near = [first[j] for j in walk if self.blocks[j].article == b.article and isinstance(first[j], bool)]
                sides.append(near[0] if near else bool(b.article) and b.article in good_articles)
            after = [first[j] for j in range(i + 1, len(self.blocks)) if self.blocks[j].article == b.article and isinstance(first[j], bool)]
            out.append(all(sides) or (f == "near" and any(sides)) or (b.tag[:1] == "h" and b.tag[1:].isdigit() and after[:1] == [True]))
        return out


def test_second_way_of_the_rules():
    """On made pages of every kind of block, in and out of articles, with and without names."""
    import random

    r = random.Random(8)
    pieces = [LONG, PROSE, "Tiny one.", "xkqz " * 20, "xkqz " * 60, "© all of it", "<a href=x>link</a>", f"{PROSE[:40]} <a href=x>with a link in it</a> of it", "<a href=x>one</a> <a href=y>two</a>", "of the xkqz in it and qqq rrr sss ttt uuu vvv " * 3]
    for _ in range(400):
        page = ""
        for _ in range(r.randint(1, 12)):
            tag = r.choice(["p", "p", "p", "div", "section", "h2", "li", "td"])
            name = r.choice(["", "", "", " class=comments", " id=search", " class='ad-hoc'", " id=comments", " class='no-sidebar'", " hidden", " role=navigation", " class='cookie-notice x'"])
            page += r.choice(["", "", "", "<article>", "</article>", "<nav>", "</nav>", "<main>", "</main>"]) + f"<{tag}{name}>{r.choice(pieces)}</{tag}>"
        blocks = html.blocks_of(page)
        assert html.labels_of(blocks) == Second(blocks).labels(), page


def test_compound_names_give_way_where_all_prose_bears_them():
    assert main_text(f"<article><div class='article-header'><p>{LONG}</p></div></article>") == LONG
    assert main_text(f"<body><nav>a</nav><div class='widget-page'><p>{LONG}</p></div>") == LONG
    assert main_text(f"<body><nav>a</nav><div class='comments'><p>{LONG}</p></div>") == ""


class Plain(HTMLParser):
    """What stands in <article>, as a user of the standard library would take it: enough for the given pages."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "br"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_plain_second_way_agrees_on_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    got = extracted(pages).collect()
    assert len(got) == len(raw) == 250
    for r in got:
        plain = Plain()
        plain.feed(raw[r["page_id"]])
        plain.close()
        assert r["text"] == "\n\n".join(t for t in (re.sub(r"\s+", " ", b).strip() for b in plain.blocks) if t)


def test_table(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    data = [(1, "u", f"<article><p>{LONG}</p></article>", 5, "x"), (1, "u", None, 5, "x"), (None, None, "", 5, "x")]
    got = extracted(spark.createDataFrame(data, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", LONG, len(LONG)), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert extracted(spark.createDataFrame([], schema)).collect() == []


def test_very_long_page():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count("\n\n") == 2999
    assert main_text("<div>" * 3000 + LONG) == LONG
