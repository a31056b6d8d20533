"""Reading pages: against the standard library's parser on well-formed pages, by hand on others, and in linear time."""

import html.parser
import random
import time

import pytest

from meshwright.llm import warc


class Plain(html.parser.HTMLParser):
    """The same account of a page from the standard library's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.unseen, self.title, self.inside, self.lang, self.links, self.code = [], "", [], False, None, [], False

    def handle_starttag(self, name, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if name == "a" and "href" in own:
            self.links.append(own["href"])
        if name == "html":
            self.lang = own.get("lang")
        self.inside |= name == "title"
        self.code = name in warc.CODE
        if name in warc.UNSEEN and not self.unseen:
            self.unseen = name
        self.broken(name)

    def handle_endtag(self, name):
        self.inside &= name != "title"
        self.code = False
        if name == self.unseen:
            self.unseen = ""
        self.broken(name)

    def broken(self, name):
        if name in warc.BLOCKS and not self.unseen:
            self.text.append("\n")

    def handle_data(self, data):
        if self.inside:
            self.title.append(data)
        elif not self.unseen and not self.code:
            self.text.append(data)


def test_generated_pages():
    rng = random.Random(12)
    words = ["x", "é", "a &amp; b", "1 &lt; 2", "&#233;", "&copy;", "tail", "日本"]

    def body(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(9 if depth else 3)
            if kind < 3:
                out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))))
            elif kind == 3:
                out.append(f"<!-- {rng.choice(words)} <p> -->")
            elif kind == 4:
                out.append(f"<script type='t'>if (a < b) x = \"<p>{rng.choice(words)}\"</script>")
            elif kind == 5:
                out.append(f'<a class=k href="/q?a=1&amp;b={rng.randrange(9)}">{body(depth - 1)}</a>')
            elif kind == 6:
                out.append(f'<img alt="a > b" src=\'i.png\'><br/>{body(depth - 1)}')
            else:
                name = rng.choice(["p", "DIV", "b", "li", "span", "noscript", "template", "h2", "style2"])
                out.append(f"<{name} id='n{rng.randrange(9)}' hidden>{body(depth - 1)}</{name}>")
        return " ".join(out)

    for _ in range(400):
        page = f'<!DOCTYPE html>\n<html lang="{rng.choice(["fr", "de"])}"><head><title>{rng.choice(words)}</title><style>p > a {{}}</style></head><body>{body(4)}</body></html>'
        want = Plain()
        want.feed(page)
        want.close()
        lines = (" ".join(x.split()) for x in "".join(want.text).split("\n"))
        assert warc.read_page(page) == ("\n".join(x for x in lines if x), " ".join("".join(want.title).split()), want.lang, want.links)


@pytest.mark.parametrize("page,text", [("<script>var x=1; <p>tail", ""), ('<img alt="a > b">t', "t"), ("a<!-- b", "a"), ("1 < 2 <3", "1 < 2 <3"), ("x<p it's>y", "x\ny"), ("x<a href='q", "x"), ("</>z<?p q>w", "zw"), ("<SCRIPT>a</Script >b", "b"), ("", "")])
def test_broken_pages(page, text):
    assert warc.read_page(page)[0] == text


@pytest.mark.parametrize("part", ["<script>", "<title>", "<", "<!--", "<a ", "<a href=", '<a x="', "<a x='\"", "<p it's", "</", "&", "<noscript>", "<html lang=", "<a =\""])
def test_hostile_pages_take_linear_time(part):
    page = part * (400_000 // len(part))
    began = time.perf_counter()
    warc.read_page(page)
    assert time.perf_counter() - began < 4


def test_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x")] * 3 + [(None, "http://a/", "<p>x")], "page_id long, url string, html string")
    out = warc.warc_derivatives(pages).collect()
    assert len(out) == 8 and len({r["record_sha256"] for r in out if r["page_id"] == 1}) == 2
