from html.parser import HTMLParser

import pytest

from lattice.llm import html_extract as m

CASES = {
    "article": ("<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>menu</a></nav><article><h1>Head</h1><p>One&amp;  two\n three<p>Four</p></article><footer>foot</footer>", "Head\nOne& two three\nFour"),
    "unclosed": ("<article><p><b>One.<br><p>Two</p>", "One.\nTwo"),
    "advert inside": ("<article><p>One</p><div class='ad box'><p>Buy</p></div><p>Two</p></article><div>tail</div>", "One\nTwo"),
    "comments": ("<main><p>Text</p></main><section id=comments><p>First!</p></section>", "Text"),
    "forms": ("<article><p>A</p><form><p>mail</p><input name=x><button>go</button></form><aside>side</aside><p>B</p></article>", "A\nB"),
    "no article": ("<body><div class=menu><a href=1>x</a></div><div><p>The text is here, and it is long enough.</p><p>Short.</p></div><div id='footer'>c</div></body>", "The text is here, and it is long enough.\nShort."),
    "links only": ("<ul><li><a href=1>a</a><li><a href=2>b</a></ul>", ""),
    "plain": ("just text &lt;b&gt;", "just text <b>"),
    "comment markup": ("<article><!-- <p>no</p> --><p>yes</p></article>", "yes"),
    "hidden": ("<article><p hidden>no</p><p>yes</p><p style='x' aria-hidden=true>no</p></article>", "yes"),
    "odd quote": ('<article><p>one</p><a href=x">two</a><p>three</p></article>', "one\ntwo\nthree"),
    "class words": ('<article><p class="share-price">12.5</p><section class="related-work"><p>Before us</p></section></article>', "12.5\nBefore us"),
    "class of the page": ('<body><div class="page header-fixed"><p>All of the text.</p></div></body>', "All of the text."),
    "compound names": ('<article><p>A</p><div class="ad-slot">no</div><div id="cookie-notice">no</div><p>B</p></article><div class="comment-list"><p>First, and it is a very long comment.</p></div>', "A\nB"),
    "unclosed advert": ('<article><p class="ad">buy<div>keep</div><p>x</p></article>', "keep\nx"),
    "formula": ("<article><p>let <math><mi>x</mi></math> be</p></article>", "let x be"),
    "header of an article": ("<header>site</header><article><header><h1>Head</h1></header><p>Text</p><footer>by</footer></article>", "Head\nText"),
    "two parts": ("<body><div><div><div><p>The first part of the text is here.</p></div></div></div><ul><li><a href=1>a link</a></ul><div><div><p>The second part of it.</p></div></div><div><div><div><div><p>tiny</p></div></div></div></div></body>", "The first part of the text is here.\nThe second part of it."),
    "outside of an article": ("<div>Some box</div><article><p>" + "text " * 20 + "</p></article><div>More <b>boxes</b></div>", ("text " * 20).strip()),
    "null": (None, ""),
    "empty": ("", ""),
    "broken": ("<article><p>a <b c='", "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, text = CASES[name]
    assert m.main_text(page) == text


def test_surge_and_dive():
    assert m.stretches([0, 0, 5, 0, 5, 0, 0, 0, 0, 9]) == [(2, 5), (9, 10)]
    assert m.stretches([100, 0, 5, 0, 0, 0, 0, 9, 0, 0, 0, 0, 25]) == [(0, 3), (12, 13)]
    assert m.stretches([]) == [] and m.stretches([0, 0]) == []


def test_rows(spark):
    rows = [(1, "u", CASES["article"][0], "t", 5), (1, "u", CASES["article"][0], "t", 5), (2, None, None, "t", 5), (3, "v", "<p>" + "word " * 200_000 + "</p>", "t", 5)]
    got = m.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).orderBy("page_id").collect()
    assert [r["n_chars"] for r in got] == [len(CASES["article"][1])] * 2 + [0, 5 * 200_000 - 1]
    assert m.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table(spark, sf):
    """What stands between the tags of the article, by another parser; the thresholds decide on every page."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        text = m.main_text(r["html"])
        assert text == by_parser(r["html"])
        assert len(m.main_text(r["html"], share=None)) > len(text)


def by_parser(page):
    class Parser(HTMLParser):
        inside, blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in m.BLOCK:
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in m.BLOCK:
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    parser = Parser(convert_charrefs=True)
    parser.blocks = [""]
    parser.feed(page)
    return "\n".join(x for x in (" ".join(b.split()) for b in parser.blocks) if x)


@pytest.mark.parametrize("block", ["<div class=ad><p>Buy</p></div>", "<div class='notice'>Read</div>", "<aside><p>side</p></aside>", "<form><p>mail</p></form>"])
def test_inline_blocks_part_no_text_without_article(block):
    assert m.main_text(f"<body><nav><a href=/>x</a> menu</nav><div><p>first half</p>{block}<p>second half, longer</p></div><div class=comments><p>First!</p></div>") == "first half\nsecond half, longer"
