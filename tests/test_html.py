import random

from quarry.functions import html
from quarry.functions.html import parse

PAGE = """<!doctype html><div class="a b"><p>one<p>two <b>bold</b> three</p><ul><li>x<li class=y>z</ul>
<a href='/team/12/n'>T</a><a>none</a><br><img src=q title="De"></div><div class="b"><span class="ct">8</span> tail</div>
<table><tr><td class="st-k">1<td>2<tr><td class="st-k">3</table><script>var p="<p class=a>";</script>"""


def test_selectors():
    root = parse(PAGE)
    assert [x.text() for x in root.select("p")] == ["one", "two bold three"]
    assert [x.text() for x in root.select("li")] == ["x", "z"]
    assert len(root.select(".a.b")) == 1 and len(root.select("div.b")) == 2
    assert [x.get("href") for x in root.select("a[href*='/team/']")] == ["/team/12/n"]
    assert len(root.select("a[href]")) == 1
    assert [x.text() for x in root.select("td.st-k")] == ["1", "3"] and len(root.select("tr")) == 2
    assert [x.text() for x in root.select(".a > a")] == ["T", "none"] and root.select("ul > a") == []
    assert root.first("img").get("title") == "De" and root.first(".nope") is None
    assert root.select("div")[1].own_texts() == ["tail"]
    assert [x.text() for x in root.select(".b span")] == ["8"]
    assert root.first("p").text("") == "one" and root.select("p")[1].text("") == "twoboldthree"
    assert len(root.first("ul").select("div li")) == 2  # ancestors above count


def test_odd_input():
    assert parse(None).text() == "" and parse("").select("p") == []
    assert parse("</div><p>a</b>&amp; b").text() == "a & b"
    assert parse("<div>" * 3000 + "x").text() == "x"


BITS = """<div> </div> <p> </p> <a|href='/team/1/x'> <a|href="/x?a=1&amp;b=2"> </a> <td> <tr> <table> </table> <li> <ul> <br> <br/> <img|src=a/b> <p|class="a|b"> text | &amp; &lt &nosuch; < > </|x> </> <!--|c|--> <!--|<p>|--> <!doctype|html> <!x> <?x?>
<script> </script> <script>var|a='</p>';</script> <style>p{}</style> <title>x|&amp;|y</title> <title>a<b>c</title> <DIV|CLASS=A> </DIV> <a|b=c/> <a|b|=|c> <a|'x'> <a|x="y> " <span/> <option> </script|> <script/> <p|a|a=1|a=2> <div|class=>""".split()


def test_plain_pages_are_read_as_html_parser_reads_them():
    """The quick way gives the same tree, or leaves a page to the other."""
    rng, quick = random.Random(4), 0
    for _ in range(4000):
        page = "".join(rng.choice(BITS).replace("|", " ") for _ in range(rng.randrange(1, 9)))
        got, want = html._read(page), html._built(page)
        if got is not None:
            quick += 1
            tree = lambda t: ([(x.tag, x.attrs) for x in t.tags], t.parents, t.ends, t.first_text, t.last_text, t.texts, t.owners, t.hidden, t.keyed)
            assert tree(got) == tree(want), page
    assert quick > 800
    assert html._read(PAGE) is not None and html._read("<p>a < b</p>") is None
