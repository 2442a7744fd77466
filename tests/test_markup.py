"""Notes out of markup against the standard library's parser, in parts of any size."""

import random
from html.parser import HTMLParser

import pytest

from conftest import SF
from pagevault.operators.markup import Outline, Scanner, notes, scanned, unescaped

PAGE = """<!DOCTYPE html><html><head><title>Notes 3.1</title><style>li{a:b}</style><script>var t = "<li>x: 1 -> 2</li>";</script></head>
<body><!-- <li>not this</li> --><h1>Patch 3.1</h1><p>Intro &amp; more<br>second line<p>another
<h2 class="a>b">Heroes</h2><h3>Ärger</h3><ul><li>Health: 540 → 570<li>Mana: 300 -&gt; 280</li><li>Rage
<ul><li>inner <b>one</b></li></ul></li></ul><h2>Items</h2><table><tr><td>Sword: <i>10</i> ⇒ 12<td>plain</tr></table>
<div>a < b and c<d>e</div><dl><dt>Term<dd>Cost : free → 5 gold</dl></body></html>"""


def test_sections_items_and_changes():
    rows = [(r[0], r[1], r[2].rpartition("/")[2], *r[3:]) for r in Outline().rows(scanned(PAGE.encode()))]
    none = (None, None, None)
    assert rows == [
        ("text", "", "title", "Notes 3.1", *none), ("section", "Patch 3.1", "h1", "Patch 3.1", *none), ("text", "Patch 3.1", "p", "Intro & more", *none), ("text", "Patch 3.1", "p", "second line", *none), ("text", "Patch 3.1", "p", "another", *none),
        ("section", "Patch 3.1 > Heroes", "h2", "Heroes", *none), ("section", "Patch 3.1 > Heroes > Ärger", "h3", "Ärger", *none),
        ("change", "Patch 3.1 > Heroes > Ärger", "li", "Health: 540 → 570", "Health", "540", "570"), ("change", "Patch 3.1 > Heroes > Ärger", "li", "Mana: 300 -> 280", "Mana", "300", "280"),
        ("item", "Patch 3.1 > Heroes > Ärger", "li", "Rage", *none), ("item", "Patch 3.1 > Heroes > Ärger", "li", "inner one", *none),
        ("section", "Patch 3.1 > Items", "h2", "Items", *none), ("change", "Patch 3.1 > Items", "td", "Sword: 10 ⇒ 12", "Sword", "10", "12"), ("item", "Patch 3.1 > Items", "td", "plain", *none),
        ("text", "Patch 3.1 > Items", "d", "a < b and ce", *none), ("text", "Patch 3.1 > Items", "dt", "Term", *none), ("change", "Patch 3.1 > Items", "dd", "Cost : free → 5 gold", "Cost", "free", "5 gold"),
    ]


@pytest.mark.parametrize("part", [1, 2, 3, 7, 64])
def test_parts_of_any_size(part):
    whole = list(Outline().rows(scanned(PAGE.encode())))
    assert list(Outline().rows(scanned(PAGE.encode(), part))) == whole
    scanner = Scanner()
    for at in range(0, len(PAGE), 5):
        list(scanner.feed(PAGE[at : at + 5].encode()))
        assert len(scanner.rest) < 200  # only what is not whole yet


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.tokens = []

    def handle_starttag(self, tag, attrs):
        self.tokens.append(("start", tag))

    def handle_startendtag(self, tag, attrs):
        self.tokens.append(("start", tag))

    def handle_endtag(self, tag):
        self.tokens.append(("end", tag))

    def handle_data(self, data):
        if self.cdata_elem is None:
            self.tokens.append(("text", data))

    def handle_entityref(self, name):
        self.tokens.append(("text", f"&{name};"))

    def handle_charref(self, name):
        self.tokens.append(("text", f"&#{name};"))


def plain(text):
    parser = Plain()
    parser.feed(text)
    parser.close()
    return list(Outline().rows(parser.tokens))


def test_all_pages_equal_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {}
    for r in notes(pages.selectExpr("*", "1 as n", "2 as kind")).orderBy("page_id", "n").collect():
        got.setdefault(r.page_id, []).append(tuple(r)[2:])
    texts = {r.page_id: r.html for r in pages.collect()}
    assert got.keys() == texts.keys()
    for page_id, text in texts.items():
        assert got[page_id] == plain(text)


def test_mended_markup_equals_the_standard_parser():
    rng = random.Random(6)
    pieces = ["<p>", "</p>", "<ul>", "</ul>", "<li>", "</li>", "<b class='x>y'>", "</b>", "text ", "a: 1 → 2", "&lt;&#65;", "<br/>", "<h2>", "</h2>", "<!-- <li> -->", "<td>", "<table>", "</table>", " \n ", "<script>if (a<b) '</p>'</script>", "3 < 4 "]
    for _ in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        assert list(Outline().rows(scanned(text.encode(), rng.choice([1, 5, 1000])))) == plain(text), text


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (None, "<p>x"), (4, "no markup"), (4, "no markup"), (5, "<p>cut off <b"), (6, "<script>never ends"), (7, "<!-- never ends"), (8, "</p></li>x<"), (9, "<li>" * 3000 + "deep")]
    got = [tuple(r)[:6] for r in notes(spark.createDataFrame(rows, "page_id long, html string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0, "text", "", "p", "x"), (4, 0, "text", "", "", "no markup"), (4, 0, "text", "", "", "no markup"), (5, 0, "text", "", "p", "cut off"), (8, 0, "text", "", "", "x<"), (9, 0, "item", "", "li", "deep")], key=repr)
    assert notes(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_outline_reads_what_escapes_markup(spark, duck, tmp_path):
    """References that a cut has left open, others than the three, and blanks that are no ASCII ones: as in the SQL."""
    from pagevault.plans import registry

    item = '<li><a href="/x">{}</a></li>'
    page = "<html><body><h1>{}</h1><ul>" + item.format("Tom &amp;amp; J&lt;b&gt; &eacute;") + item.format("x\u00a0 y \t z") + "</ul></body></html>"
    pages = [(1, page.format("a &quot;b&quot;  c &amp")), (2, page.format("&lt;i&gt; &#39;d"))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.QUERIES["page_outline"](spark, str(tmp_path)).orderBy("page_id").collect()
    duck.sql(f"create schema cut; create table cut.pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(registry.ORACLES["page_outline"].replace("from pages", "from cut.pages") + " order by page_id").fetchall()
    assert [(r.page_id, r.heading, r.n_items, r["items"]) for r in got] == want
    assert [r.heading for r in got] == ["a &quot;b&quot; c &amp", "<i> &#39;d"]
    assert [r.text for r in notes(spark.createDataFrame(pages, "page_id long, html string")).where("kind = 'section'").orderBy("page_id").collect()] == ['a "b" c &', "<i> 'd"]
    assert unescaped(" &amp;lt; ") == "&lt;"
