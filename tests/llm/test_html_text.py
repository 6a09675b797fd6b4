import random
import re
import time
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from centwise.llm import html_text
from centwise.llm.html_text import extract, extract_text


def test_blocks_lists_and_breaks():
    got = extract_text("""<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
      <h1>Head  <b>line</b></h1>Intro<p>One<p>Two<br>lines &amp; more<ul><li>a<li>b <ol start=3><li>c<li>d<p>e</ol></ul>
      <blockquote>said</blockquote><dl><dt>T<dd>D</dl><hr>end<script>var t="</p>";</script><!-- <p>gone -->""")
    assert got == "\n".join(["Head line", "", "Intro", "", "One", "", "Two", "lines & more", "", "- a", "- b", "  3. c", "  4. d", "",
                             "     e", "", "  said", "", "T", "  D", "", "----", "", "end"])


def test_tables_align():
    got = extract_text("<table><caption>Cap</caption><tr><th>Name<th>Qty<th>Note<tr><td>apple<td>3<td>x<tr><td colspan=2>wide cell<td>y"
                       "<tr><td rowspan=2>r<td>1<td>p<tr><td>2<td>q</table>after")
    assert got.split("\n") == ["Cap", "Name   Qty  Note", "apple  3    x", "wide cell   y", "r      1    p", "       2    q", "", "after"]
    long = " ".join(["word"] * 60)
    lines = extract_text(f"<table><tr><td>{long}<td>right<tr><td>s<td>t</table>").split("\n")
    assert lines[0].endswith("  right") and max(map(len, lines)) < 100
    assert sum(x.count("word") for x in lines) == 60


def test_visibility():
    assert extract_text('<p hidden>a</p><p style="color:red; display : none">b</p><div style="visibility:hidden">c</div><input type=hidden value=d>'
                        "<template>e</template><noscript>f</noscript><details><summary>S</summary>closed</details><details open><summary>T</summary>shown"
                        "</details><textarea> x\n y</textarea>") == "S\nT\nshown\n x\n y"
    assert extract_text("<pre>\n a\n\n  b </pre>") == " a\n\n  b"


def test_odd_markup():
    assert extract_text(None) == extract_text("") == extract_text("<!-- open") == ""
    assert extract_text("a < b <3 &lt;i&gt; &copy; &am") == "a < b <3 <i> © &am"
    assert extract_text("<td>cell<tr>row</b></i> x</p>y") == "cellrow x\n\ny"
    assert extract_text("<div>" * 20_000 + "deep") == "deep"
    assert extract_text("<p>cut <a href='x") == "cut"


def test_stray_quotes_and_short_comments():
    assert extract_text("a<!-->b<!--->c<!-- no -->d<!---->e<!-- no --!>f") == "abcdef"
    assert extract_text('<p title="unclosed>shown</p>') == "shown"
    for page, want in (("""<a href="x"">first link</a> middle text <a href="y">second</a>""", "first link middle text second"),
                       ("<p title=it's>visible one</p><p>we don't</p>", "visible one\n\nwe don't"),
                       ("""<p title=x"hidden>shown</p>""", "shown"), ("<p title=a\xa0hidden>shown</p>", "shown"),
                       ("""<a b=c="d>e</a> <i>"f"</i>""", 'e "f"'), ("""<a title = 'a > b'>g</a><b "'>h</b>""", "gh"),
                       ("""<a ="x>y</a>"z'""", "y\"z'")):
        plain = Words()
        plain.feed(page)
        plain.close()
        assert extract_text(page) == want
        assert re.sub(r"\s", "", want) == re.sub(r"\s", "", "".join(plain.out))


def test_formulas_and_drawings():
    assert extract_text("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation encoding=tex>\\\\x</annotation></semantics></math> holds") == "so x=1 holds"
    svg = ("<svg><title>T</title><defs/><defs><text>no</text></defs><style>s{}</style><g><path d='M0'/><text x=1>left <tspan>axis</tspan></text>"
           "<text>top</text> stray </g><text visibility=x style='display:none'>gone</text><foreignObject><p>rich</p></foreignObject></svg>")
    assert extract_text(f"a{svg}b") == "a left axis top\n\nrich\n\nb"
    assert extract_text("<svg/>one<svg><path d=x><div>two</div><svg><section>no</svg> three") == "one\ntwo\nthree"


class Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_no_word_lost_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("rendered", F.lit("clash"))
    rows = extract(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.html is None:
            assert r.rendered == ""
            continue
        if "</body>" not in r.html:
            continue                                       # the plain parser drops a cut last tag differently
        plain = Words()
        plain.feed(r.html)
        plain.close()
        want = re.sub(r"\s+", "", "".join(plain.out))
        assert re.sub(r"\s+|^- |(?<=\n)- ", "", re.sub(r"(?m)^\s*- ", "", r.rendered)) == re.sub(r"^-|", "", want)
    assert extract(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "</div>", "<div>",
                                 "<pre>", "</pre>", "<br>", "W ", "x", "&amp;", "<", "<!--", "-->", "<td colspan=3 rowspan=2>", "</body>", "<head>",
                                 "<details>", "<select><option>"]), max_size=40))
def test_never_fails(parts):
    extract_text("".join(parts))


class Scanning(html_text.Builder):
    """The same rules, looking through the open elements one by one."""

    def _up_to(self, tags, bounds):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in bounds:
                return None
        return None


def test_tree_equals_one_built_by_scanning(monkeypatch):
    rnd = random.Random(8)
    names = "p b i div ul li table tr td th tbody caption dl dt dd svg text math select option h1 h2 button template span a object".split()
    flat = lambda n: n if isinstance(n, str) else (n.tag, [flat(k) for k in n.kids])
    for _ in range(400):
        page = "".join(f"<{rnd.choice(['', '', '/'])}{rnd.choice(names)}>{rnd.choice(['', 'x', ' y'])}" for _ in range(rnd.randrange(60)))
        fast = flat(html_text.parse(page))
        with monkeypatch.context() as m:
            m.setattr(html_text, "Builder", Scanning)
            assert flat(html_text.parse(page)) == fast


def test_hostile_pages_take_linear_time():
    pages = {"unmatched": "<b>" * 50_000 + "x" + "</i>" * 50_000, "barred": "<i><div>" + "<b>" * 50_000 + "x" + "</i>" * 50_000,
             "lists": "<ul><li>a" * 20_000, "quotes": "<blockquote>q" * 20_000}
    for name, page in pages.items():
        began = time.process_time()
        text = extract_text(page)
        assert time.process_time() - began < 20, name
        # a line has the indent of the boxes around it, DEEPEST of them at most
        assert len(text) <= page.count("<") * (2 * html_text.DEEPEST + 4) and text.count("a") == page.count("a")
    assert extract_text("<ul><li>a" * 60).split("\n")[-1] == " " * 2 * html_text.DEEPEST + "a" and extract_text("<ul><li>a" * 3).split("\n")[-1].endswith("- a")
