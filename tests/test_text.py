import html as html_lib
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from evigraph.functions import text as tx
from evigraph.functions import vectors as vx
from evigraph.sources.pages import html_to_text


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()[0]


@pytest.mark.parametrize("value", [
    "  plain \t", "\u00a0\u2003tail\u3000", "\x1c\x1funits\x1d", "a b", "", " \n ", "\u200bkept\u200b",
    "\u0085next\u0085", "caf\u00e9 ", "\U0001f600 x \u2028"])
def test_strip_equals_python(spark, value):
    assert one(spark, value, tx.strip) == value.strip()


def test_tokens_and_normal_form(spark):
    text = "What is the RMSD of chain-A, and the x_1 value? A b"
    assert one(spark, text, tx.normalize) == "what is the rmsd of chain a and the x 1 value a b"
    assert sorted(one(spark, text, tx.important_tokens)) == ["chain-a", "rmsd", "value", "x_1"]


def test_names_and_paths(spark):
    assert one(spark, "a\\b/report.v2.md", tx.source_stem) == "a_b_report.v2"
    assert one(spark, "noext", tx.source_stem) == "noext"
    assert one(spark, "C:\\out\\run 1\\f.PDB", tx.file_name) == "f.PDB"
    assert one(spark, "/data/x/", tx.file_name) == "x"
    assert one(spark, "/d.ir/.hidden", tx.extension) == ""
    assert one(spark, "/d/x.tar.GZ", tx.extension) == ".gz"
    assert one(spark, " Remote-Command x ", tx.name_key) == "remote_command_x"
    assert one(spark, ["B a", "b-A", "c"], tx.normalize_list, "array<string>") == ["b_a", "c"]


@pytest.mark.parametrize("pattern,start", [
    (r"\bworkflow\b", "workflow"), (r"\bsteps?\b", "step"), (r"\bend[- ]to[- ]end\b", "end"),
    (r"\bprove(?:s|d)? that\b", "prove"), (r"\bwhat (?:is|are)\b", "what "), (r"\ba\b|\bb\b", ""),
    (r"(?i)secret", ""), (r"[ab]c", ""), (r"x*y", "")])
def test_leading_literal_is_a_safe_prefilter(pattern, start):
    assert tx.leading_literal(pattern) == start


class Reader(HTMLParser):
    """Text nodes the way the standard parser sees them."""

    def __init__(self):
        super().__init__()
        self.skip = self.main = 0
        self.seen, self.all, self.inside = False, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "svg", "noscript")
        self.main += tag == "main"
        self.seen |= tag == "main"

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "svg", "noscript") and self.skip > 0
        self.main -= tag == "main" and self.main > 0

    def handle_data(self, data):
        line = " ".join(data.split())
        if line and not self.skip:
            self.all.append(line)
            if self.main:
                self.inside.append(line)


def expected(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(reader.inside if reader.seen and reader.inside else reader.all)


PAGES = [
    "<title>T</title><script>if (a<b) x='</p>'</script><main><h1> A  &amp; B</h1><p>c<br>d</p></main>z",
    "<body>only <b>body</b> text<!-- <main>no</main> --> end</body>",
    "<main> </main><p>fallback</p>", "<p>&#8364; &#x80; &eacute; &copy &notit; &unknown;</p>",
    "<noscript>gone</noscript>kept<style>p{}</style><svg><text>gone</text></svg>",
    "a < b and <3", "<main>one</main>x<main>two</main>",
]


@pytest.mark.parametrize("page", PAGES)
def test_html_text(spark, page):
    got = html_to_text(spark.createDataFrame([(page,)], "html string"), 5).first()
    assert got["text"] == expected(page).strip()
    assert got["sufficient"] == (len(got["text"]) >= 5)


@pytest.mark.parametrize("value", ["&lt;&gt;&amp;amp;", "&#0;&#xD800;&#1114112;", "x&#0000000065;y&#x00000000041;", "&#99999999999999999999;&#xfffffffffffffffffff;z", "&AMP &hellip;x"])
def test_unescape(spark, value):
    assert one(spark, value, tx.unescape_html) == html_lib.unescape(value)


def test_all_pages_equal_the_standard_parser(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for row in html_to_text(pages).select("html", "text").collect():
        assert row["text"] == expected(row["html"]).strip()


def test_json_default_and_vectors(spark):
    df = spark.createDataFrame([("{\"a\": 1}",), ("",), ("oops",), (None,)], "v string")
    fallback = F.struct(F.lit(7).alias("a"))
    got = [r[0] for r in df.select(
        F.coalesce(tx.json_or_default(F.col("v"), "a int", fallback)["a"], F.lit(7))).collect()]
    assert got == [1, 7, 7, 7]
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    row = v.select(vx.norm("a"), vx.l2_squared("a", "b"), vx.cosine_similarity("a", "b")).first()
    assert row[0] == 5.0 and row[1] == 2.0 and abs(row[2] - 0.96) < 1e-12
