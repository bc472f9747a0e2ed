import hashlib
import random
import re

import numpy as np
import pytest

from evigraph.llm import boosting, pii, repeats, site_style, text_queries
from evigraph.llm.anchors import gram_hashes, ranges
from evigraph.llm import suffixes
from evigraph.llm.suffixes import permuted_lcp, suffix_array

from llm_cases import by_id, docs, empty, odd

BASE = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                    14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def check_spans(got, ids, texts):
    for doc_id, text in zip(ids, texts):
        row, spans = got[doc_id], plain_spans(text)
        named = [f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans]
        assert row["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x == j for _, x, _ in spans) for j in range(4)]
        assert set(named) <= set(row["spans"].split(",")) or not named


def test_pii_query(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    check_spans(by_id(text_queries.op5_pii_boosted_spans(spark, data)), table["doc_id"], table["text"])


def test_pii_odd_texts(spark):
    rng = random.Random(3)
    texts = ["", None, "a@b.c_d@e.f.g", "x@y", "a@b.c@d.e", "é漢🙂 a.b@c.de 🙂 1.2.3.4.5.6.7.8", "1.2.3.999",
             "001.2.3.4 300.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (964) 555-6360+2 (11) 1234567890",
             "5" * 9000, "1 " * 9000, "a" * 9000, "+" * 500 + "1", "+1" + "(" * 9000, ".".join(["1"] * 999), "a@" * 999,
             " ".join(["x@y.zz"] * 200)]
    texts += ["".join(rng.choice("0123456789 .-+()@ab_%é🙂\n") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    check_spans(by_id(pii.report(docs(spark, texts))), range(len(texts)), texts)


DISGUISED = {
    "mail bob0 [at] host [dot] com today": "email:5:29", "write ann(at)mail.example(dot)org now": "email:6:33",
    "host 10[.]0[.]0[.]255 is up": "ip:5:21", "card 4111.1111.1111.1111 was used": "card:5:24",
    "call (964) 555-63601 now": "phone:5:20"}
CLEAN = ["host 10[.]0[.]0[.]999 is down", "card 4111.1111.1111.1112 is none", "look (at) this and go", "in 1999-2000 12-13 of 100-200-300"]


@pytest.mark.parametrize("plain", [10, 1000])
def test_pii_finds_disguised_forms_in_any_mix(spark, plain):
    """The same texts give the same spans beside few and beside many base spans."""
    texts = [*DISGUISED, *CLEAN, *[f"mail a{k}@b{k}.example.com or +1 ({200 + k % 700}) 555-1234 at 10.0.{k % 256}.7 "
              f"and 10.0.0.{990 if k % 2 else 9}, card 4111 1111 1111 111{1 + k % 2}" for k in range(plain)]]
    got = by_id(pii.report(docs(spark, texts)))
    assert [got[k]["spans"] for k in range(len(DISGUISED))] == list(DISGUISED.values())
    assert all(got[len(DISGUISED) + k]["spans"] == "" for k in range(len(CLEAN)))
    assert all(sum(got[k][f"n_{kind}"] for kind in pii.KINDS) == 0 for k in range(len(DISGUISED) + len(CLEAN)))


def test_pii_trees_do_not_know_the_generator():
    assert "g" not in pii.FEATURES


def test_redaction(spark):
    table = odd(spark)
    out = pii.redact(table)
    assert out.columns == table.columns and out.count() == 11
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[9] == "mail [EMAIL], host [IP], card [CARD], call [PHONE]"
    assert texts[3] is None and texts[4] == ""
    assert pii.redact(empty(spark)).count() == 0 and pii.report(empty(spark)).count() == 0
    assert pii.report(odd(spark)).count() == 11


def test_boosting_learns_an_interaction():
    x = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(3)])
    n = np.full(len(x), 100.0)
    positive = np.where((x[:, 0] > 1) & (x[:, 1] < 2), 97.0, 2.0)
    model = boosting.fit(x, positive, n)
    p = 1 / (1 + np.exp(-model.logits(x)))
    assert np.abs(p - positive / n).max() < 0.1
    cut = boosting.threshold(p, positive, n, 0.95)
    assert ((p >= cut) == (positive > 50)).all()
    assert boosting.threshold(p, np.zeros(len(x)), n, 0.95) == 2.0


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}<style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


CASES = [
    ("<nav><a>menu</a></nav><article><h1>T &amp; x</h1><p>a<br>b\n  c<p>d <b>e</b>f</p></article><footer>f</footer>", "T & x\na b c\nd ef"),
    ("<header>h</header><main><p>one</p><aside>no</aside><form><input>no</form><ul><li>x<li>y</ul></main>", "one\nx\ny"),
    ("<article><header><h1>T</h1></header><p>z</p><div class='comments'><p>c</p></div></article>"
     "<article class=comment>c</article>", "T\nz"),
    ("<div id=sidebar>s</div><div class='cookie-notice'>n</div><div><p>only <i>this</i></p></div>", "only this"),
    ("<article><p>&#233;&nbsp;&lt; &am &quo</article>", "é < &am &quo"), ("", ""), ("<!-- open", ""),
    ("<p title='a > b'>q</p><script>x", "q"), ("<article><p>a</p></article><div class=ad>x</div><article>b</article>", "a\nb")]


@pytest.mark.parametrize("body, want", CASES)
def test_page_text(body, want):
    assert site_style.Page(page(body)).main_text() == want


def test_site_style_query(spark, data):
    """Against the article cut out with patterns; all pages of the table have one."""
    import html
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r["page_id"]: r for r in text_queries.op7_html_site_style(spark, data).collect()}
    for r in pages:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inner)]
        row = got[r["page_id"]]
        assert row["text"] == "\n".join(b for b in blocks if b)
        assert row["n_chars"] == len(row["text"]) and row["url"] == r["url"]


def test_template_of_a_site_goes(spark):
    rows = [(k, f"http://a.example/{k}", page(
        f"<div class=top>Same words here</div><div class=text><p>Own words {k} and {k * k}</p></div>"
        f"<div class=end>Always the same</div>")) for k in range(12)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://b.example/", page("<div class=top>Same words here</div>"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(frame).collect()}
    assert all(got[k] == f"Own words {k} and {k * k}" for k in range(12))
    assert got[90] == got[91] == "" and got[92] == "Same words here"
    none = spark.createDataFrame([], "page_id long, url string, html string, site long, low string")
    assert site_style.extract(none).count() == 0


def test_copied_pages_keep_their_text(spark):
    rows = [(k, "http://c.example/", page("<div><div class=x>All of it</div></div>")) for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in site_style.extract(frame).collect()} == {"All of it"}


def test_mirrored_host_keeps_wrapped_paragraphs(spark):
    """Copies of one page, of two pages, and of one page with a number of its own in the footer."""
    def article(k, foot=""):
        return page(f"<article><h1>Title {k}</h1><div class=body><p>First {k}</p><ul><li><p>Second</p></li></ul>"
                    f"<div>Bare {k}</div></div></article><footer>{foot}</footer>")
    rows = [(k, "http://one.example/", article(0)) for k in range(20)]
    rows += [(100 + k, "http://two.example/", article(k % 2)) for k in range(20)]
    rows += [(200 + k, "http://foot.example/", article(0, k)) for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in site_style.extract(frame).collect()}
    for k in range(20):
        assert got[k] == "Title 0\nFirst 0\nSecond\nBare 0"
        assert got[100 + k] == f"Title {k % 2}\nFirst {k % 2}\nSecond\nBare {k % 2}"
        assert got[200 + k] == "Title 0\nFirst 0\nSecond\nBare 0"


def test_nearly_mirrored_articles_lose_no_block(spark):
    """Articles that differ by one number, with bare blocks, items and cells that all repeat."""
    rows = [(k, "http://d.example/", page(
        f"<div class=q1>Top words</div><article><h1>T</h1><p>Number {k}</p><div class=q2>Bare</div>"
        f"<ul><li>item</ul><table><tr><td>cell</table></article>")) for k in range(20)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in site_style.extract(frame).collect()}
    assert got == {k: f"T\nNumber {k}\nBare\nitem\ncell" for k in range(20)}


@pytest.mark.parametrize("pages, template_goes", [(1, False), (2, False), (4, True), (20, True)])
def test_hosts_of_few_pages_with_neutral_names(spark, pages, template_goes):
    """What four pages share is template; of one or two pages too little is known, and all stays."""
    rows = [(k, "http://e.example/", page(
        f"<div class=q1>Welcome to our site</div><div class=q2>Products Prices About</div>"
        f"<div class=q3><p>Own {k}</p><p>More {k * k}</p></div><div class=q4>All rights reserved</div>"))
        for k in range(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(frame).collect()}
    own = {k: f"Own {k}\nMore {k * k}" for k in range(pages)}
    if not template_goes:
        own = {k: f"Welcome to our site\nProducts Prices About\n{t}\nAll rights reserved" for k, t in own.items()}
    assert got == own


def test_suffix_arrays_and_prefixes():
    rng = np.random.default_rng(1)
    for turn in range(300):
        x = rng.integers(1, rng.integers(2, 6), size=rng.integers(0, 50))
        x = np.append(np.tile(x, 3) if turn % 3 == 0 else x, 0)
        text = bytes(x.astype(np.uint8))
        sa = suffix_array(x, int(x.max()) + 1)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        common, before = permuted_lcp(x, sa)
        for i, j in zip(sa[1:], sa[:-1]):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            assert common[i] == n and before[i] == j


@pytest.mark.parametrize("long_buckets", [0, 64, 1 << 40])
def test_both_forms_of_the_sweep_sort_alike(monkeypatch, long_buckets):
    monkeypatch.setattr(suffixes, "LONG_BUCKETS", long_buckets)
    rng = np.random.default_rng(4)
    for turn in range(200):
        x = rng.integers(1, rng.integers(2, 9), size=rng.integers(0, 80))
        x = np.append(np.repeat(x, 30)[:90] if turn % 5 == 0 else x, 0)
        rest = [x[i:].tolist() for i in range(len(x))]
        assert suffix_array(x, 9).tolist() == sorted(range(len(x)), key=rest.__getitem__)


def test_a_shard_of_text_is_sorted_by_recursion_on_large_alphabets(monkeypatch):
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, size=rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    lines = [b" ".join(words[min(2999, int(k))] for k in rng.zipf(1.3, size=40)) for _ in range(300)]
    text = b"\n".join(lines + lines[:40] + [b"a" * 2000])
    seen, whole = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda x, letters: seen.append(letters) or whole(x, letters))
    sa = suffixes.suffix_array(np.append(np.frombuffer(text, dtype=np.uint8), 0), 256)
    assert max(seen) > 4096 and len(seen) > 2               # names are sorted by the same method, level by level
    assert sorted(sa.tolist()) == list(range(len(text) + 1))
    assert all(text[i:i + 200] < text[j:j + 200] or text[i:] < text[j:] for i, j in zip(sa[:-1].tolist(), sa[1:].tolist()))


def test_every_window_has_its_leftmost_smallest_anchor():
    rng = np.random.default_rng(2)
    for turn in range(60):
        data = rng.integers(97, 97 + rng.integers(1, 5), size=rng.integers(60, 300)).astype(np.uint8)
        data = np.tile(data[:7], 30) if turn % 4 == 0 else data
        first, last, at, _ = ranges(data, 50, 20)
        h = gram_hashes(data, 20)
        for s in range(len(data) - 49):
            k = np.searchsorted(first, s, side="right") - 1
            assert last[k] >= s and at[k] == s + int(np.argmin(h[s:s + 31]))


def plain_removal(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for s in range(len(raw) - length + 1):
            seen[raw[s:s + length]] = seen.get(raw[s:s + length], 0) + 1
    out = []
    for raw in raws:
        covered = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            if seen[raw[s:s + length]] > 1:
                covered[s:s + length] = [True] * length
        runs = sum(c and not b for b, c in zip([False, *covered], covered))
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out.append((len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest(), any(covered)))
    return out


@pytest.mark.parametrize("forms_per_shard", [2, 512])
def test_repeats_against_brute_force(spark, forms_per_shard):
    rng = random.Random(5)
    words = [f"w{k}é" if k % 50 == 0 else f"w{k}" for k in range(900)]

    def some(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage, base = some(20), some(60)
    texts = [some(rng.randint(0, 30)) + " " + passage + " " + some(rng.randint(0, 30)) for _ in range(25)]
    for _ in range(12):
        changed = base.split()
        changed[rng.randrange(60)] = rng.choice(words)
        texts.append(" ".join(changed))
    texts += [base, base, "a" * 300, "ab" * 200, "x" * 79, "", None, passage + some(3) + passage, some(80), some(200)]
    want = plain_removal(texts, 80)
    got = by_id(repeats.report(docs(spark, texts), length=80, gram=24, forms_per_shard=forms_per_shard))
    assert [tuple(got[k])[1:] for k in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


def test_repeats_query_against_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").limit(120).toPandas()
    frame = spark.createDataFrame(table)
    got = by_id(repeats.report(frame))
    assert [tuple(got[k])[1:] for k in table["doc_id"]] == plain_removal(table["text"], 400)


def test_repeats_odd_rows(spark):
    rows = repeats.report(odd(spark)).collect()
    assert len(rows) == 11 and sum(r["n_removed"] == r["n_bytes"] > 0 for r in rows) == 5
    assert repeats.report(empty(spark)).count() == 0
