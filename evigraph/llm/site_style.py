"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of tags and classes, and for each
node it is counted on how many pages it has which children (its presentation) and which content.
A node whose presentation varies, or whose content is new on every page, is important; one that
looks and reads the same everywhere is not. The composite importance of a node mixes its own
with that of the content below it. Branches below the threshold are taken out of each page,
besides those whose element says that they are no article (navigation, footers, adverts, forms,
comments and the like).

If a page has an ``article`` or ``main`` element, the text is what is left of it, else what is
left of the body. Blocks within them are never taken for template text, however often a site
repeats them, so a page that is copied with a few changes loses nothing of its article. Pages of
one text count once for their site. Importance is smoothed towards 1 by ``PRIOR`` pages, so what
two or three pages share says little and what many share says much. If nothing is left of a page,
only the elements themselves decide.

Defined cases: null or empty HTML gives an empty text; unclosed elements end with their parent;
unknown character references stay as they are; pages without a host form a site of their own;
repeated rows give repeated results; an empty table gives an empty result; extra columns are
not read. Nothing is cut off, however long a page is.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_scratch

GAMMA = 0.9
THRESHOLD = 0.25
SHARE = 0.2             # a node on fewer of a site's pages is no template
PRIOR = 1.0             # pages' worth of belief that a node is important
FLUSH = 50_000

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                  r"|<(?:[!?/][^>]*+>)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
                    "q ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NO_ARTICLE = frozenset("nav footer aside form button select option dialog menu head fieldset "
                        "object canvas audio video".split())
_NEVER_STALE = frozenset("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_NO_ARTICLE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?|footer|"
    r"masthead|site-header|page-header|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|"
    r"sign-?up|share|sharing|social|comments?|disqus|repl(?:y|ies)|related|recommend\w*|widget|pagination|"
    r"login|search|navigation|complementary|contentinfo)(?:$|[\s_-])", re.I)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?:$|[\s_-])", re.I)
_BLOCK_ENDS_P = frozenset("p div ul ol li table tr td th h1 h2 h3 h4 h5 h6 section article main nav footer "
                          "header aside form blockquote pre figure dl dt dd hr".split())
_CLOSES_SAME = frozenset("li td th tr dt dd option".split())


class _Node:
    """``noise`` comes from elements and their names, ``stale`` from the site's template."""

    __slots__ = ("tag", "path", "noise", "stale", "zone")

    def __init__(self, tag: str, path: int, noise: bool, stale: bool, zone: int):
        self.tag, self.path, self.noise, self.stale, self.zone = tag, path, noise, stale, zone


class Page:
    """Blocks and nodes of one page. ``low`` are the paths of the site's unimportant nodes."""

    def __init__(self, page: str, low: frozenset[int] = frozenset(), survey: bool = False):
        self.low, self.survey = low, survey
        self.blocks: list[tuple[int, bool, str]] = []       # zone, noise, text
        self.children: dict[int, list[str]] = {}
        self.content: dict[int, list[str]] = {}
        self.above: dict[int, tuple[int, ...]] = {}
        self.stack = [_Node("", 0, False, False, 0)]
        self.text: list[str] = []
        self._parse(page)

    def _flush(self) -> None:
        if self.text:
            words = " ".join(entities.unescape("".join(self.text)).split())
            self.text = []
            if words:
                top = self.stack[-1]
                self.blocks.append((top.zone, top.noise or top.stale, words))
                if self.survey:
                    self.content.setdefault(top.path, []).append(words)

    def _close(self, depth: int) -> None:
        if any(n.tag not in _INLINE for n in self.stack[depth:]):
            self._flush()
        del self.stack[depth:]

    def _open(self, tag: str, attributes: str) -> None:
        names = " ".join(v for m in _NAMES.finditer(attributes) for v in m.groups()[1:] if v) if "=" in attributes else ""
        if tag in _BLOCK_ENDS_P or tag in _CLOSES_SAME:
            for depth in range(len(self.stack) - 1, 0, -1):
                open_tag = self.stack[depth].tag
                if open_tag == "p" and tag in _BLOCK_ENDS_P or open_tag == tag and tag in _CLOSES_SAME:
                    self._close(depth)
                    break
                if open_tag not in _INLINE:
                    break
        if tag not in _INLINE:
            self._flush()
        above = self.stack[-1]
        path = xxhash.xxh64_intdigest(f"{tag}.{names}", above.path) >> 1
        zone = above.zone
        noise = above.noise
        stale = above.stale or tag not in _NEVER_STALE and path in self.low
        if tag not in ("html", "body", "article", "main"):
            noise = noise or tag in _NO_ARTICLE or tag == "header" and not zone \
                or bool(names and _NO_ARTICLE_NAMES.search(names))
        elif tag == "article" and _COMMENT_NAMES.search(names):
            noise = True                                    # reader comments marked up as articles
        if not noise:
            zone = 2 if tag == "article" else max(zone, 1) if tag == "main" or "main" in names.split() else zone
        if zone:
            stale = False                                   # however often the site repeats it
        if self.survey and tag not in _INLINE:
            self.children.setdefault(above.path, []).append(tag)
            if path not in self.above:
                self.above[path] = (*self.above.get(above.path, ()), path)
        self.stack.append(_Node(tag, path, noise, stale, zone))

    def _parse(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            if m is None:
                self.text.append(page[at:])
                break
            if m.start() > at:
                self.text.append(page[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.stack[depth].tag == tag:
                        self._close(depth)
                        break
                else:
                    if tag not in _INLINE:
                        self._flush()
            elif tag == "br":
                self.text.append(" ")
            elif tag in _VOID:
                if tag == "hr":
                    self._flush()
            elif tag in _RAW:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                    at = close.end() if close else end
            else:
                self._open(tag, m[3])
        self._flush()

    def main_text(self) -> str:
        """Blocks of the innermost kind of container the page has, one per line."""
        kept = [(zone, words) for zone, noise, words in self.blocks if not noise]
        best = max((zone for zone, _ in kept), default=0)
        return "\n".join(words for zone, words in kept if zone == best)


def host_of(url: str | None) -> str:
    """Host of an address without user and port, in lower case; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _site(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host_of(url)) >> 1


def survey(pages: DataFrame) -> DataFrame:
    """Counted nodes of all sites: ``site, path, kind, value, n`` and the nodes above a path.

    Kind 0 counts presentations, 1 contents, 2 names the nodes above. Pages whose text is the same
    as far as elements tell count once for a site, whatever stands around it. Tasks hand on the
    hashes of each page's nodes; Spark drops those of copies, by a digest of that text, and adds up.
    """
    columns = ["site", "digest", "shape_at", "shape", "text_at", "text", "path", "above"]

    def run(batches):
        above: dict[tuple[int, int], tuple[int, ...]] = {}
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"]):
                site, parsed = _site(url), Page(page, survey=True)
                shape_at, shape = [], []
                for path, up in parsed.above.items():
                    tags = parsed.children.get(path, [])
                    style = "|".join(t for k, t in enumerate(tags) if not k or tags[k - 1] != t)
                    shape_at.append(path)
                    shape.append(xxhash.xxh64_intdigest(style) >> 1)
                    above[site, path] = up
                text = [xxhash.xxh64_intdigest("\n".join(parts)) >> 1 for parts in parsed.content.values()]
                digest = xxhash.xxh3_128_hexdigest(parsed.main_text().encode("utf-8", "surrogatepass"))
                rows.append((site, digest, shape_at, shape, list(parsed.content), text, None, None))
            if len(above) > FLUSH:
                rows += [(site, None, None, None, None, None, path, list(up)) for (site, path), up in above.items()]
                above.clear()
            yield pd.DataFrame(rows, columns=columns).astype({"path": "Int64"})
        if above:
            yield pd.DataFrame([(site, None, None, None, None, None, path, list(up))
                                for (site, path), up in above.items()], columns=columns).astype({"path": "Int64"})

    rows = cut_lineage(pages.select("url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInPandas(
        run, "site long, digest string, shape_at array<long>, shape array<long>, text_at array<long>, "
             "text array<long>, path long, above array<long>"), "surveyed")
    once = rows.filter("digest IS NOT NULL").dropDuplicates(["site", "digest"])
    entry = F.transform(F.arrays_zip("shape_at", "shape"), lambda x: F.struct(
        x["shape_at"].alias("path"), F.lit(0).alias("kind"), x["shape"].alias("value")))
    leaf = F.transform(F.arrays_zip("text_at", "text"), lambda x: F.struct(
        x["text_at"].alias("path"), F.lit(1).alias("kind"), x["text"].alias("value")))
    counts = once.select("site", F.explode(F.concat(entry, leaf)).alias("x")).select("site", "x.*") \
        .groupBy("site", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("above", F.lit(None).cast("array<long>"))
    ups = rows.filter("above IS NOT NULL").groupBy("site", "path").agg(F.max("above").alias("above")).select(
        "site", "path", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("value"),
        F.lit(1).cast("long").alias("n"), "above")
    nodes = cut_lineage(counts.unionByName(ups), "survey")
    drop_scratch(rows)
    return nodes


def importance(nodes: DataFrame) -> DataFrame:
    """Composite importance of every node: ``site, path, pages, share, value``."""
    counts = nodes.filter("kind < 2").groupBy("site", "path", "kind").agg(
        F.sum("n").alias("pages"), F.count(F.lit(1)).alias("values"),
        F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.sum(F.log("n")).alias("log_n"))
    log_m = F.greatest(F.log(F.col("pages").cast("double")), F.lit(1e-9))
    varied = F.least(F.lit(1.0), (F.log(F.col("pages").cast("double")) - F.col("n_log_n") / F.col("pages")) / log_m)
    fresh = 1 - F.col("log_n") / F.col("values") / log_m
    single = F.col("pages") == 1
    own = counts.select(
        "site", "path", "kind", "pages",
        F.when(single, 1.0).when(F.col("kind") == 0, varied).otherwise(fresh).alias("value"))
    shape = own.filter("kind = 0").select("site", "path", "pages", F.col("value").alias("shape"))
    leaves = own.filter("kind = 1").select("site", "path", F.col("value").alias("fresh"), F.col("pages").alias("weight"))
    up = nodes.filter("kind = 2").select("site", "path", F.explode("above").alias("node"))
    below = leaves.join(up, ["site", "path"]).groupBy("site", F.col("node").alias("path")).agg(
        (F.sum(F.col("fresh") * F.col("weight")) / F.sum("weight")).alias("below"))
    sites = shape.groupBy("site").agg(F.max("pages").alias("site_pages"))
    seen = F.when(F.col("below").isNull(), F.col("shape")).otherwise(
        F.lit(1 - GAMMA) * F.col("shape") + F.lit(GAMMA) * F.col("below"))
    return shape.join(below, ["site", "path"], "left").join(sites, "site").select(
        "site", "path", "pages", "site_pages",
        ((F.col("pages") * seen + PRIOR) / (F.col("pages") + PRIOR)).alias("value"))


def unimportant(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per site the paths of its template: nodes on a fair share of its pages, below the threshold.

    The list is bounded by the nodes of a page over ``SHARE``, however many pages a site has.
    """
    low = importance(survey(pages)).filter(
        (F.col("value") < threshold) & (F.col("pages") >= SHARE * F.col("site_pages")))
    return cut_lineage(low.groupBy("site").agg(F.collect_list("path").alias("low")), "templates")


def _site_udf():
    @F.pandas_udf("long")
    def site(urls: pd.Series) -> pd.Series:
        return pd.Series([_site(u) for u in urls], dtype="int64")
    return site


def _extract_udf():
    @F.pandas_udf("string")
    def text(pages: pd.Series, low: pd.Series) -> pd.Series:
        out = []
        for page, paths in zip(pages, low):
            paths = frozenset(paths) if paths is not None else frozenset()
            out.append(Page(page, paths).main_text() or (Page(page).main_text() if paths else ""))
        return pd.Series(out, dtype=object)
    return text


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``.

    A page meets its site's template by a join on the site, which Catalyst broadcasts if the
    templates are small; else AQE may split a site with very many pages.
    """
    templates = unimportant(pages, threshold)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    joined = rows.withColumn("site", _site_udf()("url")).join(templates, "site", "left")
    return joined.select("page_id", "url", _extract_udf()("html", "low").alias("text")) \
        .withColumn("n_chars", F.char_length("text").cast("long"))
