"""Personal data in texts: generators, boosted trees and calibrated thresholds, all as columns.

Eight generators propose overlapping spans with a high recall: the strict formats of e-mail
addresses, IP addresses, card and phone numbers, and a loose variant of each. A span in a strict
format that passes its check (parts up to 255, Luhn, number of digits) is a base span and always
stays. Boosted trees learn, from kind, format and context of all proposed spans, which of them hold
personal data: a span is labelled so if it passes the check of its kind once its disguise is taken
off, as ``bob [at] host [dot] com`` does. Which generator proposed it is not known to the trees. A
proposed span that meets no base span is added where its score reaches the threshold of its kind,
the lowest with the wanted precision among such spans alone, so that the number of base spans in
the corpus does not decide.

The corpus is read once and no text is shuffled: proposals become rows, positions are running
sums of the lengths between matches, and a document's spans meet again by its row number.

Defined cases: a null or empty text has no spans; texts are searched to their end, in linear
time (patterns do not go back); rows with a null or repeated id are separate documents; an
empty table gives an empty result; extra columns are not read. Positions are code points.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bind
from ..session import cut_lineage
from . import boosting
from .common import text_of

KINDS = ("email", "ip", "card", "phone")
#: Pattern and the test that a text must pass before the pattern is tried; base first, then loose.
GENERATORS = (
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", "[0-9]"),
    (r"[0-9](?:[\x20-]?+[0-9])++", "[0-9]"),
    (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++"
     r"(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]++)++", r"[\[(](?:at|AT)[\])]"),
    (r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}", r"\[\.\]"),
    (r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}+[0-9]{4}){2}[\x20._/-]{1,2}+[0-9]{2,7}+", "[0-9]{4}"),
    (r"(?<![0-9+.])\(?+[0-9]{2,4}+\)?+[\x20.-]{1,2}+[0-9]{3,4}+[\x20.-][0-9]{3,5}+", "[0-9]{3}"),
)
CONTEXT = 24
HINTS = r"(?i)(mail|tel|phone|call|fax|card|visa|karte|tarjeta|carte|host|addr|contact|kontakt)"
PRECISION = 0.98
FEATURES = ("kind", "digits", "letters", "marks", "before", "after", "hint", "lead", "head", "luhn", "small")


_AT, _DOT = r"\x20?[\[(](?:at|AT)[\])]\x20?", r"\x20?[\[(](?:dot|DOT|\.)[\])]\x20?"


def _matches(text: Column, g: int, pattern: str) -> Column:
    """Matches of one generator, each with the gap before it and the two letters behind it."""
    def of(gaps: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda match, i: F.struct(
            F.lit(g).alias("g"), i.alias("i"), F.char_length(F.get(gaps, i)).alias("gap"), match.alias("match"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("pre"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("post")))
    return bind(F.split(text, pattern, -1), of)


def _proposals(text: Column) -> Column:
    """All matches of all generators; a generator is only tried on texts that pass its test."""
    none = F.array().cast("array<struct<g:int,i:int,gap:int,match:string,pre:string,post:string>>")
    return F.concat(*[F.when(text.rlike(test), _matches(text, g, pattern)).otherwise(none)
                      for g, (pattern, test) in enumerate(GENERATORS)])


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is a multiple of ten."""
    n = F.char_length(digits)

    def value(k):
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, k: acc + value(k)) % 10 == 0


def _letter_class(c: Column) -> Column:
    return (F.when(F.coalesce(c, F.lit("")) == "", 0).when(c.rlike(r"^\s"), 0)
            .when(c.rlike(r"^\p{L}"), 1).when(c.rlike(r"^[0-9]"), 2).otherwise(3))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               row: Column | None = None) -> DataFrame:
    """Proposed spans with positions, features, label and whether they are base spans or meet one.

    Documents without any keep one row with a null ``g``.
    """
    rows = docs.select((row if row is not None else F.monotonically_increasing_id()).alias("row"),
                       F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    found = rows.select("row", "doc_id", F.explode_outer(_proposals(F.col("text"))).alias("c")) \
        .select("row", "doc_id", "c.*").repartition("row")
    before = Window.partitionBy("row", "g").orderBy("i")
    end = F.sum(F.col("gap") + F.char_length("match")).over(before)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.char_length(digits)
    plain = F.when(F.col("g") < 4, F.col("match")).otherwise(
        F.regexp_replace(F.regexp_replace("match", _AT, "@"), _DOT, "."))
    address = plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$")
    small = F.forall(F.split(plain, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    kind = F.col("g") % 4
    luhn = F.when(kind != 2, 2).when(n.between(14, 19), _luhn(digits).cast("int")).otherwise(0)
    earned = (F.when(kind == 0, address).when(kind == 1, small)
              .when(kind == 2, luhn == 1).when(kind == 3, n.between(10, 15) & (
                  # loose: not a piece of a longer number
                  (F.col("g") < 4) | ~F.coalesce(F.col("post"), F.lit("")).rlike(r"^[\x20.-]?[0-9]"))).otherwise(F.lit(False)))
    letters = F.char_length(F.regexp_replace("match", "[^A-Za-z]", ""))
    placed = found.select(
        "row", "doc_id", "g", kind.alias("kind"), earned.alias("earned"),
        (end - F.char_length("match")).cast("long").alias("start"), end.cast("long").alias("end"),
        (earned & (F.col("g") < 4)).alias("base"), F.least(n, F.lit(20)).alias("digits"), F.least(letters, F.lit(12)).alias("letters"),
        F.least(F.char_length("match") - n - letters, F.lit(8)).alias("marks"),
        _letter_class(F.right("pre", F.lit(1))).alias("before"), _letter_class(F.col("post")).alias("after"),
        F.col("pre").rlike(HINTS).cast("int").alias("hint"), F.col("match").rlike(r"^[+(]").cast("int").alias("lead"),
        F.coalesce(F.left(digits, F.lit(1)).try_cast("int"), F.lit(10)).alias("head"),
        luhn.alias("luhn"), F.when(kind == 1, small.cast("int")).otherwise(2).alias("small"))
    up = Window.partitionBy("row", "kind").orderBy("start", "end", "g").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row", "kind").orderBy(F.desc("start"), F.desc("end"), F.desc("g")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.max(F.when(F.col("base"), F.col("end"))).over(up) > F.col("start")
    later = F.min(F.when(F.col("base"), F.col("start"))).over(down) < F.col("end")
    return placed.withColumn("meets", F.col("base") | F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False)))


def fit(spans: DataFrame, precision: float = PRECISION) -> tuple[boosting.Model, list[float]]:
    """The trees and one threshold for each kind, from counts of all proposed spans.

    The counted combinations are bounded by the feature grid, not by the corpus.
    """
    def total(c: Column) -> Column:
        return F.sum(c.cast("long"))

    alone = ~F.col("meets")
    counted = spans.filter("g IS NOT NULL").groupBy(*FEATURES).agg(
        total(F.col("earned")).alias("positive"), F.count(F.lit(1)).alias("n"),
        total(F.col("earned") & alone).alias("alone_positive"), total(alone).alias("alone")) \
        .orderBy(*FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in counted], dtype=np.int64).reshape(-1, len(FEATURES))
    positive, n, alone_positive, alone = (np.array([r[c] for r in counted], dtype=np.float64)
                                          for c in ("positive", "n", "alone_positive", "alone"))
    model = boosting.fit(x, positive, n)
    score = 1 / (1 + np.exp(-model.logits(x))) if len(x) else np.zeros(0)
    mine = [(x[:, 0] == k) & (alone > 0) for k in range(len(KINDS))]
    # Spark adds the trees up in another order than numpy, so equal scores may differ in their last digits
    return model, [boosting.threshold(score[m], alone_positive[m], alone[m], precision) - 1e-9 for m in mine]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None,
           precision: float = PRECISION) -> DataFrame:
    """Per document ``row, doc_id``, ``base`` and ``spans``: sorted arrays of ``start, kind, end``."""
    found = cut_lineage(candidates(docs, id_col, text_col, row), "proposals")
    model, cuts = fit(found, precision)
    score = model.column([F.col(f) for f in FEATURES])
    cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("kind") + 1)
    chosen = F.col("base") | (~F.col("meets") & (score >= cut))
    span = F.struct("start", "kind", "end")
    return found.groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.array_distinct(F.collect_list(F.when(chosen, span)))).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, a digest of them, and all spans."""
    found = detect(docs)
    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    Columns, their order and all other values stay; only texts with spans are joined anew.
    """
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns]).alias("rec")), "numbered")
    flat = numbered.select("row", F.col(f"rec.`{id_col}`").alias("doc_id"), F.col(f"rec.`{text_col}`").alias("text"))
    found = detect(flat, row=F.col("row")).filter(F.size("spans") > 0)
    spans = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    seen = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.max("end").over(seen) <= F.col("start"), F.lit(True))
    run = Window.partitionBy("row").orderBy("start", "kind", "end")
    grouped = spans.withColumn("opens", opens).withColumn("part", F.sum(F.col("opens").cast("int")).over(run))
    merged = grouped.groupBy("row", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    past = F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0).cast("long"))
    cuts = merged.withColumn("past", past).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "past", "kind", "end"))).alias("cuts"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col(f"rec.`{text_col}`")
    kept = F.transform("cuts", lambda c: F.concat(
        F.substring(text, (c["past"] + 1).cast("int"), (c["start"] - c["past"]).cast("int")),
        F.element_at(names, c["kind"] + 1)))
    rest = F.substring(text, (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.char_length(text))
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    return numbered.join(cuts, "row", "left").select(
        *[new.alias(c) if c == text_col else F.col(f"rec.`{c}`") for c in docs.columns])
