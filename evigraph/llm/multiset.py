"""Document fingerprints as homomorphic multiset hashes, with DataFrame functions only.

A document is the multiset of its paragraphs (lines). Every paragraph stands for a wide vector
of lanes, and the fingerprint is the sum of the vectors, each lane modulo 2^32. Eight lanes come
from four 64-bit hashes of the whole paragraph: they decide equality. One lane counts the
paragraph's runs of up to three words, one from every word on, and 64 lanes sum the bits of a hash of each run: twice a
lane less the count is a sum of signs, and the cosine of two such vectors estimates how much of
two texts is alike. As all lanes are sums, the order of paragraphs does not matter, and a
paragraph is put in or taken out by adding or subtracting its vector.

Defined cases: a null text counts as empty, one paragraph without words; equal texts are alike
to 1.0, a text without words to any other text to 0.0; with one document the next one is itself;
null ids come after all others in descending order; documents with equal ids follow each other
in the order of their text hash, and repeated rows, which are alike in all that is computed, in any
order; each gives a row of its own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import text_of

EXACT = 8
SIGNS = 64
LANES = EXACT + 1 + SIGNS
RUN = r"(?<!\S)(?=(\S+(?:[ \t\x0B\f\r]+\S+){0,2}))"
_LOW = (1 << 32) - 1
ROWS_PER_SLICE = 256
MOST_SLICES = 1 << 20
SEGMENTS = 1024
_CUTS = 1 << 20         # parts that one id or one slice may be cut into


def lanes_of(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and ``lanes``, the fingerprint as an array of numbers below 2^32.

    Paragraphs and runs become rows that are summed where they arise; one row per key and task
    is all that is shuffled. Keys must tell documents apart.
    """
    lines = texts.select(*keys, F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    runs = lines.select(*keys, "line", F.posexplode_outer(
        F.regexp_extract_all("line", F.lit(RUN), F.lit(1))).alias("k", "run"))
    first = F.coalesce(F.col("k"), F.lit(0)) == 0
    hashed = runs.select(
        *keys, F.when(F.col("run").isNotNull(), F.xxhash64("run")).alias("h"),
        *[F.when(first, F.xxhash64("line", F.lit(s))).alias(f"p{s}") for s in range(EXACT // 2)])
    low = F.lit(_LOW).cast("long")
    two_bits = F.lit((1 << 32) | 1).cast("long")
    sums = [F.sum(x).alias(f"e{2 * s + i}") for s in range(EXACT // 2) for i, x in enumerate((
        F.col(f"p{s}").bitwiseAND(low), F.shiftrightunsigned(f"p{s}", 32)))]
    sums += [F.count("h").alias("n")]
    sums += [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(two_bits)).alias(f"s{k}") for k in range(SIGNS // 2)]
    total = hashed.groupBy(*keys).agg(*sums)
    zero = F.lit(0).cast("long")
    packed = [F.coalesce(f"s{k}", zero) for k in range(SIGNS // 2)]
    lanes = [F.coalesce(f"e{k}", zero).bitwiseAND(low) for k in range(EXACT)] + [F.col("n").bitwiseAND(low)]
    lanes += [x.bitwiseAND(low) for x in packed] + [F.shiftrightunsigned(x, 32).bitwiseAND(low) for x in packed]
    return total.select(*keys, F.array(*lanes).alias("lanes"))


def add(a: Column, b: Column) -> Column:
    """Fingerprint of two multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_LOW).cast("long")))


def remove(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_LOW).cast("long")))


def render(lanes: Column) -> Column:
    """The lanes as hexadecimal digits, eight for each."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _signs(lanes: Column) -> Column:
    count = lanes[EXACT]
    return F.transform(F.slice(lanes, EXACT + 2, SIGNS), lambda x: (2 * x - count).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal fingerprints, else the cosine of the sign lanes, 0.0 where it is negative."""
    norm = F.sqrt(_dot(_signs(a), _signs(a)) * _dot(_signs(b), _signs(b)))
    cosine = F.when(norm > 0, _dot(_signs(a), _signs(b)) / norm).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def _part_of_tie(parts: int) -> Column:
    """The part of the range of hashes a text hash lies in, rising with it."""
    return F.floor((F.col("tie").cast("double") / float(1 << 64) + 0.5) * parts).cast("long")


def _slices(rows: DataFrame) -> DataFrame:
    """``rows`` with a ``slice`` that rises with id and text hash, nulls first, of some hundred rows.

    Quantiles of the ids cut the range into segments, which are cut evenly. An id that owns
    several quantiles, and null ids, are cut by the text hash. Only rows equal in both stay
    together. The number of slices is bounded by ``MOST_SLICES`` and the quantiles by ``SEGMENTS``.
    """
    n, nulls = rows.agg(F.count("id"), F.count_if(F.col("id").isNull())).first()
    slices = min(MOST_SLICES, max(1, n // ROWS_PER_SLICE))
    segments = min(SEGMENTS, slices)
    bounds = rows.agg(F.percentile_approx("id", [k / segments for k in range(segments)], 10 * segments)).first()[0] or []
    null_part = _part_of_tie(max(1, min(_CUTS, nulls // ROWS_PER_SLICE)))
    if not bounds:
        return rows.withColumn("slice", null_part - F.lit(_CUTS))
    per = max(1, slices // segments)
    lows = sorted(set(bounds))
    value = F.col("id").cast("double")
    # doubles rise with ids, so slices do, also where several ids are one double
    starts = sorted({float(x) for x in lows})
    found = rows.withColumn("_value", value).withColumn("_segment", F.lit(0.0))
    if len(starts) > 1:
        found = Bucketizer(splits=[float("-inf"), *starts[1:], float("inf")], inputCol="_value", outputCol="_segment",
                           handleInvalid="keep").transform(found.drop("_segment"))
    at = F.col("_segment").cast("int")
    low = F.element_at(F.array(*[F.lit(x) for x in starts]), at + 1)
    high = F.element_at(F.array(*[F.lit(x) for x in [*starts[1:], starts[-1] + 1.0]]), at + 1)
    inside = F.greatest(F.lit(0), F.least(F.lit(per - 1), F.floor((value - low) / (high - low) * per))).cast("long")
    part = F.lit(0).cast("long")
    owner = {float(x): x for x in lows if bounds.count(x) > 1}      # the id that owns a segment's start
    if owner:
        most = min(_CUTS - 4, max(bounds.count(x) for x in lows) * per)
        heavy = F.element_at(F.array(*[F.lit(owner.get(x)).cast("long") for x in starts]), at + 1)
        part = F.when(inside > 0, part).when(F.col("id") == heavy, 1 + _part_of_tie(most)) \
            .when(F.col("id") > heavy, F.lit(most + 2).cast("long")).otherwise(part)
    number = (at.cast("long") * per + inside) * _CUTS + part
    return found.withColumn("slice", F.when(F.col("id").isNull(), null_part - F.lit(_CUTS)).otherwise(number)) \
        .drop("_value", "_segment")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``slice, position, id, tie, text`` and ``next_slice, next_position, next_text`` of the next
    document in descending order of ids.

    Rows are sorted slice by slice and numbered there, in the one shuffle of the texts. The first
    document of every slice is also sent to the slice before it, where it follows the last one;
    only those few texts travel twice, and the number of the first is known to be one.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")) \
        .select("id", "text", F.xxhash64("text", F.lit(1)).alias("tie"))
    sliced = _slices(rows)
    heads = cut_lineage(sliced.groupBy("slice").agg(F.max(F.struct("id", "tie")).alias("head")), "heads")
    above = F.lead("slice").over(Window.orderBy("slice"))       # at most MOST_SLICES rows
    lowest = F.min("slice").over(Window.partitionBy())
    guests = heads.select(F.col("slice").alias("of"), F.col("head.id").alias("head_id"), F.col("head.tie").alias("head_tie"),
                          F.coalesce(above, lowest).alias("to"))
    marked = sliced.join(F.broadcast(guests), (F.col("slice") == F.col("of")) & (F.col("tie") == F.col("head_tie"))
                         & F.col("id").eqNullSafe(F.col("head_id")), "left")
    here = F.struct(F.lit(0).alias("guest"), F.col("slice").alias("at"))
    there = F.struct(F.lit(1).alias("guest"), F.col("to").alias("at"))
    dealt = marked.select("id", "tie", "text", "slice", F.explode(
        F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("x")) \
        .select("id", "tie", "text", "slice", "x.*")
    within = Window.partitionBy("at").orderBy("guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    position = F.row_number().over(within)
    return dealt.select("guest", "slice", "id", "tie", "text", position.alias("position"),
                        F.lead("slice").over(within).alias("next_slice"),
                        F.when(F.lead("guest").over(within) == 1, F.lit(1)).otherwise(position + 1).alias("next_position"),
                        F.lead("text").over(within).alias("next_text")).filter("guest = 0").drop("guest")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are.

    The edited text has its last half replaced by the beginning of the next document's text.
    """
    pairs = with_next(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    both = pairs.select(
        "slice", "position", "id", "next_slice", "next_position", n.cast("long").alias("n_chars"), "text", edited.alias("edited")) \
        .select("slice", "position", "id", "next_slice", "next_position", "n_chars", F.unhex(F.sha2("edited", 256)).alias("edited_sha256"),
                F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")),
                                  F.struct(F.lit(1).alias("side"), F.col("edited").alias("body")))).alias("b")) \
        .select("*", "b.*").drop("b")
    for c in ("id", "next_slice", "next_position", "n_chars", "edited_sha256"):      # once a document is enough
        both = both.withColumn(c, F.when(F.col("side") == 0, F.col(c)))
    keys = ["slice", "position", "id", "next_slice", "next_position", "n_chars", "edited_sha256", "side"]
    lanes = cut_lineage(lanes_of(both, keys, "body"), "lanes")
    own, changed = lanes.filter("side = 0").drop("side"), lanes.filter("side = 1")
    changed = changed.select("slice", "position", F.col("lanes").alias("edited"))
    after = own.select(F.col("slice").alias("next_slice"), F.col("position").alias("next_position"), F.col("lanes").alias("after"))
    return own.join(changed, ["slice", "position"]).join(after, ["next_slice", "next_position"]) \
        .select(F.col("id").alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), render(F.col("lanes")).alias("fingerprint"),
                render(F.col("edited")).alias("edited_fingerprint"),
                likeness(F.col("lanes"), F.col("edited")).alias("near_edited"),
                likeness(F.col("lanes"), F.col("after")).alias("near_next"))
