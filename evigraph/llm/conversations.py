"""Cheapest repair of the role structure of conversations, by an automaton of shared suffixes.

A conversation is read as a signature, one letter a turn: what its role can be and whether its
text is cut off or the turn has to go. Distinct signatures are sorted by their reversed letters,
so those with equal endings are neighbours, and equal endings are one node of a word graph built
from the end. For every node and grammar state the cost-to-go and the first letter of the best
audit are worked out once, however many conversations end that way; nodes whose costs differ by
a constant share one transition. An audit is read off along the letters from the first turn on:
as each letter has one transition in each state, the cheapest audit that comes first in ASCII
order takes the least letter among the cheapest at every step.

The grammar of roles is ``(s?(ua)+)?``. Turns are kept (K, 0), given the role the grammar wants
next (R, 1), deleted (D, 2), and empty turns are put in (I, 5); a turn that is cut off and stays
costs 5 more, blank and repeated turns must go.

Turns travel sorted by conversation and are read as a stream: of a conversation a task holds one
letter a turn and the state of a digest, never its texts, so a conversation that owns a third of
all turns costs memory only for the audit, which is part of its result.

Defined cases: null roles and texts count as one space, in the key of the damage also null ids and
turns; turns with a null number come first; turns of one number are in the order of role, text and
row, so repeated rows are neighbours; a null conversation id is a conversation like any other; a
conversation that lost all turns has zeros, an empty audit and the digest of nothing; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FOLDS = 20
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
NEXT = (2, 2, 3, 2)             # states: nothing yet, after s, after u, after a
WANTED = ("user", "user", "assistant", "user")
GONE = "-"
_END = ((0, 2 * INSERT, INSERT, 0), (" ", "I", "I", " "))


def damage(turns: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Planted faults: ``conv, turn, role, text`` with some rows dropped, emptied, cut off, repeated or rerolled."""
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(folds))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
                        F.when(kind == 4, "user").otherwise(one("role")).alias("role"),
                        text.alias("text"), F.explode(copies).alias("copy")) \
        .filter("kind <> 0").select("conv_id", "turn", "role", "text")


def _key(name: str = "conv_id"):
    """A conversation id as text that is never null, so that Python does not turn ids into floats."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit("-")).alias("conv")


def mark(turns: DataFrame) -> DataFrame:
    """Turns with a row number, the first fault of each and its letter in the signature."""
    rows = cut_lineage(turns.select(
        F.monotonically_increasing_id().alias("row"), _key(), F.col("turn").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text"), "turns")
    first = rows.groupBy("conv", "role", "text").agg(F.min(F.struct("known", "turn", "row")).alias("one")) \
        .select(F.col("one.row").alias("row"), F.lit(True).alias("first"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("first").isNull(), "duplicate") \
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    able = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE) \
        .when(F.col("fault") == "truncated", F.upper(able)).otherwise(able)
    return cut_lineage(rows.join(first, "row", "left").withColumn("fault", fault).select(
        "conv", "known", "turn", "role", "text", "row", "fault", initial.alias("initial"), letter.alias("letter")), "marked")


ORDER = ["known", "turn", "role", "text", "row"]


def signatures(marked: DataFrame) -> DataFrame:
    """``conv, signature``, one letter a turn."""
    def run(batches):
        conv, parts = None, []
        for pdf in batches:
            convs, letters, out = pdf["conv"].to_numpy(), "".join(pdf["letter"]), []
            edges = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if convs[lo] != conv:
                    if conv is not None:
                        out.append((conv, "".join(parts)))
                    conv, parts = convs[lo], []
                parts.append(letters[lo:hi])
            yield pd.DataFrame(out, columns=["conv", "signature"])
        if conv is not None:
            yield pd.DataFrame([(conv, "".join(parts))], columns=["conv", "signature"])

    return marked.repartition("conv").sortWithinPartitions("conv", *ORDER).select("conv", "letter") \
        .mapInPandas(run, "conv string, signature string")


def keep_state(state: int, able: str) -> int | None:
    """The state after a kept turn of that role; ``None`` where the grammar forbids it."""
    if state == 0 and able == "s":
        return 1
    return NEXT[state] if able == WANTED[state][0] else None


def transition(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost-to-go and best first letter in every state, from the costs behind the turn."""
    able, more = letter.lower(), CUT_OFF if letter.isupper() else 0
    best = []
    for state in range(4):
        ways = [(DELETE + after[state], "D")]
        if letter != GONE:
            to = keep_state(state, able)
            if to is not None:
                ways.append((more + after[to], "K"))
            ways.append((REROLE + more + after[NEXT[state]], "R"))
        best.append(min(ways))
    # two turns put in at one place come back to the same state at a higher cost
    after_u = min(best[2], (INSERT + best[3][0], "I"))
    after_a = min(best[3], (INSERT + best[2][0], "I"))
    found = [min(best[0], (INSERT + after_u[0], "I")), min(best[1], (INSERT + after_u[0], "I")), after_u, after_a]
    return tuple(c for c, _ in found), tuple(x for _, x in found)


class SuffixGraph:
    """Nodes of the endings on the way to the signature last added."""

    def __init__(self):
        self.shared: dict = {}          # (letter, relative costs) -> (relative costs, constant, first letters)
        self.path: list = [(_END[0], 0, _END[1])]
        self.signature = ""             # reversed
        self.made = 0

    def add(self, backwards: str) -> int:
        """Go to the node of a signature given from its end; its cost."""
        same, most = 0, min(len(backwards), len(self.signature))
        while same < most and backwards[same] == self.signature[same]:
            same += 1
        del self.path[same + 1:]
        for letter in backwards[same:]:
            relative, constant, _ = self.path[-1]
            key = (letter, relative)
            if key not in self.shared:
                costs, letters = transition(letter, relative)
                least = min(costs)
                self.shared[key] = (tuple(c - least for c in costs), least, letters)
            relative, least, letters = self.shared[key]
            self.path.append((relative, constant + least, letters))
            self.made += 1
        self.signature = backwards
        return self.path[-1][0][0] + self.path[-1][1]

    def audit(self) -> str:
        """Best letters from the node last added to the end."""
        state, out, at = 0, [], len(self.path) - 1
        while True:
            letter = self.path[at][2][state]
            if letter == " ":
                return "".join(out)
            out.append(letter)
            if letter != "I":
                at -= 1
            if letter == "K":
                state = keep_state(state, self.signature[at].lower())
            elif letter != "D":
                state = NEXT[state]


def audits(signed: DataFrame) -> DataFrame:
    """``signature, cost, audit`` of distinct signatures."""
    def run(batches):
        graph = SuffixGraph()
        for pdf in batches:
            rows = [(graph.add(b), graph.audit()) for b in pdf["backwards"]]
            yield pd.DataFrame({"backwards": pdf["backwards"], "cost": [c for c, _ in rows], "audit": [a for _, a in rows]})

    distinct = signed.select(F.reverse("signature").alias("backwards")).distinct()
    return distinct.repartitionByRange("backwards").sortWithinPartitions("backwards") \
        .mapInPandas(run, "backwards string, cost long, audit string") \
        .select(F.reverse("backwards").alias("signature"), "cost", "audit")


class _Open:
    """What is known of the conversation that is being read."""

    def __init__(self, conv, cost, audit):
        self.conv, self.cost, self.audit = conv, cost, audit
        self.at, self.state, self.place, self.digest = 0, 0, 0, hashlib.sha256()
        self.faults, self.illegal, self.initial = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None
        self.low, self.high, self.turns = None, None, 0

    def put(self, role, text, out):
        self.digest.update((("\n" if self.place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.place += 1
        if out is not None:
            out.append((self.conv, self.place, role, text))

    def insert(self, out):
        while self.audit[self.at:self.at + 1] == "I":
            self.put(WANTED[self.state], "", out)
            self.state = NEXT[self.state]
            self.at += 1

    def row(self, known, turn, role, text, fault, initial, out):
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if known and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.insert(out)
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.put(role, text, out)
            self.state = keep_state(self.state, initial)
        elif letter == "R":
            self.put(WANTED[self.state], text, out)
            self.state = NEXT[self.state]

    def close(self, out):
        self.insert(out)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit, self.digest.hexdigest())


_REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, " \
          "repaired_sha256 string"


def _mend(turns: bool):
    names = ["conv", "position", "role", "text"] if turns else [x.split()[0] for x in _REPORT.split(", ")]

    def run(batches):
        now = None
        for pdf in batches:
            done, out = [], [] if turns else None
            for head, conv, cost, audit, *row in zip(*[pdf[c] for c in (
                    "head", "conv", "cost", "audit", "known", "turn", "role", "text", "fault", "initial")]):
                if head:
                    if now is not None:
                        done.append(now.close(out))
                    now = _Open(conv, cost, audit)
                else:
                    now.row(*row, out)
            yield pd.DataFrame(out if turns else done, columns=names)
        if now is not None:
            out = [] if turns else None
            last = now.close(out)
            yield pd.DataFrame(out if turns else [last], columns=names)
    return run


def _mended(turns: DataFrame, all_ids: DataFrame, rows: bool) -> DataFrame:
    marked = mark(turns)
    signed = cut_lineage(signatures(marked), "signed")
    best = cut_lineage(audits(signed), "audits")
    convs = all_ids.select(_key()).distinct()
    heads = convs.join(signed.join(best, "signature"), "conv", "left").select(
        F.lit(True).alias("head"), "conv", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.lit(False).alias("known"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"),
        F.lit(0).cast("long").alias("row"), F.lit("").alias("fault"), F.lit("").alias("initial"))
    body = marked.select(F.lit(False).alias("head"), "conv", F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"),
                         "known", "turn", "role", "text", "row", "fault", "initial")
    stream = heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", F.col("head").desc(), *ORDER)
    return stream.mapInPandas(_mend(rows), "conv string, position long, role string, text string" if rows else _REPORT)


def _id(all_ids: DataFrame):
    kind = all_ids.schema["conv_id"].dataType
    return F.when(F.col("conv") != "-", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")


def report(turns: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and digest of the repaired turns, for every id of ``all_ids`` (default: of ``turns``)."""
    ids = turns if all_ids is None else all_ids
    out = _mended(turns, ids, False)
    return out.select(_id(ids), *out.columns[1:])


def repair(turns: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, position, role, text``."""
    return _mended(turns, turns, True).select(_id(turns), "position", "role", "text")
