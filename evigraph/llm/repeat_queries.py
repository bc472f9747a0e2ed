"""The query of the repeat removal; it is tested against brute force."""

from __future__ import annotations

from ..session import read_table
from . import repeats
from .queries import query


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark, root):
    return repeats.report(read_table(spark, root, "documents"))
