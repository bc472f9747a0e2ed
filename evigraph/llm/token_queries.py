"""Queries of the token operators; the tests hold them against the tokenizers library."""

from __future__ import annotations

import public_tokenizers

from ..session import read_table
from . import bpe, packing
from .queries import query

VOCABULARY = "byte_bpe_50k.json"


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark, root):
    return bpe.round_trip(read_table(spark, root, "documents"), public_tokenizers.path(VOCABULARY))


@query("op8_packing_nnls")
def op8_packing_nnls(spark, root):
    return packing.pack(read_table(spark, root, "documents"), public_tokenizers.path(VOCABULARY))
