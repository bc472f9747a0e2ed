"""Queries of the classifiers; they are tested by held-out accuracy."""

from __future__ import annotations

from ..session import read_table
from . import quality, toxicity
from .queries import query


@query("op10_quality_classifier")
def op10_quality_classifier(spark, root):
    return quality.quality(read_table(spark, root, "documents"), read_table(spark, root, "labels"))


@query("op4_toxicity_cnn")
def op4_toxicity_cnn(spark, root):
    return toxicity.toxicity(read_table(spark, root, "documents"), read_table(spark, root, "labels"))
