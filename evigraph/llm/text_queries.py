"""Queries of the operators on single texts and pages."""

from __future__ import annotations

from ..session import read_table
from . import pii, site_style
from .queries import query


@query("op5_pii_boosted_spans")
def op5_pii_boosted_spans(spark, root):
    return pii.report(read_table(spark, root, "documents"))


@query("op7_html_site_style")
def op7_html_site_style(spark, root):
    return site_style.extract(read_table(spark, root, "pages"))
