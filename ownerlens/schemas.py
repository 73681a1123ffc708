"""Typed table schemas."""
from __future__ import annotations

from pyspark.sql import types as T

from ownerlens import vocab as V


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


STR, INT, LONG, DBL, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

RAW_ARTICLE = _s(("title", STR), ("url", STR), ("source", STR), ("published_at_raw", STR), ("raw_text", STR), ("is_rss", BOOL))

ORGANISATION = _s(("name", STR), ("type", STR))
PERSON = _s(("name", STR), ("position", STR), ("organization", STR), ("event", STR))
HOLDING = _s(
    ("name", STR), ("organization", STR), ("nature_of_control", STR), ("board_role", STR), ("percentage", STR),
    ("direct_percentage", STR), ("indirect_percentage", STR), ("voting_rights_percentage", STR),
    ("intermediate_entities", STR), ("change_type", STR), ("previous_holder", STR), ("pep_status", STR),
    ("risk_level", STR), ("regulatory_filing_ref", STR),
)
PROCUREMENT = _s(("agency", STR), ("contractor", STR), ("amount", STR), ("project", STR))
EXTRACTION = _s(
    ("relevant", BOOL), ("category", STR), ("event_type", STR), ("risk_score", INT), ("risk_level", STR),
    ("importance_score", INT), ("summary", STR), ("organizations", T.ArrayType(ORGANISATION)),
    ("people", T.ArrayType(PERSON)), ("significant_control", T.ArrayType(HOLDING)), ("procurement", PROCUREMENT),
)
GOLD = T.StructType(
    [T.StructField(n, STR) for n in ("title", "article_text", "url", "source")]
    + list(EXTRACTION.fields)
    + [T.StructField(n, STR) for n in ("verified_by", "verified_at")]
)
CORPUS = _s(("title", STR), ("article_text", STR), ("url", STR), ("source", STR), ("captured_at", STR))

REGISTERS = {name: _s(*[(col, STR) for col in cols]) for name, cols in V.REGISTER_COLUMNS.items()}
