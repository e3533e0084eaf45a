"""What a sample's name and type string say, by a template, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchlens.sources.templates import Template


def java(pattern: str) -> str:
    """The pattern with named groups as Java writes them."""
    return pattern.replace("(?P<", "(?<")


def by_vocabulary(t: Template, text: Column) -> Column:
    """The sample type of an exact type string; null where the template doesn't list it."""
    out = F.lit(None).cast("string")
    for word, kind in t.sample_type_vocab.items():
        out = F.when(text == word, kind).otherwise(out)
    return out


def by_name(t: Template, name: Column) -> Column:
    """The type of the first pattern that the name matches; null where none does."""
    kinds = [F.when(name.rlike(java(p["pattern"])), p["type"]) for p in t.sample_type_patterns]
    return F.coalesce(*kinds) if kinds else F.lit(None).cast("string")


def level_in_name(t: Template, name: Column) -> Column:
    """The concentration that a name states; its unit isn't looked at."""
    if not t.expected_conc_from_name:
        return F.lit(None).cast("double")
    return F.regexp_extract(name, java(t.expected_conc_from_name), re.compile(t.expected_conc_from_name).groupindex["value"]).try_cast("double")


def parent_of(t: Template, kind: Column, name: Column) -> Column:
    """The name without the suffix of the first rule for its type that fits."""
    out = [F.when((kind == r["type"]) & name.endswith(r["name_suffix"]), F.left(name, F.length(name) - len(r["name_suffix"]))) for r in t.parent_rules]
    return F.coalesce(*out) if out else F.lit(None).cast("string")
