"""Names against many patterns, without trying each pattern on each name.

From each pattern the longest text is taken that every match must hold. A pattern is joined to
names by one trigram of that text, the one that the fewest names have; of what meets, names without the whole text are dropped, and only the rest are matched. Patterns without
such a text (``^S[0-9]``, an alternation, or a syntax that isn't understood) are tried on every name.
"""

from __future__ import annotations

import re
import re._constants as ops
import re._parser as parser
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _runs(parsed) -> list[str]:
    """The texts that every match of a parsed pattern holds, each without gaps."""
    out, run = [], ""

    def end() -> None:
        nonlocal run
        out.append(run)
        run = ""

    for op, value in parsed:
        if op is ops.LITERAL and value < 128:
            run += chr(value)
        elif op is ops.AT:
            continue  # an anchor has no width
        elif op is ops.SUBPATTERN:
            inner = _runs(value[-1])
            whole = len(inner) == 1  # a group of text alone goes on with what stands around it
            run += inner[0]
            if not whole:
                end()
                out += inner[1:-1]
                run = inner[-1]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
            end()
            out += _runs(value[-1])
        else:
            end()
    end()
    return out


def required_text(pattern: str) -> str | None:
    """The longest text, in lower case, that each match of the pattern holds whatever its capitals; None if there is none of ``GRAM`` characters."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            runs = _runs(parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None
    best = max((r.lower() for r in runs), key=len, default="")
    return best if len(best) >= GRAM else None


def _grams(text):
    """The distinct trigrams of a column of texts."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))


def matched_names(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """``name`` and the columns of ``patterns`` (pattern, in Java's syntax, and others) for each name of ``names`` that a pattern is found in.

    Names are distinct rows of a column ``name``; null names match nothing. Rows of patterns that repeat count as often.
    """

    def literals(frames):
        for f in frames:
            yield f.assign(text=[None if p is None else required_text(p) for p in f["pattern"]])

    distinct = patterns.select("pattern").where("pattern is not null").distinct()
    known = distinct.mapInPandas(literals, "pattern string, text string")
    known = known.withColumn("text", F.when(F.length("text") >= GRAM, F.col("text")))
    lower = names.where("name is not null").select("name", F.lower("name").alias("low"))
    of_names = lower.where(F.length("low") >= GRAM).select("name", "low", F.explode(_grams(F.col("low"))).alias("gram"))
    counts = of_names.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = known.where("text is not null").select("pattern", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    rare = wanted.join(counts, "gram", "left").groupBy("pattern", "text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = of_names.join(rare, "gram").where("contains(low, text)").where("name rlike pattern").select("name", "pattern")
    rest = lower.join(known.where("text is null"), F.expr("name rlike pattern")).select("name", "pattern")
    return near.unionByName(rest).join(patterns, "pattern")
