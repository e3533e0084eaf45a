"""What the columns of an unknown layout hold, with everything masked that isn't laboratory vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from batchlens.functions.units import stripped

MASK, LONGEST, PROSE, ROWS = "█", 160, 24, 400
# The words of quality control and of column headers that may be shown.
WORDS = set(
    "blank blk cal calstd calblk calib calibration std standard ccv icv ccb icb cvb mb methodblank lcs lcsd dup duplicate ms msd spike matrix qc qcs rinse wash tune sample smp unk unknown "
    "level lvl check recovery rec serial dilution dil initial continuing verification start end begin final post pre low mid high top zero none na n/a true false yes no pass fail ok "
    "conc concentration cps counts intensity rsd sd mean avg average unit units isotope mass element analyte type name seq sequence id index no num time date istd is internal flag flags "
    "comment note acq acquired vial position pos rep replicate factor df result value data batch run method file".split()
)
# Units and gases that may be shown.
UNITS = set("ppb ppm ppt ppq mg/l µg/l ug/l ng/l mg/kg ug/kg ng/g ug/g mg/g % cps µg/g counts/s".split())
# Symbols and cell gases that may be shown in a cell with a digit.
SYMBOLS = set(
    "h he li be b c n o f ne na mg al si p s cl ar k ca sc ti v cr mn fe co ni cu zn ga ge as se br kr rb sr y zr nb mo tc ru rh pd ag cd in sn sb te i xe cs ba "
    "la ce pr nd pm sm eu gd tb dy ho er tm yb lu hf ta w re os ir pt au hg tl pb bi th u h2 o2 nh3 n2o".split()
)
# What a number may follow, and what may follow a number, in a code.
NUMBERED, MEASURED = "std lvl level l cal qc ccv".split(), "ppb ppm ppt mg/l ug/l %".split()
# The characters that part a cell into tokens, and those that may stand around a token.
SEPARATORS, ORNAMENT = " \t\n\r\f\v-_,;:()[]/\\|", " .'\"*#"
_CLASS = "".join("\\" + c if c in "-[]\\" else c for c in SEPARATORS)
_DIGITS = "0123456789"


def _of(text: Column, characters: str) -> Column:
    """Whether there is text, of these characters only."""
    return (text != "") & (F.translate(text, characters, "") == "")


def is_number(text: Column) -> Column:
    """Whether a cell reads as a number: an optional sign, digits with points and commas, and an optional exponent."""
    unsigned = lambda x: F.when(F.left(x, F.lit(1)).isin("+", "-"), F.substring(x, 2, 1 << 20)).otherwise(x)
    low = F.lower(text)
    front = F.substring_index(low, "e", 1)
    power = F.substring(low, F.length(front) + 2, F.lit(1 << 20))
    return _of(unsigned(front), _DIGITS + ".,") & (~low.contains("e") | _of(unsigned(power), _DIGITS))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once; an expression that is captured in a lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _two_words(t: Column) -> Column:
    """Whether a text is two words in one: some cut has a word on both sides."""
    words = sorted(w for w in WORDS if len(w) > 1)
    longest = max(map(len, words))
    cuts = F.sequence(F.lit(2), F.least(F.length(t) - 2, F.lit(longest)))
    both = F.exists(cuts, lambda i: F.left(t, i).isin(*words) & F.substring(t, i + 1, F.lit(longest + 1)).isin(*words))
    ends = F.left(t, F.lit(2)).isin(*sorted({w[:2] for w in words})) & F.right(t, F.lit(2)).isin(*sorted({w[-2:] for w in words}))  # most tokens end here
    return F.when(F.length(t).between(4, 2 * longest) & ends, both).otherwise(F.lit(False))


def _shown(token: Column, near_digit: Column, numbers: Column) -> Column:
    """Whether a token is vocabulary: a word, two words in one, a unit, a code, a symbol near a digit, or a number where those are shown."""

    def of(t: Column) -> Column:
        stem, tail = F.rtrim(t, F.lit(_DIGITS)), F.ltrim(t, F.lit(_DIGITS))
        code = ((stem != t) & stem.isin(*NUMBERED)) | ((tail != t) & tail.isin(*MEASURED))
        number = F.left(t, F.lit(1)).isin(*_DIGITS, *"+-.,") & is_number(t)
        return (t == "") | F.when(number, numbers).otherwise(t.isin(*sorted(WORDS | UNITS)) | (near_digit & (t.isin(*sorted(SYMBOLS)) | code)) | _two_words(t))

    return _let(F.btrim(F.lower(token), F.lit(ORNAMENT)), of)


def redacted(text: Column, numbers: Column | None = None, most: int | None = None) -> Column:
    """A cell with every token that isn't vocabulary masked; bare numbers are masked where ``numbers`` is false.

    With ``most``, only as many tokens are read as that many characters of the result can need.
    """
    numbers = F.length(text) <= PROSE if numbers is None else numbers
    head = text if most is None else F.regexp_extract(text, f"^(?:[{_CLASS}]*+[^{_CLASS}]*+){{0,{most + 1}}}", 0)
    pieces = F.regexp_extract_all(head, F.lit(f"[{_CLASS}]+|[^{_CLASS}]+"), F.lit(0))

    def masked(cell: Column) -> Column:
        kept = lambda p: (F.instr(F.lit(SEPARATORS), F.left(p, F.lit(1))) > 0) | _shown(p, cell["near"], cell["numbers"])
        return F.array_join(F.transform(cell["pieces"], lambda p: F.when(kept(p), p).otherwise(F.repeat(F.lit(MASK), F.least(F.length(p), F.lit(6))))), "")

    out = _let(F.struct(text.rlike("[0-9]").alias("near"), numbers.alias("numbers"), pieces.alias("pieces")), masked)
    return F.when(text.isNotNull(), out)


def clipped(text: Column) -> Column:
    """The first ``LONGEST`` characters, and a sign where there are more."""
    return F.when(F.length(text) > LONGEST, F.concat(F.left(text, F.lit(LONGEST)), F.lit(" …"))).otherwise(text)


def redacted_column(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and the column ``text``, redacted and clipped."""
    return rows.select(key, clipped(redacted(F.col(text), most=LONGEST)).alias("redacted"))


def column_profile(rows: DataFrame) -> DataFrame:
    """column, nonempty, numeric_share, distinct_values, kind (empty, numeric, categorical, text) of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), stripped(F.col(c).cast("string")).alias("v")) for c in rows.columns])
    v = F.nullif("v", F.lit(""))
    long = rows.select(F.inline(pairs)).groupBy("column").agg(F.count(v).alias("nonempty"), F.count_if(is_number(F.col("v"))).alias("m"), F.count_distinct(v).alias("distinct_values"))
    share = F.try_divide(F.col("m").cast("double"), F.col("nonempty"))
    kind = F.when(F.col("nonempty") == 0, "empty").when(F.col("m") > 0.5 * F.col("nonempty"), "numeric").when(F.col("distinct_values") <= 15, "categorical").otherwise("text")
    return long.select("column", "nonempty", F.round(share, 6).alias("numeric_share"), "distinct_values", kind.alias("kind"))


def fingerprint(cells: DataFrame, include_names: bool = False, head: int = 3) -> dict:
    """The layout of one file's cells (row, col, value): its header and what each column holds, redacted.

    At most ``ROWS`` rows are read; values of numeric columns are never shown.
    """
    some = cells.where(F.col("row") <= ROWS).persist()
    v = F.nullif(stripped(F.col("value")), F.lit(""))
    shown = v if include_names else F.left(redacted(v), F.lit(LONGEST))
    header = {r["col"]: r["name"] for r in some.where("row = 0").select("col", F.coalesce(redacted(F.col("value"), F.lit(True)), F.lit("")).alias("name")).collect()}
    body = some.where("row > 0").groupBy("col").agg(F.count(v).alias("n"), F.count_if(is_number(v)).alias("m"), F.array_sort(F.collect_set(F.struct(v.alias("raw"), shown.alias("shown")))).alias("values"))
    columns = []
    for r in sorted(body.collect(), key=lambda r: r["col"]):
        values = [x["shown"] for x in r["values"] if x["raw"] is not None]
        kind = "empty" if not r["n"] else "numeric" if r["m"] > 0.5 * r["n"] else "categorical" if len(values) <= 15 else "text"
        columns.append({"col": r["col"], "name": header.get(r["col"], ""), "kind": kind, "nonempty": r["n"], "values": [] if kind in ("empty", "numeric") else values[: 12 if kind == "categorical" else 4]})
    first = some.where(F.col("row") < head).select("row", "col", F.left(F.coalesce(redacted(F.col("value"), F.lit(False)), F.lit("")), F.lit(LONGEST)).alias("value")).orderBy("row", "col").collect()
    rows: dict[int, list[str]] = {}
    for r in first:
        rows.setdefault(r["row"], []).append(r["value"])
    return {"n_columns": len(columns), "sub_header": looks_like_sub_header(some), "head": list(rows.values()), "columns": columns}


def looks_like_sub_header(cells: DataFrame) -> bool:
    """Whether row 1 is a second header: hardly any number in it, and some column of numbers below it."""
    v = F.nullif(stripped(F.col("value")), F.lit(""))
    number = is_number(v).cast("double")
    first = cells.where("row = 1").agg(F.avg(number)).first()[0]
    below = cells.where("row between 2 and 39").groupBy("col").agg(F.avg(number).alias("s")).agg(F.max("s")).first()[0]
    return first is not None and first < 0.2 and (below or 0.0) > 0.5


def ambiguous_types(samples: DataFrame, most_rows: int = 24, most_share: float = 0.3) -> DataFrame:
    """type_text, names: the first distinct sample names of each rare type string, for a person to resolve."""
    n = samples.count()
    sizes = samples.groupBy("type_text").count().where((F.col("count") <= most_rows) & (F.col("count") <= most_share * n))
    first = W.partitionBy("type_text", "name").orderBy("row_pos")
    rows = samples.join(sizes, "type_text").withColumn("i", F.row_number().over(first)).where("i = 1")
    return rows.groupBy("type_text").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_pos", "name"))), lambda x: x["name"]).alias("names"))


def draft_template(cells: DataFrame, drafter: Callable[[str], str]) -> str:
    """Template YAML drafted from a redacted fingerprint; ``drafter`` turns a request into text (no model comes with this package)."""
    request = "Draft a layout template in YAML for this export:\n" + json.dumps(fingerprint(cells), ensure_ascii=False, indent=1)
    text = drafter(request)
    fenced = re.search(r"```(?:ya?ml)?\s*\n(.*?)```", text, re.S)
    return (fenced[1] if fenced else text).strip() + "\n"


def merge_fragment(template: dict, fragment: dict) -> dict:
    """A template with the entries of a fragment added; what the template says stays."""
    out = dict(template)
    for key, value in fragment.items():
        out[key] = merge_fragment(value, out[key]) if isinstance(value, dict) and isinstance(out.get(key), dict) else out.get(key, value)
    return out
