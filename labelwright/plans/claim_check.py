"""Find numbers in documents that no recorded result supports."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK
from ..session import pin

# --- Fixed values: patterns ---------------------------------------------------------------
FRONT_MATTER = r"(?s)\A---.*?\n---"
CODE_FENCE = r"(?s)```.*?```"
URL = r"https?://[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LINK = r"\[([^\]]*)\]\([^)]*\)"
HEX_HASH = r"(?U)\b[0-9a-f]{12,64}\b"
_WORD = r"\p{L}\p{N}_"
NUMBER = (
    rf"(?<![{_WORD}.\-/])-?\p{{Nd}}[\p{{Nd}},]*(?:\.\p{{Nd}}+)?(?:[eE]-?\p{{Nd}}+)?(?![{_WORD}/])"
)
# --- end of fixed values ------------------------------------------------------------------


def clean_markup(text: Column) -> Column:
    """Without front matter, fenced code, URLs, link targets and long hex hashes."""
    body = F.regexp_replace(text, FRONT_MATTER, "")
    body = F.regexp_replace(body, CODE_FENCE, " ")
    body = F.regexp_replace(body, URL, " ")
    body = F.regexp_replace(body, LINK, "$1")
    return F.regexp_replace(body, HEX_HASH, " ")


def number_tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, line_no, token, percent`` for every number of every line (lines from 1)."""
    lines = docs.select(doc, F.posexplode(F.split(F.col(text), LINE_BREAK, -1)).alias("_i", "_line"))
    found = F.regexp_extract_all(F.col("_line"), F.lit(f"(?:{NUMBER})%?"), F.lit(0))
    each = lines.filter(F.regexp_like("_line", F.lit(r"\p{Nd}"))).select(
        doc, (F.col("_i") + 1).alias("line_no"), F.explode(found).alias("_t"))
    return each.select(doc, "line_no", F.rtrim(F.col("_t"), F.lit("%")).alias("token"),
                       F.col("_t").endswith("%").alias("percent"))


def plain_token(token: Column) -> Column:
    """The token without thousands separators."""
    return F.replace(token, F.lit(","), F.lit(""))


def printed(value: Column) -> Column:
    """C-style prints of a double: shortest, 1-2 exponent digits, 0-4 decimals, millionths.

    Done in Python on distinct values only: decimal rounding there follows the exact binary
    value, which the JVM's formatter does not.
    """
    styles = {"e1": ".1e", "e2": ".2e", "f0": ".0f", "f1": ".1f", "f2": ".2f", "f3": ".3f", "f4": ".4f"}

    @F.pandas_udf("r string, " + ", ".join(f"{k} string" for k in styles) + ", u2 string, u3 string")
    def prints(values: pd.Series) -> pd.DataFrame:
        known = [None if x is None or x != x else float(x) for x in values.tolist()]
        columns = {"r": [None if x is None else repr(x) for x in known]}
        for name, style in styles.items():
            columns[name] = [None if x is None else format(x, style) for x in known]
        for name, style in (("u2", ".2f"), ("u3", ".3f")):
            columns[name] = [None if x is None else format(x * 1e6, style) for x in known]
        return pd.DataFrame(columns)

    return prints(value)


def value_forms(value: Column, micro: bool = True) -> Column:
    """The spellings in a text that a stored number backs.

    The fewer digits a spelling has, the more stored numbers it would fit, so what is offered goes by size: the number as stored always;
    from a thousandth on three and four decimals, from one on also one and two, and none for whole numbers; nearer to zero, where
    decimals tell numbers apart no longer, exponents with one and two digits, and with ``micro`` millionths where there is one at least.
    """
    p, size, none = printed(value), F.abs(value), F.array().cast("array<string>")
    near_zero = (size > 0) & (size < 1e-3)
    offered = [
        (F.lit(True), ("r",)),
        (near_zero, ("e1", "e2")),
        (near_zero & F.lit(micro) & (size * F.lit(1e6) >= 1), ("u2", "u3")),
        (~near_zero, ("f3", "f4")),
        (~near_zero & (size >= 1), ("f1", "f2")),
        ((value % 1 == 0) & (size < float("inf")), ("f0",)),
    ]
    return F.array_distinct(F.concat(*[F.when(holds, F.array(*[p[k] for k in styles])).otherwise(none) for holds, styles in offered]))


def token_forms(token: Column, percent: Column | None = None, micro: bool = True) -> Column:
    """Spellings under which a document's token counts as backed."""
    text = plain_token(token)
    value = text.try_cast("double")
    none = F.array().cast("array<string>")
    exponent = F.contains(F.lower(text), F.lit("e"))
    # a whole number of any length: its text without leading zeros
    whole = F.regexp_like(text, F.lit(r"^-?[0-9]+$"))
    bare = F.regexp_replace(F.regexp_replace(text, r"^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    forms = F.concat(
        F.array(text),
        F.when(whole, F.array(bare)).otherwise(none),
        F.when(exponent & value.isNotNull(), value_forms(value, micro)).otherwise(none))
    if percent is not None:
        share = printed(value / 100)
        forms = F.concat(forms, F.when(percent & value.isNotNull(), F.array(share["f3"], share["f4"])).otherwise(none))
    return F.array_distinct(forms)


def json_leaves(reports: DataFrame, json: str) -> DataFrame:
    """Distinct leaves (key, kind, text) of a JSON text column: containers are opened level by level until none is left.

    ``key`` is that of the entry that holds the leaf, null in arrays; ``kind`` the type the parser gave it. Malformed texts
    have no leaves (see :func:`malformed`). The deepest document decides the number of passes.
    """
    level = reports.select(F.lit(None).cast("string").alias("key"), F.try_parse_json(json).alias("value")).filter("value IS NOT NULL")
    leaves = None
    while True:
        kind = F.schema_of_variant("value")
        container = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        found = level.filter(~container).select("key", kind.alias("kind"), F.col("value").cast("string").alias("text")).distinct()
        leaves = found if leaves is None else leaves.unionByName(found)
        inner = level.filter(container).select("value").alias("outer")
        opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("outer.value").outer()).alias("inner"))
        level = pin(opened.select(F.col("inner.key").alias("key"), F.col("inner.value").alias("value")))
        if level.isEmpty():
            return leaves.distinct()


def malformed(reports: DataFrame, json: str) -> DataFrame:
    """The rows whose text is not JSON: a report that cannot be read backs nothing, and should be looked at."""
    return reports.filter(F.col(json).isNotNull() & F.try_parse_json(json).isNull())


def known_numbers(reports: DataFrame, json: str) -> DataFrame:
    """Distinct spellings (``form``) backed by the numeric leaves of a JSON text column.

    Leaves are found at any depth; booleans are not leaves, and of strings only the text of a
    ``"value"`` entry counts. Integers back only their own spelling, fractions all of
    :func:`value_forms`.
    """
    leaf = pin(json_leaves(reports, json))
    kind, text = F.col("kind"), F.col("text")
    # whole numbers beyond 64 bits are decimals of more digits than a fraction's text keeps
    digits = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int")
    whole = (kind == "BIGINT") | F.coalesce(digits > 18, F.lit(False))
    fraction = ~whole & (F.startswith(kind, F.lit("DECIMAL")) | kind.isin("DOUBLE", "FLOAT"))
    plain = leaf.filter(whole).select(text.alias("form"))
    spelled = leaf.filter(fraction).select(F.explode(value_forms(text.try_cast("double"))).alias("form"))
    edited = leaf.filter((kind == "STRING") & (F.col("key") == "value") & (text != "")).select(F.explode(token_forms(text)).alias("form"))
    return plain.union(spelled).union(edited).distinct()


def allowlist_numbers(lines: DataFrame, line: str) -> DataFrame:
    """Spellings backed by an allow-list (one number per line, ``#`` starts a comment)."""
    value = F.trim(F.substring_index(F.col(line), "#", 1))
    return lines.select(value.alias("v")).filter("v != ''").select(
        F.explode(token_forms(F.col("v"), micro=False)).alias("form")).distinct()


def unsupported_claims(tokens: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """Tokens none of whose spellings is known, with the number of places they occur.

    Tokens are reduced to distinct ones before the look-up, so a number repeated in a third
    of all lines is looked up once.
    """
    counted = pin(tokens.groupBy(doc, "token", "percent").agg(
        F.count("*").alias("places"), F.min("line_no").alias("first_line")))
    distinct = counted.select("token", "percent").distinct()
    spelled = distinct.select("token", "percent", F.explode(token_forms(F.col("token"), F.col("percent"))).alias("form"))
    backed = spelled.join(known.select("form"), "form", "left_semi").select("token", "percent").distinct()
    return counted.join(backed, ["token", "percent"], "left_anti").select(doc, "token", "percent", "places", "first_line")
