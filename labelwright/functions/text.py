"""Column expressions over record texts (newline-joined ``Field: value`` lines).

All expressions are JVM-side built-ins. Single-line edits use position arithmetic on the
text instead of splitting it, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters Unicode counts as white space (what a Unicode-aware strip removes).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_REST = 2**31 - 1
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def clean_value(value: Column, missing: str = "None", *, floating: bool = False) -> Column:
    """Trimmed text of a value; null, blank (and NaN when ``floating``) become ``missing``."""
    text = blank_to_null(value.cast("string"))
    if floating:
        text = F.when(~F.isnan(value), text)
    return F.coalesce(text, F.lit(missing))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The part before the first colon (the whole line when there is none), not trimmed."""
    return F.substring_index(line, ":", 1)


def entries(text: Column) -> Column:
    """``array<struct<key,value>>`` of the lines that hold a colon, both sides trimmed."""
    with_colon = F.filter(text_lines(text), lambda ln: ln.contains(":"))
    return F.transform(
        with_colon,
        lambda ln: F.struct(
            strip(line_key(ln)).alias("key"),
            strip(F.substring(ln, F.position(F.lit(":"), ln) + F.lit(1), F.length(ln))).alias("value"),
        ),
    )


def keys_from_end(pairs: Column) -> Column:
    """The keys of ``entries``, last line first."""
    return F.reverse(F.transform(pairs, lambda e: e["key"]))


def last_wins_map(pairs: Column, from_end: Column) -> Column:
    """``map<string,string>`` in which a repeated key keeps its last value.

    ``pairs`` and ``from_end`` must be staged columns: both are read once per line.
    """
    kept = F.filter(pairs, lambda e, i: i == F.size(pairs) - F.array_position(from_end, e["key"]))
    return F.map_from_entries(kept)


def field_count(text: Column) -> Column:
    return F.size(F.array_distinct(F.transform(entries(text), lambda e: e["key"])))


#: White space within a line, in a pattern with Unicode classes switched on.
_BLANKS = r"[\s\x1c-\x1f&&[^\n]]*"


def after_line(text: Column, name: str) -> Column:
    """What follows the last line start ``name:``, or the framed text. Stage it as a column for :func:`last_line_tail`."""
    return F.substring_index(F.concat(F.lit("\n"), text), f"\n{name}:", -1)


def last_line_tail(text: Column, name: str, after: Column | None = None) -> Column:
    """``:value`` of the last ``name`` line, untrimmed; the empty text when absent.

    Where the name stands at the start of its line, followed by the colon, and not again behind it (``after``, a staged
    :func:`after_line`), its value is cut out; a text without the name has no such line. All others are matched by one pattern, from the
    end of the text. Stage the tail as a column before reading it with :func:`tail_value` more than once.
    """
    matched = F.regexp_extract(text, rf"(?sU)\A(?:.*\n)?{_BLANKS}\Q{name}\E{_BLANKS}(:[^\n]*)", 1)
    if after is None:
        return matched
    found = F.octet_length(after) <= F.octet_length(text)
    return (F.when(found & ~F.contains(after, F.lit(name)), F.concat(F.lit(":"), F.substring_index(after, "\n", 1)))
            .when(~F.contains(text, F.lit(name)), "").otherwise(matched))


def tail_value(tail: Column) -> Column:
    """Trimmed value of a :func:`last_line_tail`; null when the field is absent."""
    return F.when(tail != "", strip(F.substring(tail, F.lit(2), F.lit(_REST))))


def answer_label(raw: Column, target: str) -> Column:
    """0/1 of a well-formed answer at the very start of the text, else null (never 0)."""
    quoted = "\\Q" + target + "\\E"
    matched = F.regexp_extract(raw, rf"(?U)\A[\s\x1c-\x1f]*{quoted}:[\s\x1c-\x1f]*([01])\b", 1)
    # the two plain answers are told by comparison
    return F.when(raw == f"{target}: 1", 1).when(raw == f"{target}: 0", 0).otherwise(
        F.get(F.array(F.lit(0), F.lit(1)), F.ascii(matched) - F.lit(ord("0"))))


def output_lines(raw: Column) -> Column:
    """The trimmed, non-blank lines of a model output."""
    return F.filter(F.transform(F.split(raw, LINE_BREAK, -1), strip), lambda ln: ln != "")


def without_speaker(lines: Column) -> Column:
    """Lines joined, without a leading ``assistant...`` line (stage ``lines`` as a column)."""
    first = F.lower(F.try_element_at(lines, F.lit(1)))
    body = F.when(first.startswith("assistant"), F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)
    return F.array_join(body, "\n")


# ------------------------------------------------------------------------------- edits
def framed(text: Column) -> Column:
    """The text between two newlines, so that every line starts and ends with one."""
    return F.concat(F.lit("\n"), text, F.lit("\n"))


def line_start(framed_text: Column, name: Column) -> Column:
    """Position of the first ``name: `` line in the text (from 1); 0 when absent."""
    return F.position(F.concat(F.lit("\n"), name, F.lit(": ")), framed_text)


def set_at(text: Column, framed_text: Column, at: Column, name: Column, value: Column) -> Column:
    """The text with the ``name`` line at ``at`` set to a value; null when ``at`` is 0."""
    end = F.position(F.lit("\n"), framed_text, at + F.lit(1)) - F.lit(1)
    return F.when(at > 0, F.concat(
        F.substring(text, F.lit(1), at - F.lit(1)), name, F.lit(": "), value, F.substring(text, end, F.lit(_REST))))


def cut_at(text: Column, framed_text: Column, at: Column, name: str) -> Column:
    """The text before and after the value of the ``name`` line at ``at``, as a struct; null when ``at`` is 0."""
    end = F.position(F.lit("\n"), framed_text, at + F.lit(1)) - F.lit(1)
    return F.when(at > 0, F.struct(
        F.concat(F.substring(text, F.lit(1), at - F.lit(1)), F.lit(f"{name}: ")).alias("head"),
        F.substring(text, end, F.lit(_REST)).alias("tail")))


def rename_at(text: Column, at: Column, name: Column, new: Column) -> Column:
    """The text with the line at ``at`` renamed, its value untouched; null when ``at`` is 0."""
    return F.when(at > 0, F.concat(
        F.substring(text, F.lit(1), at - F.lit(1)), new, F.substring(text, at + F.length(name), F.lit(_REST))))


def rename_line(text: Column, name: Column, new: Column) -> Column:
    """Rename the first ``name: `` line; its value stays as it is."""
    return rename_at(text, line_start(framed(text), name), name, new)


def drop_lines(text: Column, names: Sequence[str] | Column) -> Column:
    """Remove every line whose key (not trimmed) is one of ``names``."""
    if isinstance(names, Column):
        return F.array_join(F.filter(text_lines(text), lambda ln: line_key(ln) != names), "\n")
    return F.array_join(F.filter(text_lines(text), lambda ln: ~line_key(ln).isin(*names)), "\n")


def keyed_lines(text: Column) -> Column:
    """``array<struct<key,line>>`` of the lines that hold a colon, keys not trimmed."""
    with_colon = F.filter(text_lines(text), lambda ln: ln.contains(":"))
    return F.transform(with_colon, lambda ln: F.struct(line_key(ln).alias("key"), ln.alias("line")))


def reorder_lines(keyed: Column, order: Column) -> Column:
    """Lines in ``order``; null unless ``order`` names exactly the keys present.

    ``keyed`` must be a staged column of :func:`keyed_lines`: it is read once per field.
    """
    return F.array_join(picked_lines(keyed, order), "\n")


def picked_lines(keyed: Column, order: Column) -> Column:
    """The lines of :func:`reorder_lines` as an array."""
    keys = F.transform(keyed, lambda e: e["key"])
    same = (F.size(F.array_except(keys, order)) == 0) & (F.size(F.array_except(order, keys)) == 0)
    picked = F.transform(
        order, lambda k: F.try_element_at(F.filter(keyed, lambda e: e["key"] == k), F.lit(-1))["line"])
    return F.when(same, picked)


def append_line(text: Column, line: Column) -> Column:
    return F.concat(text, F.lit("\n"), line)
