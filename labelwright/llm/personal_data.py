"""Personal data in texts, found by expanding anchors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take, unpack_row, with_row

#: Kinds in the order in which spans are listed; the first four have a fixed pattern.
KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Schemes that start an address, and cues in front of an identifier.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")


def finder():
    """A function from a text to its spans ``[(kind, start, end), ...]``, sorted by kind and start.

    One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, schemes and cues. Every
    anchor has a parser that expands it to both sides and checks what it found. Spans of a kind do
    not overlap; a failed check ends in no span and no second try from inside it.

    * email: local characters left of an at-sign, dotted labels right of it.
    * ip: four dotted numbers of at most 255.
    * card: 13 to 19 digits, single blanks or hyphens between them, with a right Luhn sum.
    * phone: a plus sign, then 9 to 15 digits among blanks, brackets, dots and hyphens.
    * url: a scheme and a host with a dot, up to white space or a quote; an address behind ``mailto:``
      stays an email.
    * account: behind a cue and at most three separators, an IBAN with a right check number, or 6 to
      20 digits with hyphens.
    """
    import re
    import string

    import ahocorasick

    anchors = ahocorasick.Automaton()
    for sign in ("@", "+", *string.digits):
        anchors.add_word(sign, (sign if sign in "@+" else "digit", 1))
    for scheme in SCHEMES:
        anchors.add_word(scheme, ("scheme", len(scheme)))
    for cue in CUES:
        anchors.add_word(cue, ("cue", len(cue)))
    anchors.make_automaton()
    lower = {ord(c): c.lower() for c in string.ascii_uppercase}
    local = frozenset(string.ascii_letters + string.digits + "._%+-")
    labels = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
    dotted = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
    grouped = re.compile(r"[0-9](?:[ -]?[0-9])+").match
    dialled = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
    address = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?").match
    apart = re.compile(r"(?: ?(?:number|no|nr)\b\.?)?[ :#=]{1,3}", re.IGNORECASE).match
    iban = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}").match
    digits = re.compile(r"[0-9](?:-?[0-9]){5,19}(?![0-9-])").match
    only = re.compile("[^0-9]+")

    def luhn(number: str) -> bool:
        odd = sum(map(int, number[-1::-2]))
        return (odd + sum(sum(divmod(2 * int(d), 10)) for d in number[-2::-2])) % 10 == 0

    def iban_end(text: str, at: int) -> int:
        """Where an IBAN from ``at`` ends, or -1: the longest run of whole words with a right check number."""
        found = iban(text, at)
        if not found:
            return -1
        ends = [i for i in range(at + 15, found.end() + 1) if i == len(text) or not text[i].isalnum()]
        for end in reversed(ends):
            plain = text[at:end].replace(" ", "").upper()
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return end
        return -1

    def spans(text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list] = {k: [] for k in KINDS}
        done = dict.fromkeys(KINDS, 0)  # where the last match of a kind ended, failed checks included
        number = 0  # where the run of digits being read ends
        for last, (anchor, size) in anchors.iter(text.translate(lower)):
            at = last - size + 1
            if anchor == "digit":
                if at < number:
                    continue
                number = at + 1
                while number < len(text) and "0" <= text[number] <= "9":
                    number += 1
                if at >= done["ip"] and (m := dotted(text, at)):
                    done["ip"] = m.end()
                    if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                        found["ip"].append((at, m.end()))
                if at >= done["card"] and (m := grouped(text, at)):
                    done["card"] = m.end()
                    plain = only.sub("", m.group()) if m.end() - at <= 40 else ""
                    if 13 <= len(plain) <= 19 and luhn(plain):
                        found["card"].append((at, m.end()))
            elif anchor == "@":
                start = at
                while start > done["email"] and text[start - 1] in local:
                    start -= 1
                if start < at and (m := labels(text, at + 1)):
                    done["email"] = m.end()
                    found["email"].append((start, m.end()))
            elif anchor == "+":
                if at >= done["phone"] and (m := dialled(text, at)):
                    done["phone"] = m.end()
                    if 9 <= len(only.sub("", m.group())) <= 15:
                        found["phone"].append((at, m.end()))
            elif anchor == "scheme":
                if at >= done["url"] and text[last] == "/" and (m := address(text, last + 1)):
                    done["url"] = m.end()
                    found["url"].append((at, at + len(text[at:m.end()].rstrip(".,;:!?)"))))
            elif at >= done["account"] and not (at and text[at - 1].isalnum()) and (gap := apart(text, last + 1)):
                end = iban_end(text, gap.end())
                if end < 0 and (m := digits(text, gap.end())):
                    end = m.end()
                if end > 0:
                    done["account"] = end
                    found["account"].append((gap.end(), end))
        return [(k, a, b) for k in KINDS for a, b in found[k]]

    return spans


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``found``, an array of (kind, start, end) in code points.

    Whole texts are read; null is empty. Rows that repeat or have a null id are rows like others.
    An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[docs.columns.index(id_col)].dataType.simpleString()

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans = finder()
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, struct)], names=["doc_id", "found"])

    rows = take(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(find, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>")


def personal_data_digest(found: DataFrame) -> DataFrame:
    """doc_id, a count of each fixed kind, base_sha256 and spans, from the rows of ``find_personal_data``."""
    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    base = KINDS[:4]
    return found.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base],
                        F.sha2(said(of(*base)).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets.

    Overlapping spans become one, named by the span that starts first, then by the order of
    ``KINDS``. A null text stays null. ``length_col``, where given and present, is set to the new number of code points
    of texts that changed. All columns are kept, also those that share a name.
    """
    names, types = docs.columns, [f.dataType.simpleString() for f in docs.schema.fields]

    def replace(batches: Iterator) -> Iterator:
        import pyarrow as pa

        spans, rank = finder(), {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            out, n = [], []
            for text in batch.column(0).to_pylist():
                parts, at = [], 0
                for a, b, kind in sorted(((a, b, k) for k, a, b in spans(text)), key=lambda s: (s[0], rank[s[2]])) if text else ():
                    if a >= at:
                        parts += [text[at:a], f"<{kind}>"]
                    at = max(at, b)
                out.append("".join(parts) + text[at:] if parts else text)
                n.append(len(out[-1]) if parts else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int64()), batch.column(1)], names=["_text", "_n", "_row"])

    inner = ",".join(f"_{i}:{t}" for i, t in enumerate(types))
    done = with_row(docs, text_col).toDF("_text", "_row").mapInArrow(replace, f"_text string, _n bigint, _row struct<{inner}>")
    row = unpack_row(done.select("_row", "_text", "_n").withColumn("_row", _changed(names, types, text_col, length_col)), names)
    return row


def _changed(names, types, text_col, length_col):
    def cell(i, name):
        old = F.col("_row")[f"_{i}"]
        if i == names.index(text_col):
            return F.col("_text")
        if length_col in names and i == names.index(length_col):
            return F.coalesce(F.col("_n").cast(types[i]), old)
        return old

    return F.struct(*[cell(i, n).alias(f"_{i}") for i, n in enumerate(names)])
