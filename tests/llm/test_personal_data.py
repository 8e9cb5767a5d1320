import hashlib
import re
from collections import Counter

import pytest

from labelwright.llm.personal_data import find_personal_data, finder, personal_data_digest, redact

from .fixtures import SCHEMA, no_documents, odd_documents, odd_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    "mail a.b+c@x-y.co.uk, a@b, a@b.c@d.e x@@y.z .@-.- @a.b a@b.", "1.2.3.4.5.6.7.8 999.1.1.1 255.255.255.255 01.002.0003.4 1.2.3 1.2.3.256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 1 2 3 4111  1111", "+49 (0)30 1234567 +1-2 +1234567890123456 ++4912345678 +4 +12.34.56.78.90 9",
    "x" * 50 + "@" + "y" * 50 + ".z" * 50, "1 " * 400, "9" * 5_000, "ärger@müller.de é1.2.3.4é ٣٤@x.y", "a@b.c,d@e.f;1-1-1-1",
    "see HTTPS://Example.com/a?b=c. and mailto:me@x.org (http://a.b/c), http://nohost ftp://x.y:21/z",
    "IBAN: DE89 3704 0044 0532 0130 00 and account no. 12345678 Konto 12-34-56 iban XX00 1234 accounted 123456", "4111111111111111@x.y +49.1.2.3.4567"]


def all_texts():
    return TEXTS + [r[1] or "" for r in odd_rows()]


@pytest.mark.parametrize("text", all_texts(), ids=range(len(all_texts())))
def test_base_spans_equal_the_patterns(text):
    assert [s for s in finder()(text) if s[0] in PATTERNS] == base(text)


def test_random_texts_equal_the_patterns():
    import random

    rnd, find = random.Random(1), finder()
    for _ in range(4_000):
        text = "".join(rnd.choice("a1@.+- ()2é9\n") for _ in range(rnd.randint(0, 60)))
        assert [s for s in find(text) if s[0] in PATTERNS] == base(text), text


def test_addresses_and_accounts():
    find = finder()
    got = [(k, TEXTS[9][a:b]) for k, a, b in find(TEXTS[9]) if k not in PATTERNS]
    assert got == [("url", "HTTPS://Example.com/a?b=c"), ("url", "http://a.b/c"), ("url", "ftp://x.y:21/z")]
    got = [TEXTS[10][a:b] for k, a, b in find(TEXTS[10]) if k == "account"]
    assert got == ["DE89 3704 0044 0532 0130 00", "12345678", "12-34-56"]


def test_digest_of_odd_rows_and_documents(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for docs in (odd_documents(spark), table):
        want = Counter()
        for r in docs.collect():
            spans = base(r.text or "")
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            n = Counter(k for k, _, _ in spans)
            want[r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(said.encode()).hexdigest()] += 1
        got = personal_data_digest(find_personal_data(docs)).collect()
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want


def test_redaction_keeps_all_columns(spark):
    rows = [(1, "a@b.c and 1.2.3.4", "en", "s", 17, "T", None, 5), (None, None, None, None, None, None, None, None), (2, "clean", "en", "s", 99, None, "k", 1)]
    done = redact(spark.createDataFrame(rows, SCHEMA))
    assert done.columns == SCHEMA.names
    got = sorted(map(tuple, done.collect()), key=str)
    assert got == sorted([(1, "<email> and <ip>", "en", "s", 16, "T", None, 5), rows[1], rows[2]], key=str)


def test_empty_table(spark):
    assert find_personal_data(no_documents(spark)).collect() == []
    assert redact(no_documents(spark)).collect() == []
