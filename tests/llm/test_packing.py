from array import array
from collections import Counter, defaultdict
from zlib import crc32

import public_tokenizers
from tokenizers import Tokenizer

from labelwright.llm.packing import difference, pack_documents, sequences, windows

from .fixtures import no_documents, odd_documents, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs):
    wanted = Counter((i, tuple(plain_ids(t))) for i, t in rows)
    pieces = defaultdict(list)
    fill = defaultdict(list)
    for r in docs:
        pieces[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    got = Counter()
    for (doc_id, ids), n in wanted.items():
        for r in pieces[doc_id]:
            got[doc_id, r.doc_tokens] += r.length
            part = ids[r.start:r.start + r.length]
            if Counter(i for i, _ in rows)[doc_id] == 1:
                assert crc32(array("I", part).tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
    total = Counter()
    for (doc_id, ids), n in wanted.items():
        total[doc_id] += n * len(ids)
    assert total == Counter({d: sum(r.length for r in p) for d, p in pieces.items()})


def test_odd_rows(spark):
    check([r[:2] for r in odd_rows()], pack_documents(odd_documents(spark), PATH).collect())


def test_chunks_are_encoded_as_the_library_does():
    import random

    from labelwright.llm.packing import _encoder

    with open(PATH, encoding="utf-8") as file:
        encode = _encoder(file.read(), 1)
    rnd, model = random.Random(6), Tokenizer.from_file(PATH)
    signs = ["a", "B", "'s", "'LL", "don't", "3", "12", "é", "É", "e\u0301", "Σ", "ΑΣ", "İ", "ß", "日", "🙂", " ", "  ", "\n", "\t", "\x1c", "\x00", "\xa0",
             "\u2028", ".", ",", "!!", "''", "_", "<|endoftext|>", "<|", "½", "Ⅷ", "\u200b", "-", "x" * 70]
    for _ in range(4_000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 12)))
        assert encode(text) == array("I", [*model.encode(text, add_special_tokens=False).ids, 1]).tobytes(), repr(text)


def test_documents_with_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = pack_documents(docs, PATH).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    tokens, n = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert n * 2048 <= tokens * 1.03


def test_sequences_give_the_texts_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    packed = pack_documents(docs, PATH, with_ids=True).cache()
    whole = {r.sequence_id: r for r in sequences(packed, pad_id=7).collect()}
    for r in packed.collect():
        window = whole[r.sequence_id]
        assert window.ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
        assert len(window.ids) == 4 * (window.n_tokens if window.n_tokens & (window.n_tokens - 1) == 0 else 2048)


def test_differencing_is_near_equal_and_raises_the_count():
    parts = difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    assert sorted(map(sorted, difference([3, 3, 3], 4))) == [[], [0], [1], [2]]
    assert len(windows([6, 6, 6], 10)) == 3  # two windows would do by their sum
    assert windows([], 10) == []
    sizes = [(i * 7919) % 500 + 1 for i in range(2_000)]
    found = windows(sizes, 2048)
    assert sorted(i for p in found for i in p) == list(range(2_000))
    assert len(found) <= -(-sum(sizes) // 2048) + 2


def test_empty_table(spark):
    assert pack_documents(no_documents(spark), PATH).collect() == []
