import hashlib
import random
from array import array
from collections import Counter
from time import process_time

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from labelwright.llm.byte_bpe import (ROWS, _blocks, _chunker, cut_block, decode_documents, encode_documents, encoding_digest, fold_merges, merge_long,
                                      merge_many, merge_short, pair_table, read_ranks)

from .fixtures import no_documents, odd_documents, odd_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def digest(docs, **options):
    coded = decode_documents(encode_documents(docs, PATH, public_tokenizers.PATTERN, **options), PATH)
    return Counter(tuple(r) for r in encoding_digest(coded).collect())


def expected(rows, library):
    out = Counter()
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        out[i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    return out


def test_odd_rows_at_any_head(spark, library):
    want = expected([r[:2] for r in odd_rows()], library)
    for head in (0, 10, 10_000):
        assert digest(odd_documents(spark), head=head) == want


def test_documents_match_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    assert digest(docs, head=2_000) == expected([(r.doc_id, r.text) for r in docs.collect()], library)


def test_white_space_and_random_characters(spark, library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab é日1.'s\t\n\x1c\x85\xa0 ​　\U0001f642 ") for _ in range(rnd.randint(1, 40))) for _ in range(600)]
    rows = list(enumerate(texts))
    assert digest(spark.createDataFrame(rows, "doc_id int, text string"), head=50) == expected(rows, library)


def test_merges_of_single_words(library):
    rnd, ranks = random.Random(4), read_ranks(PATH)
    for n in (1, 2, 3, 50, 3_000):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "é日語🙂"):
            word = "".join(rnd.choice(letters) for _ in range(n))
            want = library._encode_single_piece(word.encode())
            assert merge_long(word.encode(), ranks) == want == merge_short(word.encode(), ranks)


def test_the_fold_equals_the_library_on_every_word(spark, sf, library):
    import regex
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    words = sorted({w for r in rows + [type("R", (), {"text": t[1]}) for t in odd_rows()] for w in regex.findall(public_tokenizers.PATTERN, r.text or "")
                    if len(w) < 200})
    encode = fold_merges(read_ranks(PATH))
    got = spark.createDataFrame([(w,) for w in words], "w string").repartition(8).select("w", encode(F.encode("w", "UTF-8")).alias("ids")).collect()
    assert {r.w: list(r.ids) for r in got} == {w: library._encode_single_piece(w.encode()) for w in words}


def test_empty_table(spark):
    assert digest(no_documents(spark)) == Counter()


def test_many_words_are_merged_together_as_one_by_one(library):
    rnd, ranks = random.Random(8), read_ranks(PATH)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 15))).encode()
             for letters in ("ab", "etaoinshr", "é日語🙂", "\x00\x7f ") for _ in range(1_500)]
    table = pair_table(ranks)
    assert [list(array("I", ids)) for ids in merge_many(words, table)] == [merge_short(w, ranks) if w not in ranks else
                                                                         library._encode_single_piece(w) for w in words]
    assert merge_many([], table) == []


def test_blocks_are_cut_where_the_pattern_never_crosses():
    texts = ["", " ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "\n a b", "  ", " a b  ", "a\x85 b", "a\nb c", None, "It's a b b"]
    chunks, inside = _chunker(public_tokenizers.PATTERN)
    column = pa.array(texts * 3, pa.string()).slice(4)
    at = 0
    for block in _blocks(column):
        found, index, edges = cut_block(block, chunks)
        for a, z in zip(edges, edges[1:]):
            text = column[at].as_py() or ""
            cut = [found[k] for k in index[a:z]]
            assert "".join(cut) == text and [w for c in cut for w in inside(c)] == inside(text)
            at += 1
    assert at == len(column)


def test_encoding_and_decoding_many_rare_words_take_little_time(spark):
    """Rarer words were merged one by one, at 23 microseconds each."""
    ranks, rnd = read_ranks(PATH), random.Random(9)
    words = sorted({bytes(rnd.choices(b"etaoinshrdlu", k=10)) for _ in range(30_000)} - set(ranks))
    table = pair_table(ranks)
    start = process_time()
    many = merge_many(words, table)
    middle = process_time()
    assert many == [array("I", merge_short(w, ranks)).tobytes() for w in words]
    assert middle - start < process_time() - middle


def test_texts_reach_the_workers_in_small_batches(spark, library):
    """All of a task's texts, 10,000 rows at most, were one batch, which the JVM and two workers held at a time."""
    rows = [(i, f"row {i} of many") for i in range(2 * ROWS + 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert digest(docs, head=0) == expected(rows, library)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    assert max(r.n for r in docs.mapInArrow(sizes, "n bigint").collect()) <= ROWS
