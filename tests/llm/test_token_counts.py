from collections import Counter

import public_tokenizers
import sentencepiece

from labelwright.llm.token_counts import token_counts

from .fixtures import no_documents, odd_documents, odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def expected(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = Counter()
    for doc_id, text in rows:
        n = len(model.encode(text or ""))
        out[doc_id, len((text or "").encode()), n, n > 40] += 1
    return out


def test_odd_rows_at_any_head(spark):
    want = expected([r[:2] for r in odd_rows()])
    for head in (0, 5, 100_000):
        got = Counter(tuple(r) for r in token_counts(odd_documents(spark), MODEL, limit=40, head=head).collect())
        assert got == want


def test_no_piece_crosses_a_pretoken():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        assert "\n" not in piece and "▁" not in piece.lstrip("▁")


def test_documents_match_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.n_tokens > 40) for r in token_counts(docs, MODEL, head=300).collect())
    assert got == want


def test_empty_table(spark):
    assert token_counts(no_documents(spark), MODEL).collect() == []
