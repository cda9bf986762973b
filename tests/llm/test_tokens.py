from __future__ import annotations

import os

import pytest

from tessera.llm.tokens import PIECE_CHARS, TOKENIZER, TOKENIZER_DIR, count_tokens, encoder, pieces

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/{TOKENIZER}"), reason="no tokenizer files")


def test_counts(spark):
    texts = [None, "", "Guten Morgen, Dortmund!", "a " * 120_000, "x" * 30_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, tokens string")
    got = {r["doc_id"]: r["tokens"] for r in count_tokens(df).collect()}
    enc = encoder(f"{TOKENIZER_DIR}/{TOKENIZER}")
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_pieces_are_the_text():
    for t in ("", "wort " * 50_000, "ohne" * 60_000, "a  b " * 40_000):
        assert "".join(pieces(t)) == t and all(len(p) <= PIECE_CHARS for p in pieces(t))
