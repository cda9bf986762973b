"""Token counts by a public tokenizer, in Arrow batches on the executors."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of public tokenizers are; on a cluster, a path every executor can read.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before byte-pair merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 100_000  # text handed to the tokenizer at a time, cut at white space

_LOADED: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def pieces(text: str) -> Iterator[str]:
    """Very long texts in pieces that end before a blank, where the pattern splits anyway."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = text.rfind(" ", at + 1, at + PIECE_CHARS)
        cut = cut if cut > at and not text[cut - 1].isspace() else at + PIECE_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(df: DataFrame, text: str = "text", tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id",), out: str = "tokens") -> DataFrame:
    """The ``keep`` columns and ``out``, the number of tokens of the whole text; 0 for null and empty texts."""
    path = f"{tokenizer_dir}/{tokenizer}"
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", {out} bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            # The kept columns pass through as they are, nulls and large numbers too.
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], out])

    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(count, schema)
