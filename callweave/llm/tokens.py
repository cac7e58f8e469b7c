"""Token counts of texts by a public tokenizer. The vocabulary's path is a parameter; the driver reads the file, which
is checked to be small, and broadcasts its bytes, so executors need no copy on disk."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("CALLWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
MAX_VOCABULARY_BYTES = 32 << 20
# fixed value: the split pattern that the byte-level vocabularies were made with
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(raw: bytes, blanks: int = 10_000):
    """A function from a text to its number of tokens. The library's own splitter gives up on runs of very many
    blanks; texts with a run of ``blanks`` are split here, by the same pattern, and each part is encoded on its own, which
    gives the same counts."""
    import regex
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    enc = tiktoken.Encoding("callweave", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    long_run, parts = re.compile(rf"\s{{{blanks}}}"), regex.compile(PATTERN)

    def count(text: str) -> int:
        if len(text) >= blanks and long_run.search(text):
            return sum(len(enc._core_bpe.encode_single_piece(p.encode())) for p in parts.findall(text))
        return len(enc.encode_ordinary(text))

    return count


def with_token_counts(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with the number of tokens of the whole text; 0 for a null or empty one."""
    if os.path.getsize(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = counter(shared.value)
        for b in batches:
            yield pd.Series([n(t) if t else 0 for t in b], dtype="int64")

    return df.withColumn(out, count(F.col(text)))
