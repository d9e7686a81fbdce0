"""Sizes of texts in tokens of a public tokenizer (never trained, never copied: its file is a parameter)."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file of ranks of a byte-level BPE.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: how the texts of that vocabulary are cut into words before they are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ranks file, loaded once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """Replaces the text column by ``tokens``, its number of tokens; null for a null text.

    The text goes no further than the task that counts it.
    """
    others = [c for c in df.columns if c != text]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in pdf[text]]
            yield pdf[others].assign(tokens=pd.array(n, dtype="Int64"))

    return df.select(*[F.col(f"`{c}`") for c in others], text).mapInPandas(count, (fields + ", " if fields else "") + "tokens bigint")
