"""Token counts by a public byte-pair tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public word pattern that belongs to the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(ranks: str):
    """The tokenizer of a rank file; loaded once a worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(documents: DataFrame, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """`keep` columns and tokens (long) of each document's whole text; null and empty texts have 0."""
    schema = documents.select(*keep).schema.add("tokens", "long")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(ranks)
        for pdf in parts:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pdf[keep].assign(tokens=pd.Series(n, index=pdf.index, dtype="int64"))

    return spread(documents.select(*keep, F.col("text"))).mapInPandas(run, schema)
