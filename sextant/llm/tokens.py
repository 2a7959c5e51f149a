"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rank file of a byte-level BPE; another path can be given wherever sizes are counted.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | Column, path: str = RANKS) -> Column:
    """Tokens of the whole text; 0 for NULL and empty texts. Strings of special tokens are ordinary text."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(path)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def sized_documents(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens); documents without an id are left out."""
    return documents.where("doc_id is not null").select("doc_id", "source", n_tokens("text", path).alias("n_tokens"))
