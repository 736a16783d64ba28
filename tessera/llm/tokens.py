"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is read on the driver, from a folder that is a parameter, and
broadcast (under 1 MB, whatever the data); executors need no copy of it.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that goes with the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(spark: SparkSession, directory: str | None = None, file: str = RANK_FILE) -> pyspark.Broadcast:
    with open(os.path.join(directory or TOKENIZER_DIR, file), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(content: bytes):
    """The encoding of a rank file's content, built once in a worker."""
    import hashlib
    import sys

    # Kept on the interpreter, since functions sent by value get fresh globals with every task.
    kept = sys.__dict__.setdefault("_tessera_encodings", {})
    key = hashlib.sha1(content).hexdigest()
    if key not in kept:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        kept[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def with_token_counts(df: DataFrame, text_col: str, out_col: str, *, directory: str | None = None, file: str = RANK_FILE) -> DataFrame:
    """``df`` with the tokens of each whole text; null and empty texts have 0."""
    ranks = vocabulary(df.sparkSession, directory, file)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(ranks.value).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(out_col, count(F.col(text_col)))
