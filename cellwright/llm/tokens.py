"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files of public tokenizers lie, unless told otherwise.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: how this family of byte-level vocabularies divides text before it merges bytes.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space so long that the first library's pattern matcher may run out of stack.
_LONG_BLANK = re.compile(r"\s{1000}")


def token_count(text: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k") -> Column:
    """Tokens of the whole ``text`` under the byte-level vocabulary at ``path``.tiktoken and .json; 0 for null and empty texts.

    Both files hold the same vocabulary; the second library, which is slower, counts the texts with very long white space.
    """
    loaded: dict = {}

    def patient(t: str) -> int:
        if "slow" not in loaded:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            loaded["slow"] = Tokenizer.from_file(f"{path}.json")
            loaded["slow"].encode_special_tokens = True
        return len(loaded["slow"].encode(t, add_special_tokens=False))

    def one(t) -> int:
        if not t:
            return 0
        return patient(t) if len(t) > 1000 and _LONG_BLANK.search(t) else len(loaded["quick"].encode_ordinary(t))

    def count(texts: pd.Series) -> pd.Series:
        if "quick" not in loaded:
            import tiktoken

            with open(f"{path}.tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            loaded["quick"] = tiktoken.Encoding(os.path.basename(path), pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        return pd.Series([one(t) for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)
