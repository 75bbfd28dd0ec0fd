"""Token counts and cuts by a public tokenizer, with the four-characters rule where there is none."""

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

VOCABULARY = "byte_bpe_50k.tiktoken"


def load_encoding(vocabulary: str | None = None):
    """The public byte-pair encoding; ``vocabulary`` is a path, else the file of the public tokenizers' folder."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(vocabulary: str | None = None) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts."""
    encoding = load_encoding(vocabulary)
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


def fallback_counter(texts: list[str]) -> list[int]:
    """A token per four characters, one at least."""
    return [max(1, len(t) // 4) for t in texts]


def counter_or_fallback(vocabulary: str | None = None) -> Callable[[list[str]], list[int]]:
    """The public tokenizer's counter, or the four-characters rule where it can't be loaded."""
    try:
        return token_counter(vocabulary)
    except (ImportError, OSError):
        return fallback_counter


def token_length(text: Column, load: Callable[[], Callable[[list[str]], list[int]]] = counter_or_fallback) -> Column:
    """Tokens of a text by the counter that ``load`` makes once per batch stream; null for null."""

    @F.pandas_udf(T.IntegerType())
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = load()
        for batch in batches:
            some = batch[batch.notna()]
            yield pd.Series(count(some.tolist()), index=some.index, dtype="Int32").reindex(batch.index)

    return lengths(text)


def cut_to_tokens(text: str, most: int, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]) -> str:
    """The text, or its first ``most`` tokens; nothing for a budget of 0 or less."""
    if most <= 0:
        return ""
    ids = encode(text)
    return text if len(ids) <= most else decode(ids[:most]).strip()
