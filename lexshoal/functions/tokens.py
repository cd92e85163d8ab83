"""Column functions on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs of bytes that are no space, tab, newline or carriage return.
WORD = r"[^ \t\n\r]+"
WIDTHS = {16: (1 << 16) - 1, 32: (1 << 32) - 1}


def whitespace_tokens(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def width_of(vocab: int) -> int:
    """Bits of a token: 16 up to 65,536 ids, else 32."""
    if not 0 < vocab <= 1 << 32:
        raise ValueError("a vocabulary has between 1 and 2**32 tokens")
    return 16 if vocab <= 1 << 16 else 32


def wrap_tokens(tokens: Column, vocab: int) -> Column:
    """Ids cast to the width of the vocabulary, as unsigned numbers wrap."""
    mask = F.lit(WIDTHS[width_of(vocab)])
    return F.transform(tokens, lambda t: t.cast("long").bitwiseAND(mask))


def fit_query(query: Column, vocab: int) -> Column:
    """A query without the tokens that the vocabulary's width cannot hold."""
    return F.filter(query, lambda t: (t >= 0) & (t <= WIDTHS[width_of(vocab)]))


def uniform(seed: int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) from a seed and values."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
