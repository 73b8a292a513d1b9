"""Overlapping chunks of long texts, cut after sentences."""

from __future__ import annotations

#: Fixed values: (tokens from which a text is chunked, tokens of a chunk, tokens of overlap) by effort; low effort never chunks.
EFFORTS = {"low": (999_999, 999_999, 0), "high": (200, 200, 15)}

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chunks_of(text: str, size_tokens: int, overlap_tokens: int) -> list[str]:
    """Windows of ``size_tokens`` (of four characters) that end after the last full stop and blank in their last two thirds, or are cut hard; each
    but the first begins with the end of the one before. A text that fits is one chunk, a blank one none."""
    size, overlap = 4 * size_tokens, 4 * overlap_tokens
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    out, at, tail = [], 0, ""
    while at < len(text):
        window = text[at : at + size]
        stop = window.rfind(". ", len(window) // 3)
        took = stop + 1 if stop >= 0 else len(window)
        own = window[:took].strip()
        at += took
        if own:
            out.append(f"{tail.strip()} {own}".strip() if tail else own)
            tail = own[-overlap:] if overlap else ""
    return out


def chunk_text(text: Column, size_tokens: int = 200, overlap_tokens: int = 15) -> Column:
    """array<string>; each cut depends on the one before it, so a text is gone through in order, many texts in an Arrow batch."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t or "", size_tokens, overlap_tokens))

    return run(text)
