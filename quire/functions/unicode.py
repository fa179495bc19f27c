"""Unicode forms. Spark has no built-in for them, so Arrow-batched functions over the standard library."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _in_form(form: str):
    @F.pandas_udf(StringType())
    def convert(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return convert


nfc = _in_form("NFC")
nfkd = _in_form("NFKD")


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    lowered = text.lower()
    if not lowered.isascii():
        lowered = "".join(c for c in unicodedata.normalize("NFKD", lowered) if not "̀" <= c <= "ͯ")
    return lowered.strip(" \t\n\x0b\f\r\xa0                　﻿")


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Lower-case and accent-free, for matching only."""
    return text.map(_fold)


def _single_folds() -> tuple[str, str, str]:
    """Characters below U+0250 that fold to one character, what they fold to, and those that do not."""
    source, target, other = [], [], []
    for code in range(0x80, 0x250):
        char = chr(code)
        plain = _fold("x" + char + "x")[1:-1]
        if plain == char.lower() == char:
            continue
        (source.append(char), target.append(plain)) if len(plain) == 1 and len(char.lower()) == 1 else other.append(char)
    return "".join(source), "".join(target), "".join(other)


_SOURCE, _TARGET, _OTHER = _single_folds()


def fold(text):
    """``folded`` without leaving the JVM for text in plain Latin letters; only other text is sent to Python."""
    from quire.functions.text import strip

    beyond = text.rlike(r"[^\x{0}-\x{24F}]|[" + _OTHER + "]")
    return F.coalesce(folded(F.when(beyond, text)), strip(F.translate(F.lower(text), _SOURCE, _TARGET)))


def composed(text):
    """NFC. Text below U+0300 is composed as it stands and is not sent to Python."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)
