"""The comparable form of a term."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def comparable(term: str) -> str:
    """Composed Unicode form, lower case, every run of white space as one space, none at the ends."""
    if term.isascii():
        return " ".join(term.lower().split())
    return unicodedata.normalize("NFC", " ".join(unicodedata.normalize("NFC", term).lower().split()))


@F.arrow_udf(StringType())
def term_key(values: pa.Array) -> pa.Array:
    """Column form of :func:`comparable`; NULL stays NULL. Each distinct value of an Arrow array is rewritten once."""
    coded = values.cast(pa.string()).dictionary_encode()
    forms = pa.array([comparable(t) for t in coded.dictionary.to_pylist()], pa.string())
    return forms.take(coded.indices)
