"""What several operators share: words, batches of bounded size, documents without surprises."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# A-Z lower-cased; every ASCII byte that is no letter or digit separates words.
_FOLD = bytearray(range(256))
for _b in range(128):
    _FOLD[_b] = ord(chr(_b).lower()) if chr(_b).isalnum() else 32
FOLD = bytes(_FOLD)


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(FOLD).split()


def key_and_text(docs: DataFrame, key: str) -> list[Column]:
    """``key`` and the text (null: empty) as Arrow functions read them; a struct key has its own text."""
    own = [F.col(key).alias("key")]
    return own if isinstance(docs.schema[key].dataType, StructType) else [*own, F.coalesce("text", F.lit("")).alias("text")]


def slices(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that each piece holds about ``limit`` bytes of text, or one row; with the texts as UTF-8. The text is
    a column, or else a field of the first one."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        column = (batch.column(at) if at >= 0 else batch.column(0).field("text")).cast(pa.binary())
        start, size, held = 0, 0, []
        for i in range(len(column)):
            value = column[i].as_py() or b""
            if held and size + len(value) > limit:
                yield batch.slice(start, len(held)), held
                start, size, held = i, 0, []
            held.append(value)
            size += len(value)
        if held:
            yield batch.slice(start, len(held)), held
