"""Word splitting on UTF-8 bytes, and a helper that maps a Python function over whole texts in Arrow batches.

Both word patterns treat every byte from 0x80 on as part of a word, so that they can be applied to UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TEXT = "__text__"
#: A-Z to a-z; what is neither letter, digit nor beyond ASCII to a blank.
_ALNUM = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
WHITESPACE = b" \t\n\r\x0b\x0c"
_NOT_IN_WORDS = WHITESPACE + bytes(range(0x80, 0xC0))  # white space, and bytes that continue a code point


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    r"""Lower-cased words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``."""
    return text.translate(_ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` as they stand."""
    return text.split()


def word_chars(text: bytes) -> int:
    """Code points that stand in ``blank_words``."""
    return len(text.translate(None, _NOT_IN_WORDS))


def map_texts(df: DataFrame, function: Callable[[Iterator[bytes | None]], Iterator[tuple]], result: str, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns of ``df`` and those of ``result``, which ``function`` computes from each text.

    ``function`` gets an iterator over the texts (UTF-8, or None) of a whole partition and yields a row for each.
    Only one Arrow batch is held at a time. Columns of ``df`` that ``result`` names too are replaced.
    """
    added = T._parse_datatype_string(result)
    names = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    schema = T.StructType([*(df.schema[c] for c in names), *added])
    arrow = to_arrow_schema(added)
    source = text if text in names else TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[bytes | None]:
            for b in batches:
                held.append(b)
                column = b.column(source)
                for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
                    yield x.as_py()

        rows: list[tuple] = []
        for row in function(texts()):
            rows.append(row)
            if len(rows) == held[0].num_rows:
                b = held.pop(0)
                made = [pa.array(list(x), type=f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, *added.names])
                rows = []

    given = df.select(*names, *([] if source == text else [F.col(text).cast("binary").alias(TEXT)]))
    return given.mapInArrow(run, schema)
