"""Problem 6: ids of every text under a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T

from gavelspark.llm.bpe import Encoder

#: Texts are encoded in slices of a batch that hold about so many characters, so that memory stays bounded.
SLICE_CHARS = 4_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, ids) for every row of ``df``; ids is the empty list for a null or empty text.

    Rows are neither dropped nor merged: repeated keys and null keys come out as often as they came in. Special
    tokens' names inside a text are ordinary text. Other columns are not read. The automaton is compiled once
    and sent to the workers; its size depends on the vocabulary only.
    """
    encoder = df.sparkSession.sparkContext.broadcast(Encoder(vocabulary))
    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    key_type = to_arrow_type(df.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder.value.encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in _slices(texts):
                found = [encode(t) for t in texts[start:stop]]
                ends = np.cumsum([0, *map(len, found)])
                values = pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start).cast(key_type), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)
