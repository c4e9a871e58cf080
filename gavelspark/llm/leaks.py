"""Problem 7: held-out texts inside documents, by multi-pattern search.

The patterns are all runs of ``RUN`` words of the held-out items. The search is the block-shift one of Wu and
Manber with (hashed) words for letters: the last block (two words) of a window says how far the window may move because
no pattern has that block nearer to its end; where it may not move, suffix and prefix of the window pick a bucket of
patterns, and the words themselves are compared. Many windows move at once, as arrays. The patterns are places in
one array of words, so their number is that of the held-out words. Documents are read once and nothing is shuffled but the findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gavelspark.llm import shingles as S

RUN, BLOCK = 13, 2
#: Bytes of held-out text that are sent to the workers at once (they take about four times as much there); a
#: larger set is searched in several passes.
MAX_BYTES = 128 << 20
#: Windows of a document that one pointer walks over; shorter walks mean more pointers at once.
WALK = 512
_SUFFIX_BITS = np.uint64(24)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the longest runs of letters and digits, lower-cased, and their number for each text."""
    # the one letter whose small form is not one letter
    return S.flat_hashes([t.replace("\u0130", "i") if t else t for t in texts], words_only=True)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (count[i] of them) for all i, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


class PatternSearch:
    """Shift table and buckets of the patterns; ``find`` gives the items whose patterns stand in texts."""

    def __init__(self, texts: list[str], run: int = RUN):
        self.run = run
        self.words, counts = words(texts)
        starts = np.cumsum(counts) - counts
        long = counts >= run
        bits = max(16, min(26, int(4 * len(self.words)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, run - BLOCK + 1, np.uint8)
        ends = _spans(starts[long] + 1, counts[long] - 1)
        nearest = np.maximum(0, run - 1 - (ends - np.repeat(starts[long], counts[long] - 1)))
        np.minimum.at(self.shift, self._block(self.words, ends), nearest.astype(np.uint8))
        # a pattern is the place of its first word; patterns of equal suffix and prefix stand together
        places = _spans(starts[long], counts[long] - run + 1)
        owners = np.repeat(np.flatnonzero(long), counts[long] - run + 1)
        keys = self._keys(self.words, places)
        order = np.lexsort((owners, keys))
        keys, places, owners = keys[order], places[order], owners[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
        self.keys, self.places, self.owners = keys[new], places[new].astype(np.int32), owners[new].astype(np.int32)

    def _block(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (S.scramble(flat[ends - 1] * np.uint64(3) + flat[ends]) & self.mask).astype(np.int64)

    def _keys(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Suffix of a window in the upper bits, all of it in the lower."""
        suffix = S.scramble(flat[starts + self.run - 2] * np.uint64(3) + flat[starts + self.run - 1])
        whole = np.zeros(len(starts), np.uint64)
        for k in range(self.run):
            whole = S.scramble(whole * np.uint64(3) + flat[starts + k])
        return (suffix >> (np.uint64(64) - _SUFFIX_BITS) << (np.uint64(64) - _SUFFIX_BITS)) | (whole >> _SUFFIX_BITS)

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the item), each pair once, in order."""
        flat, counts = words(texts)
        starts = np.cumsum(counts) - counts
        windows = np.maximum(0, counts - self.run + 1)
        walks = -(-windows // WALK)
        step = _spans(np.zeros(len(walks), np.int64), walks)
        at = np.repeat(starts, walks) + self.run - 1 + step * WALK
        last = np.minimum(at + WALK, np.repeat(starts + counts, walks)) - 1
        hits = [np.zeros(0, np.int64)]
        while len(at):
            move = self.shift[self._block(flat, at)]
            hits.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at <= last
            at, last = at[live], last[live]
        first = np.concatenate(hits) - self.run + 1
        keys = self._keys(flat, first)
        low, high = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        found = [np.zeros(0, np.int64)]
        sizes = high - low
        for part in np.array_split(np.flatnonzero(sizes), max(1, int(sizes.sum()) >> 18)):
            pattern = _spans(low[part], sizes[part])
            window = np.repeat(first[part], sizes[part])
            same = np.ones(len(window), bool)
            for k in range(self.run):
                same &= flat[window + k] == self.words[self.places[pattern] + k]
            text = np.searchsorted(starts, window[same], "right") - 1
            found.append(np.unique(text * np.int64(1 << 31) + self.owners[pattern[same]]))
        both = np.unique(np.concatenate(found))
        return both >> 31, both & ((1 << 31) - 1)


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, item_id) of every document with ``run`` consecutive words of an item; each pair once.

    ``documents`` has doc_id and text, ``items`` item_id and text; other columns are not read. Null and short texts
    hold nothing, rows with a null id are left out, repeated rows and ids count once, equal items are all reported.
    Very long texts are read whole. Items come to the driver, since the held-out set is fixed in size; ``max_bytes``
    bounds what is sent to the workers at once, and a larger set is searched in several passes over the documents.
    """
    sc = documents.sparkSession.sparkContext
    schema = T.StructType([documents.schema["doc_id"], items.schema["item_id"]])
    types = [to_arrow_type(f.dataType) for f in schema]

    def searched(held: list) -> DataFrame:
        sent = sc.broadcast((PatternSearch([text for _, text in held], run), pa.array([key for key, _ in held], types[1])))

        def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, keys = sent.value
            for batch, texts in S.sliced(batches, 1):
                text, item = search.find(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)).cast(types[0]), keys.take(pa.array(item))], names=["doc_id", "item_id"])

        return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run_batches, schema)

    parts: list[DataFrame] = []
    held: list[tuple] = []
    size = 0
    for row in items.select("item_id", "text").where("item_id is not null and text is not null").distinct().toLocalIterator():
        if held and size + len(row.text.encode("utf-8", "replace")) > max_bytes:
            parts.append(searched(held))
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text.encode("utf-8", "replace"))
    result = searched(held)
    for part in parts:
        result = result.union(part)
    return result.distinct()


def leak_report(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Leaked items with the number of documents and of sources that hold them."""
    about = documents.select("doc_id", "source").where("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    return found.join(about, "doc_id").groupBy("item_id").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
