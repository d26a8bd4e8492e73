"""Token counts of texts without their ids.

Each worker counts the pieces of every distinct pre-token once and keeps the count in its own
bounded table (see ``units``), joins the counts to the pre-token frequencies of its documents,
and sums. When the table is full, pre-tokens met only once are forgotten and counted again
should they come back. So the join never leaves the task and nothing is shuffled: a table of
all pre-tokens of all documents would move more bytes than the texts have. A null text is
empty and has 0 tokens; a null key stays null; repeated rows are counted row by row; an empty
table gives no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from meshloom.llm.common import binary_table
from meshloom.llm.units import ByteUnits, Sizes, blocks, kept


class PieceCounts(ByteUnits):
    """How many pieces each distinct pre-token has; ids of texts are never laid out."""

    RUNS = Sizes

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of each text: the piece counts of its distinct units, times their frequencies in it."""
        which, counts = self.numbers(texts)
        row = np.repeat(np.arange(len(texts)), counts)
        width = max(1, len(self.units.seen))
        pair, frequency = np.unique(row * width + which, return_counts=True)
        return np.bincount(pair // width, self.units.runs.sizes(pair % width) * frequency, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(PieceCounts, vocabulary)
        for part in blocks(batches):
            n = counter.count(part.column("utf8").to_pylist())
            n_bytes = pc.binary_length(part.column("utf8")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return binary_table(docs, key, text).mapInArrow(work, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")
