"""Words as the operators of this subpackage take them: runs of bytes that are no space and no \\x09-\\x0D.

bytes.split() splits at just these six bytes, and UTF-8 has them in no other character.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each are about most bytes together, or one text."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
