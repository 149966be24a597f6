"""Arrow batches taken apart into blocks of texts with bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

BLOCK_BYTES = 1 << 19
BLOCK_ROWS = 256


def text_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) for consecutive rows; null counts as empty.

    A block ends before it exceeds ``max_bytes``; a longer text is a block of its own.
    """
    first, block, size = 0, [], 0
    for row, value in enumerate(column.cast(pa.large_binary())):
        data = value.as_py() or b""
        if block and (size + len(data) > max_bytes or len(block) >= max_rows):
            yield first, block
            first, block, size = row, [], 0
        block.append(data)
        size += len(data)
    if block:
        yield first, block
