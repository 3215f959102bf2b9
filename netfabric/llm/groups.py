"""Groups of rows that stream through a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, one key after another; ``keys`` are integer columns by which the partition is sorted.

    Only one group is held at a time, so the caller bounds memory by bounding its groups.
    """
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
        edges = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if (key := tuple(values[:, start].tolist())) != now:
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                now, held = key, []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
