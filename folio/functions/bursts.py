"""Messages shown at most once in a while, over rows that Spark has sorted by key and time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def first_shown(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows ``key, at, opens`` in order those shown: every one that opens a burst, then the next ``least`` or more after the last shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # time last shown; it carries over batches
        for batch in batches:
            at = batch.column("at").to_numpy()
            opens = batch.column("opens").to_numpy(zero_copy_only=False)
            keep = opens.copy()
            bursts = np.flatnonzero(opens).tolist()
            for start, end in zip([0, *bursts], [*bursts, len(at)], strict=True):
                if start == end:
                    continue
                if opens[start]:
                    last = at[start]
                # from one shown to the next by search: steps as many as messages shown
                while (i := start + int(np.searchsorted(at[start:end], last + least))) < end:
                    keep[i], last, start = True, at[i], i
            yield batch.filter(pa.array(keep))

    return run
