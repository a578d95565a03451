"""Small groups, many at a time: rows that come sorted by their group's keys, handed on as whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task works on at a time.
ROWS = 1 << 19


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = ROWS) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, group) for about `rows` rows at a time; the first `keys` columns tell groups apart, which are numbered from 0 and never cut."""
    held: list[list[np.ndarray]] = []

    def joined() -> tuple[list[np.ndarray], np.ndarray]:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        change = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        return cols, np.cumsum(change)

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= rows:
            cols, group = joined()
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield [c[:whole] for c in cols], group[:whole]
            held = [[c[whole:] for c in cols]]
    if held:
        yield joined()
