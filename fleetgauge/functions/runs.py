"""Walking sorted pandas batches group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def runs(part: pd.DataFrame, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of rows with equal ``columns``: (values, from, to). A group may go on in the next batch."""
    arrays = [part[c].to_numpy() for c in columns]
    change = np.zeros(len(part), dtype=bool)
    for a in arrays:
        change[1:] |= a[1:] != a[:-1]
    edges = [0, *np.flatnonzero(change).tolist(), len(part)]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield tuple(a[lo] for a in arrays), lo, hi
