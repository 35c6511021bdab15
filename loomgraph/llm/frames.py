"""Arrow batches of sorted rows, cut at the borders of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def group_starts(part: pd.DataFrame, keys: tuple[str, ...]) -> np.ndarray:
    """Positions at which a new group begins in sorted rows."""
    fresh = np.zeros(len(part), dtype=bool)
    fresh[:1] = True
    for key in keys:
        column = part[key].to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(fresh)


def whole_groups(batches: Iterator[pd.DataFrame], keys: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Re-cut a stream of rows sorted by ``keys`` so that no group spans two parts."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = int(group_starts(batch, keys)[-1])
        same = bool(held) and all(held[-1][k].iloc[-1] == batch[k].iloc[0] for k in keys)
        if held and not same:
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held = []
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
