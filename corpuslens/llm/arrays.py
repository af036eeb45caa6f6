"""Small helpers on batches, and on arrays of groups laid end to end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def small_batches(batches, rows: int = 512):
    """Batches of at most ``rows`` rows each, so that what a kernel holds at once does not depend on how rows arrive.

    A worker serves one stage after the other, so what Arrow keeps for later goes back to the system at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of given sizes: each member's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def offsets(counts: np.ndarray) -> np.ndarray:
    """Where each group begins, and the end of the last."""
    return np.append(0, np.cumsum(counts))
