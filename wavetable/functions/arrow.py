"""Arrow list columns <-> dense NumPy blocks, used inside tasks only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def to_block(lists: pa.Array) -> np.ndarray:
    """List column -> (rows, channels) float64; missing rows and elements become NaN."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    present = lists.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    sizes = pc.list_value_length(lists).drop_null().to_numpy(zero_copy_only=False)
    width = int(sizes[0]) if sizes.size else 0
    if sizes.size and (sizes != width).any():
        raise ValueError("spectra of one column must all have the same number of channels")
    if width == 0:
        return np.empty((len(lists), 0))
    if present.all():
        return values.reshape(len(lists), width)
    block = np.full((len(lists), width), np.nan)
    block[present] = values.reshape(-1, width)
    return block


def to_lists(block: np.ndarray) -> pa.Array:
    """(rows, channels) -> list column; a row holding a non-finite value becomes NULL."""
    good = np.isfinite(block).all(axis=1) if block.shape[1] else np.zeros(len(block), dtype=bool)
    width = block.shape[1]
    offsets = np.concatenate([[0], np.cumsum(np.where(good, width, 0))]).astype(np.int32)
    values = block if good.all() else block[good]
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()), mask=pa.array(~good)
    )


def to_scalars(values: np.ndarray) -> pa.Array:
    """One double per row; non-finite becomes NULL."""
    return pa.array(values, mask=~np.isfinite(values))
