"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def group_rows(batch: pa.RecordBatch, by: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each group of equal values in ``by`` (nulls are equal), and each row's group."""
    group = np.zeros(len(batch), np.int64)
    for c in by:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return np.unique(group, return_index=True, return_inverse=True)[1:]
