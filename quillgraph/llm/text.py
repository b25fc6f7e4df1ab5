"""Words of Arrow text columns, hashed without a Python loop over words."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def texts_of(column: pa.Array) -> pa.Array:
    """As large strings, so that a batch may exceed 2 GB; nulls are empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def hashed_words(texts: pa.Array, *, lower: bool = True, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, hashes, lengths) of the white-space separated words of each text.

    Only a batch's distinct words are hashed in Python: 64 bits by xxhash, or 32 by
    crc32. Offsets have one entry more than there are texts."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    flat = words.flatten()
    full = pc.not_equal(flat, "")  # what splitting leaves at a text's ends
    sizes = np.diff(words.offsets.to_numpy())
    keep = full.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), sizes)[keep]
    coded = flat.filter(full).dictionary_encode()
    names = coded.dictionary
    if bits == 64:
        table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names))
    else:
        table = np.fromiter((zlib.crc32(w.encode()) for w in names.to_pylist()), np.uint64, len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    lengths = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64)
    if not len(names):
        return offsets, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return offsets, table[codes], lengths[codes]


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixer (the finaliser of SplitMix64); wraps by design."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
