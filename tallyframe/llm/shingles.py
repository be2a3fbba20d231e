"""Word shingles and their hashes, computed document by document inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash

SEED = 42


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8 bytes; bytes.lower() changes A-Z alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Unsigned XXH64 of each n-word shingle, repeats included; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = zip(*[words[i:] for i in range(n)])
    return np.fromiter(map(digest, map(b" ".join, runs), repeat(SEED)), np.uint64, len(words) - n + 1)


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys in Arrow batches that are sorted by these keys, as dicts of NumPy columns.

    Holds one group at a time besides the current batch.
    """
    held: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(change)
        for lo, hi in zip(starts, np.append(starts[1:], batch.num_rows)):
            part = {n: c[lo:hi] for n, c in cols.items()}
            key = tuple(part[k][0] for k in keys)
            if last is not None and key != last:
                yield _whole(held)
                held = []
            held.append(part)
            last = key
    if held:
        yield _whole(held)


def _whole(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
