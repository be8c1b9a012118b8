"""SimHash fingerprints of texts (numpy inside Arrow batches)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

SHINGLE_WORDS = 4
SEED = 42


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; bytes.split() cuts at 0x20 and 0x09-0x0D."""
    tokens = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a : b - 1], seed) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero for no hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, text) to (doc_id, fp); fp as a signed long with the same bits."""
    for batch in batches:
        prints = np.array([fingerprint(shingle_hashes(t)) for t in batch["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": prints.view(np.int64)})
