"""Terms of a text: runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""

from __future__ import annotations

import numpy as np

#: What each byte of UTF-8 becomes.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

#: Java and RE2 pattern of a term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words that a worker remembers with their hash.
REMEMBERED = 500_000


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class WordHashes(dict):
    """Hashes of words by word; starts anew when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_MIX = np.uint64(0x9E3779B97F4A7C15)


def chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size consecutive hashes (uint64)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out
