"""Words and word shingles of a text as 64-bit hashes, in numpy, one document at a time."""

import numpy as np

_SPACE = b"\t\n\x0b\x0c\r"
_FOLD = bytes.maketrans(
    bytes(range(65, 91)) + _SPACE, bytes(range(97, 123)) + b" " * len(_SPACE)
)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 2**64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand inside one task."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int):
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            for name, base in (("up", _BASE), ("down", _BACK)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


def folded(text) -> bytes:
    """The words of a text (A-Z lower-cased, split at ASCII white space), one space between."""
    if not text:
        return b""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())


def shingle_set(words: bytes, powers: Powers, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(words, dtype=np.uint8)
    up, down = powers.to(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    gaps = np.flatnonzero(raw == 32)
    start = np.concatenate([[0], gaps + 1])
    end = np.concatenate([gaps, [len(raw)]])
    word = scrambled((total[end] - total[start]) * down[start])
    take = min(width, len(word))
    mixed = np.full(len(word) - take + 1, take, dtype=np.uint64)
    for i in range(take):
        mixed += word[i : i + len(mixed)] * up[i + 1]
    return np.unique(scrambled(mixed))
