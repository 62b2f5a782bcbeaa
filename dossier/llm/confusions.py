"""Letters that scanning mistakes for others of like shape."""

from __future__ import annotations

from functools import lru_cache

# What stands on the page, and what is read instead.
SHAPES = (
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("e", "c"), ("c", "e"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("o", "0"), ("s", "5"), ("a", "@"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"),
    ("u", "ii"), ("n", "ri"), ("fi", "li"), ("g", "9"), ("b", "6"), ("g", "q"), ("q", "g"), ("v", "y"), ("y", "v"), ("u", "v"), ("f", "l"), ("t", "l"), ("h", "li"), ("nn", "rm"), ("ll", "ii"), ("z", "2"), ("b", "8"), ("p", "n"), ("e", "o"), ("o", "e"), ("a", "o"), ("r", "i"), ("n", "u"), ("u", "n"),
)


def misreadings(word: str) -> set[str]:
    """The word with one shape misread."""
    out = set()
    for true, read in SHAPES:
        at = word.find(true)
        while at >= 0:
            out.add(word[:at] + read + word[at + len(true) :])
            at = word.find(true, at + 1)
    out.discard(word)
    return out


@lru_cache(maxsize=64)
def variants(words: tuple[str, ...]) -> frozenset[str]:
    """The words and their single misreadings."""
    return frozenset(words) | frozenset(v for w in words for v in misreadings(w))
