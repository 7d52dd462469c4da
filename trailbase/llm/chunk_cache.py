"""A bounded table of what an encoder made of the words it has met."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain


class RunCache:
    """Values of words, computed in bulk for those not met yet.

    Emptied when it would pass ``most`` words or ``most_chars`` characters in
    them, so that long words (a text without spaces is one) can't fill memory:
    it holds so much and the words of one call at most.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = 400_000, most_chars: int = 8 << 20):
        self.encode, self.most, self.most_chars = encode, most, most_chars
        self.known, self.chars = {}, 0

    def values(self, texts: list[list[str]]) -> dict:
        """A table with a value for each word of the texts."""
        known = self.known
        new = set(chain.from_iterable(texts)).difference(known)
        chars = sum(map(len, new))
        if known and (len(known) + len(new) > self.most or self.chars + chars > self.most_chars):
            known.clear()
            new = set(chain.from_iterable(texts))
            self.chars, chars = 0, sum(map(len, new))
        if new:
            new = list(new)
            known.update(zip(new, self.encode(new), strict=True))
            self.chars += chars
        return known
