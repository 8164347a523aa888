"""Similarity of short texts by matching blocks (Ratcliff and Obershelp), and what texts that are alike must share.

The ratio of texts of n and m letters that have M letters in matching blocks is 2 M / (n + m). So a ratio of t or
more needs M >= t (n + m) / 2 equal letters, and lengths of which the smaller is at least t / (2 - t) of the
larger. Letters are counted with repeats: the second A of a text is another token than the first.
"""

from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher
from itertools import combinations
from math import ceil

#: Letters that are asked for their place in an order of frequency; all others count as rarer.
COMMON = 256
TINY = 1e-9


def ratio_of(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def alike(a: str, b: str, least: float) -> bool:
    """Whether the ratio is at least ``least``; bounds by length and by letters come first."""
    both = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * both - TINY:
        return False
    if 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) < least * both - TINY:
        return False
    return ratio_of(a, b) >= least


def shared_letters(n: int, m: int, least: float) -> int:
    """Letters that texts of n and m letters share at the least."""
    return max(1, ceil(least * (n + m) / 2 - TINY))


def shortest_partner(n: int, least: float) -> int:
    return max(1, ceil(n * least / (2 - least) - TINY))


def letters(text: str) -> list[str]:
    """Each letter with its number among equal letters."""
    seen: Counter = Counter()
    out = []
    for c in text:
        seen[c] += 1
        out.append(f"{c}{seen[c]}")
    return out


def by_rarity(tokens: Iterable[str], places: dict[str, int]) -> list[str]:
    """Tokens in the one order that all texts use: unlisted ones, then listed ones by their places."""
    return sorted(tokens, key=lambda t: (places.get(t, -1), t))


def pair_keys(text: str, least: float, places: dict[str, int]) -> list[str]:
    """Keys of which two texts with a ratio of ``least`` or more share one.

    Texts that share k tokens share two of their rarest n - k + 2 ones each, n their own number (prefix
    filter). k is taken for the shortest partner, so every pair is covered; texts that may share a
    single token have single tokens as keys too.
    """
    tokens = by_rarity(letters(text), places)
    fewest = shared_letters(len(tokens), shortest_partner(len(tokens), least), least)
    keys = [f"{a}/{b}" for a, b in combinations(tokens[: len(tokens) - fewest + 2], 2)]
    return keys + tokens if fewest == 1 else keys


def grams(text: str, size: int) -> set[str]:
    return {text[i : i + size] for i in range(len(text) - size + 1)}


def rarest_gram(text: str, size: int, places: dict[str, int]) -> str:
    """The gram of a text whose letters are rarest, by their first occurrences; any rule would do that both sides share."""
    return min(grams(text, size), key=lambda g: (sum(places.get(f"{c}1", -1) for c in g), g))
