"""One Aho-Corasick automaton over word sequences, for scanning many texts once."""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick


class WordAutomaton:
    """Finds every place where a pattern's words stand consecutively.

    Words are numbered, so a step of the automaton is a word, and a word that no pattern
    has takes it back to the start. ``patterns``: pairs of word tuples and a value; values
    of equal patterns are gathered.
    """

    def __init__(self, patterns: Iterable[tuple[tuple[bytes, ...], object]]):
        values: dict[tuple[bytes, ...], set] = {}
        for words, value in patterns:
            values.setdefault(tuple(words), set()).add(value)
        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, found in values.items():
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            self.machine.add_word(key, (len(key), frozenset(found)))
        self.empty = not values
        if not self.empty:
            self.machine.make_automaton()

    def find(self, words: list[bytes]) -> list[tuple[int, int, frozenset]]:
        """(first word, number of words, values) of each occurrence, by its last word."""
        if self.empty or not words:
            return []
        get = self.numbers.get
        numbers = tuple([get(w, 0) for w in words])
        if not any(numbers):
            return []
        return [(end - n + 1, n, values) for end, (n, values) in self.machine.iter(numbers)]
