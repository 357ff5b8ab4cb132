"""A minimal acyclic automaton over sorted words, with perfect-hash word numbers and search with one error."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


class Automaton:
    """The minimal acyclic automaton of distinct words that come in ascending order of code points.

    States with equal futures are one, and each state knows how many words its future holds; so a word's number (its
    place in the order) is the sum of what the branches before its path hold, and no word is stored as such.
    """

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.held: list[int] = []
        self.words = 0
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._settle(path, last, same, known)
            path += [({}, False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            last, self.words = word, self.words + 1
        self._settle(path, last, 0, known)
        self.root = self._state(*path[0], known)

    def _settle(self, path: list, last: str, depth: int, known: dict) -> None:
        """The states of the last word's path beyond ``depth`` get no more branches: each becomes an equal one or is kept."""
        while len(path) > depth + 1:
            at = self._state(*path.pop(), known)
            path[-1][0][last[len(path) - 1]] = at

    def _state(self, branches: dict[str, int], final: bool, known: dict) -> int:
        key = (final, *branches.items())
        found = known.get(key)
        if found is None:
            found = known[key] = len(self.next)
            self.next.append(branches)
            self.final.append(final)
            self.held.append(final + sum(self.held[x] for x in branches.values()))
        return found

    def follow(self, text: str, first: int, at: int, number: int) -> tuple[int, int] | None:
        """State and word number after the code points of ``text`` from ``first`` on, or None where no word goes on so."""
        for i in range(first, len(text)):
            c, branches = text[i], self.next[at]
            to = branches.get(c)
            if to is None:
                return None
            number += self.final[at]
            for b, x in branches.items():  # in order, as the words came in order
                if b == c:
                    break
                number += self.held[x]
            at = to
        return at, number

    def one_error(self, exact: str, rest: str) -> set[int]:
        """The numbers of the words that begin with ``exact`` and go on with ``rest`` but for exactly one inserted, deleted
        or replaced code point. Of equal neighbours in ``rest`` only the last is left out or doubled: it comes to the same."""
        found: set[int] = set()
        start = self.follow(exact, 0, self.root, 0)
        if start is None:
            return found
        at, number = start
        for i in range(len(rest) + 1):
            c, beyond = rest[i : i + 1], number + self.final[at]
            if c and rest[i + 1 : i + 2] != c:
                self._end(rest, i + 1, at, number, found)  # without c
            for b, to in self.next[at].items():
                if b != c:
                    self._end(rest, i, to, beyond, found)  # b before c
                    if c:
                        self._end(rest, i + 1, to, beyond, found)  # b for c
                beyond += self.held[to]
            if not c or (step := self.follow(c, 0, at, number)) is None:
                break
            at, number = step
        return found

    def _end(self, text: str, first: int, at: int, number: int, found: set[int]) -> None:
        end = self.follow(text, first, at, number)
        if end is not None and self.final[end[0]]:
            found.add(end[1])

    def __iter__(self) -> Iterator[str]:
        """The words in the order of their numbers."""

        todo = [(self.root, "")]
        while todo:
            at, text = todo.pop()
            if self.final[at]:
                yield text
            todo += [(to, text + b) for b, to in reversed(self.next[at].items())]
