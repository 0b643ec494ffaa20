"""Suffix automata over integer symbols, built once on bounded text and read as arrays."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """The generalised suffix automaton of several sequences; sequences never match across their ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        """Insert one sequence, starting from the root."""
        last = 0
        for symbol in sequence:
            last = self._extend(last, int(symbol))

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, state: int, symbol: int, old: int, new: int) -> None:
        while state != -1 and self.next[state].get(symbol) == old:
            self.next[state][symbol] = new
            state = self.link[state]

    def _extend(self, last: int, symbol: int) -> int:
        have = self.next[last].get(symbol)
        if have is not None:  # the prefix so far is a factor already
            if self.length[have] == self.length[last] + 1:
                return have
            clone = self._copy(have, self.length[last] + 1)
            self.link[have] = clone
            self._redirect(last, symbol, have, clone)
            return clone
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state, walk = len(self.next) - 1, last
        while walk != -1 and symbol not in self.next[walk]:
            self.next[walk][symbol] = state
            walk = self.link[walk]
        if walk != -1:
            have = self.next[walk][symbol]
            if self.length[have] == self.length[walk] + 1:
                self.link[state] = have
            else:
                clone = self._copy(have, self.length[walk] + 1)
                self.link[have] = self.link[state] = clone
                self._redirect(walk, symbol, have, clone)
        return state

    def matching(self, sequence) -> list[int]:
        """The length of the longest factor that ends at each place of a sequence."""
        out, state, length = [], 0, 0
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            step = self.next[state].get(symbol)
            if step is None:
                length = 0
            else:
                state, length = step, length + 1
            out.append(length)
        return out

    def jump_table(self, symbols: int) -> np.ndarray:
        """``table[state * symbols + s]``: the next state, or, if none, minus the state after restarting with ``s`` less one.

        A greedy parse therefore needs one look-up a symbol: a negative entry starts a phrase. One more state, the
        last, has no way on at all: a parse starts there, and a symbol that the sample lacks, a phrase of its own,
        leads there.
        """
        alone = len(self.next)
        root = np.full(symbols, alone, dtype=np.int32)
        for symbol, state in self.next[0].items():
            root[symbol] = state
        table = np.tile(-root - 1, (alone + 1, 1))
        for state, steps in enumerate(self.next):
            for symbol, to in steps.items():
                table[state, symbol] = to
        return table.reshape(-1).astype(np.int32)
