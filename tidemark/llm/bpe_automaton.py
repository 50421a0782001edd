"""Byte-pair encoding compiled, on demand, to a deterministic finite-state transducer.

A token sequence is the BPE encoding of its text exactly when every adjacent pair of
tokens is the BPE encoding of the two tokens' text.  Reading a word left to right,
the last token of every prefix is therefore fixed by the tokens that end at the
positions from which a longer piece may still start.  That bounded window is the
automaton's state; a transition carries the change in the number of tokens and the
last token of the longer prefix, which is the backpointer of a Viterbi lattice with
one surviving path.  States are made when a text first needs them (as in lazy regular
expression engines) and thrown away when they pass ``max_states``, so memory is bounded.  ``track`` keeps last
tokens, which counting doesn't need.
"""

from __future__ import annotations

import numpy as np


class BpeAutomaton:
    """Transducer of one vocabulary.

    ``pieces``: text of a piece -> id, where texts are strings over the alphabet
    ``alphabet`` (symbol i is ``alphabet[i]``; symbol ``n + i`` is ``finals[i]``, the
    form that the last symbol of a word takes).  ``rank(left, right)`` gives the merge
    priority of two adjacent pieces, or None.
    """

    START = ("", None, ())

    def __init__(self, pieces, alphabet, finals, rank, max_states=160_000, track=False):
        self.pieces, self.rank, self.max_states, self.track = pieces, rank, max_states, track
        self.symbols = list(alphabet) + list(finals)
        self.n = len(alphabet)
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self):
        self.columns = np.full(len(self.symbols), -1, np.int32)
        self.used: list[int] = []
        self.width = 64
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self._allocate(1 << 14)
        self._state(self.START)

    def _allocate(self, rows):
        self.next = np.full((rows, self.width), -1, np.int32)
        # what a transition gives: the change in the number of tokens, or the last token
        self.out = np.zeros((rows, self.width), np.int32 if self.track else np.int8)

    def _grow(self, rows, width):
        for name in ("next", "out"):
            old = getattr(self, name)
            new = np.full((rows, width), -1 if name == "next" else 0, old.dtype)
            new[: old.shape[0], : old.shape[1]] = old
            setattr(self, name, new)
        self.width = width

    def _state(self, key) -> int:
        at = self.keys.get(key)
        if at is None:
            at = self.keys[key] = len(self.states)
            self.states.append(key)
            if at >= self.next.shape[0]:
                self._grow(self.next.shape[0] * 3 // 2, self.width)
        return at

    def encode(self, text: str) -> list[str]:
        """The plain merge loop: lowest rank first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pair(self, left: str, right: str) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            ok = self.pairs[left, right] = self.encode(left + right) == [left, right]
        return ok

    def _expand(self, state: int, symbol: int):
        """Fill the transition of ``state`` on ``symbol``."""
        suffix, token, window = self.states[state]
        char, final = self.symbols[symbol], symbol >= self.n
        # (length of the suffix, token that ends before it or None at the word's start, tokens before it less those now)
        options = [*window, (0, token, 0)]
        text = count = None
        for k, before, relative in options:
            piece = (suffix[len(suffix) - k :] if k else "") + char
            if piece in self.pieces and (before is None or self._pair(before, piece)):
                text, count = piece, relative + 1
                break
        if text is None:
            raise ValueError(f"no piece for symbol {char!r}")
        target = 0
        if not final:
            kept = []
            for k, before, relative in options:
                grown = (suffix[len(suffix) - k :] if k else "") + char
                if grown in self.prefixes:
                    kept.append((k + 1, before, relative - count))
            longest = kept[0][0] if kept else 0
            grown = (suffix + char)[len(suffix) + 1 - longest :] if longest else ""
            target = self._state((grown, text, tuple(kept)))
        column = self.columns[symbol]
        self.next[state, column] = target
        self.out[state, column] = self.pieces[text] if self.track else count

    def run(self, symbols: np.ndarray, ends: np.ndarray, entry: tuple | None = None, lanes: int = 2048):
        """Tokens added at each symbol, or with ``track`` the last token there, and the state after the last symbol.

        ``entry`` is such a state, that of a stream that goes on; by default a word begins.
        ``ends`` marks the last symbol of each word.  The stream is cut into ``lanes``
        chunks.  A chunk that holds a word end maps every entry state to one exit
        state, so all chunks run side by side from their first word end; a second run
        takes each chunk's head from the exit state before it (chunks without a word
        end are passed through as part of the head that began earlier).
        """
        size = len(symbols)
        given = np.zeros(size, self.out.dtype)
        if not size:
            return given, entry or self.START
        if len(self.states) > self.max_states:
            self._reset()
        symbols = symbols.astype(np.int32) + self.n * ends.astype(np.int32)
        for s in np.flatnonzero(np.bincount(symbols, minlength=len(self.symbols))):
            if self.columns[s] < 0:
                self.columns[s] = len(self.used)
                self.used.append(int(s))
        if len(self.used) > self.width:
            width = self.width
            while width < len(self.used):
                width *= 2
            self._grow(self.next.shape[0], width)
        columns = self.columns[symbols]
        stops = np.flatnonzero(ends) + 1  # a word begins at each of these
        edges = np.unique(np.linspace(0, size, min(lanes, max(1, size // 64)) + 1).astype(np.int64))
        begin, end = edges[:-1], edges[1:]
        ready = np.searchsorted(stops, begin, "left")
        first = np.r_[stops, size][ready]
        first[0] = 0
        whole = first < end  # the chunk has a synchronising boundary with symbols after it
        exits = np.zeros(len(begin), np.int64)
        enter = np.zeros(whole.sum(), np.int64)
        enter[:1] = self._state(entry or self.START)  # the first chunk begins where the stream stands
        exits[whole] = self._lockstep(columns, first[whole], end[whole], enter, given)
        heads = np.flatnonzero((begin > 0) & (begin < first) & np.r_[True, whole[:-1]])
        last = exits[-1]
        if len(heads):
            through = self._lockstep(columns, begin[heads], first[heads], exits[heads - 1], given)
            last = last if whole[-1] else through[-1]
        return given, self.states[int(last)]

    def _lockstep(self, columns, begin, end, state, given):
        """Run the spans [begin, end) side by side from ``state``; returns their last states."""
        order = np.argsort(begin - end, kind="stable")
        at, stop, state = begin[order].copy(), end[order], state[order].copy()
        lengths = (stop - at)[::-1]
        step, active = 0, len(at)
        while active:
            active = len(lengths) - int(np.searchsorted(lengths, step, "right"))
            if active <= 4:
                break
            here, now = at[:active], state[:active]
            column = columns[here]
            target = self.next[now, column]
            missing = target < 0
            if missing.any():
                for s, c in set(zip(now[missing].tolist(), column[missing].tolist(), strict=True)):
                    self._expand(s, self.used[c])
                target = self.next[now, column]
            given[here] = self.out[now, column]
            state[:active] = target
            at[:active] += 1
            step += 1
        for lane in range(active):  # few long words are left
            s, known, used = int(state[lane]), self.next, self.used
            for i in range(int(at[lane]), int(stop[lane])):
                c = int(columns[i])
                t = int(known[s, c])
                if t < 0:
                    self._expand(s, used[c])
                    known = self.next
                    t = int(known[s, c])
                given[i] = self.out[s, c]
                s = t
            state[lane] = s
        out = np.empty_like(state)
        out[order] = state
        return out


def meeting(last: np.ndarray, state: tuple, lengths: np.ndarray) -> int:
    """How many symbols lie before the boundary at which all paths that survive in ``state`` meet.

    ``last``: the last token at every symbol since an earlier such boundary.  A path
    survives if it ends at the head, or where a piece may have begun that goes on
    beyond it.  The path that ends furthest on steps back by its last token until one
    boundary is left.
    """
    head = len(last)
    paths = {head, *(head - k for k, _, _ in state[2])}
    while len(paths) > 1:
        furthest = max(paths)
        paths.remove(furthest)
        paths.add(furthest - int(lengths[last[furthest - 1]]))
    return paths.pop()


def backtrack(last: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
    """Ids of all words in order, from the last tokens at every symbol.

    ``lengths``: symbols of each piece by id.  All words are walked back from their
    ends side by side; the result is sorted by position.  Returns ids and positions.
    """
    at = np.flatnonzero(ends)
    floor = np.r_[-1, at[:-1]]
    ids, places = [], []
    while len(at):
        token = last[at]
        ids.append(token)
        places.append(at)
        at = at - lengths[token]
        go = at > floor
        at, floor = at[go], floor[go]
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    ids, places = np.concatenate(ids), np.concatenate(places)
    order = np.argsort(places, kind="stable")
    return ids[order], places[order]
