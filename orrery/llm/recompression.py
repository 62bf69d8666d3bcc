"""Repeated word windows, found by recompression.

A text's words are symbols. A round names maximal runs and then pairs: every symbol falls on one of two sides by a bit of
its name, and a left one followed by a right one become one symbol. Names are 64-bit hashes of what they stand for, so all
texts on all executors agree on them without an exchange. With each symbol goes the stretch of words that decides that it
stands there (its context); wherever these words stand again, so does the symbol. Hence equal windows share every symbol
whose context they hold: the first of these is a window's key, and only windows of one key are compared.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

FAR = 1 << 40
_MULT = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _MULT[0] + mixed(b * _MULT[1] + np.uint64(1)))


def runs(name: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Maximal runs of equal names become one symbol each. A run is known only with its neighbours in sight."""
    n = len(name)
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [n]]) - 1
    size = (last - at + 1).astype(np.uint64)
    left, right = np.maximum(at - 1, 0), np.minimum(last + 1, n - 1)
    low_ = np.where((at > 0) & (text[left] == text[at]), low[left], -FAR)
    high_ = np.where((last < n - 1) & (text[right] == text[at]), high[right], FAR)
    return np.where(size > 1, _named(name[at], size), name[at]), text[at], low_, high_


def pairs(name: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, turn: int) -> tuple:
    """Left symbols take the right symbol that follows; the others stay, known by the neighbour that did not take part."""
    n = len(name)
    side = (mixed(name + np.uint64((turn + 1) * int(_MULT[1]) % (1 << 64))) >> np.uint64(63)).astype(bool)  # True: right
    joins = np.zeros(n, bool)
    joins[:-1] = ~side[:-1] & side[1:] & (text[1:] == text[:-1])
    taken = np.zeros(n, bool)
    taken[1:] = joins[:-1]
    at = np.flatnonzero(~taken)
    nxt, prev = np.minimum(at + 1, n - 1), np.maximum(at - 1, 0)
    has_next, has_prev = (at + 1 < n) & (text[nxt] == text[at]), (at > 0) & (text[prev] == text[at])
    both = joins[at]
    look = np.where(side[at], prev, nxt)
    seen = np.where(side[at], has_prev, has_next)
    edge_low, edge_high = np.where(side[at], -FAR, low[at]), np.where(side[at], high[at], FAR)
    low_ = np.where(both, np.minimum(low[at], low[nxt]), np.where(seen, np.minimum(low[at], low[look]), edge_low))
    high_ = np.where(both, np.maximum(high[at], high[nxt]), np.where(seen, np.maximum(high[at], high[look]), edge_high))
    return np.where(both, _named(name[at], name[nxt]), name[at]), text[at], low_, high_


def symbols(name: np.ndarray, text: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and contexts [low, high) of the symbols after the rounds; contexts at a text's edge reach beyond it."""
    n = len(name)
    if not n:
        z = np.zeros(0, np.int64)
        return name, z, z
    now = runs(name, text, np.arange(n), np.arange(1, n + 1))
    for turn in range(rounds):
        now = pairs(*now, turn)
    return now[0], now[2], now[3]


def keys(name: np.ndarray, text: np.ndarray, before: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `width` words of a text, its key's context, as runs of neighbouring windows:
    (first window, windows, low, high). Windows without a symbol of their own have themselves as context."""
    many = np.maximum(np.diff(before) - width + 1, 0)
    window = np.repeat(before[:-1], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    _, low, high = symbols(name, text, rounds)
    held = high - low <= width
    low, high = low[held], high[held]
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    if len(low):
        least = np.minimum.accumulate(high[::-1])[::-1]  # the nearest end from each context on
        first = np.searchsorted(low, window)
        some = first < len(low)
        pick = np.minimum(first, len(low) - 1)
        while True:  # the first symbol from a window's start on that ends in time
            late = some & (high[pick] > window + width) & (least[pick] <= window + width)
            if not late.any():
                break
            pick[late] += 1
        fits = some & (high[pick] <= window + width)
        a, b = np.where(fits, low[pick], window), np.where(fits, high[pick], window + width)
    else:
        a, b = window, window + width
    new = np.ones(len(window), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    return window[at], np.diff(np.concatenate([at, [len(window)]])), a[at], b[at]
