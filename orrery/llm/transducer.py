"""Token counts from a compiled finite-state transducer.

A vocabulary of pair merges is compiled, as far as texts need it, into a deterministic transducer over bytes. A prefix of a
piece keeps its encoding but for its last tokens, and which token ends at a place depends only on the one before it: the
two must be what the merges make of their bytes. So a state is the set of places where a token may still begin, each with
its node in the vocabulary's trie, the token that ends there and how many tokens lie behind; a transition reads a byte and
carries how many tokens the prefix's encoding gains.

Texts are normalized and split into pieces as arrays; a batch is cut into chunks of equal length, wherever the cuts fall.
A chunk's map takes each state in which it may be entered to a state and a count, and after its first piece boundary the
rest does not depend on the entry. Maps compose through a parallel prefix scan.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import equal_pieces, piece_keys, slices

CHUNK = 1 << 15
MOST_STATES = 120_000


class Merges:
    """A byte-level vocabulary of ranked merges whose last symbol of a piece carries a suffix."""

    def __init__(self, vocabulary: dict, merges: list, suffix: str):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.symbol = [shown[b] for b in range(256)] + [shown[b] + suffix for b in range(256)]  # 256 + b: b at the end
        self.rank = {}
        self.parts: dict[str, tuple[int, ...]] = {s: (i,) for i, s in enumerate(self.symbol) if s in vocabulary}
        for r, m in enumerate(merges):
            a, b = m if isinstance(m, (list, tuple)) else m.split(" ")
            self.rank[a, b] = r
            if a in self.parts and b in self.parts:
                self.parts[a + b] = self.parts[a] + self.parts[b]
        self._fits: dict[tuple[str, str], bool] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.token: list[str | None] = [None]
        for token, path in self.parts.items():
            if len(path) > 1 and self.encode(path) != [token]:
                continue  # no text's encoding holds it
            node = 0
            for s in path:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token.append(None)
                node = self.trie[node][s]
            self.token[node] = token

    def encode(self, path: tuple[int, ...]) -> list[str]:
        """What the merges make of symbols: the best-ranked pair is merged wherever it stands, and so on."""
        word = [self.symbol[s] for s in path]
        while len(word) > 1:
            best = min(zip(word, word[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(word):
                if i + 1 < len(word) and (word[i], word[i + 1]) == best:
                    out.append(word[i] + word[i + 1])
                    i += 2
                else:
                    out.append(word[i])
                    i += 1
            word = out
        return word

    def fits(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (found := self._fits.get((a, b))) is None:
            found = self._fits[a, b] = self.encode(self.parts[a] + self.parts[b]) == [a, b]
        return found


class Transducer:
    """States are numbered as they are met; 0 is the start of a piece. Tables are dropped and built anew when full."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._reset()

    def _reset(self) -> None:
        self.places: list[tuple] = [((0, None, 0),)]
        self.number = {self.places[0]: 0}
        self.column = np.full(512, -1, np.int32)
        self.columns = 0
        self.to = np.full((1024, 64), -1, np.int32)
        self.gain = np.zeros((1024, 64), np.int16)

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        m, met, after = self.merges, None, []
        for node, last, count in self.places[state]:
            child = m.trie[node].get(symbol)
            if child is None:
                continue
            token = m.token[child]
            if met is None and token is not None and m.fits(last, token):
                met = (token, count + 1)
            if m.trie[child]:
                after.append((child, last, count))
        if met is None:
            raise ValueError("the vocabulary lacks a byte")
        if symbol >= 256:
            return 0, met[1]
        token, gain = met
        key = (*[(n, t, c - gain) for n, t, c in after], (0, token, 0))
        if key not in self.number:
            self.number[key] = len(self.places)
            self.places.append(key)
        return self.number[key], gain

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and gains for many lanes at once; transitions not met before are compiled first."""
        column = self.column[symbol]
        if (column < 0).any():
            for s in np.unique(symbol[column < 0]):
                self.column[s] = self.columns
                self.columns += 1
            while self.columns > self.to.shape[1]:
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)], 1)
                self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)], 1)
            column = self.column[symbol]
        to = self.to[state, column]
        if (missing := np.flatnonzero(to < 0)).size:
            for key in np.unique(state[missing].astype(np.int64) * 512 + symbol[missing]):
                s, b = divmod(int(key), 512)
                target, gain = self._compile(s, b)
                while len(self.places) > len(self.to):
                    self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                    self.gain = np.concatenate([self.gain, np.zeros_like(self.gain)])
                self.to[s, self.column[b]], self.gain[s, self.column[b]] = target, gain
            to = self.to[state, column]
        return to, self.gain[state, column]

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, closed: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read data[start:end] for each lane from its entry state; `closed` lanes end a piece with their last byte."""
        state, total = entry.astype(np.int32), np.zeros(len(start), np.int64)
        order = np.argsort(start - end, kind="stable")  # longest first: the lanes that go on are the first ones
        size = (end - start)[order]
        s, t, at, shut = state[order], total[order], start[order], closed[order]
        for i in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -i, "left"))
            symbol = data[at[:n] + i].astype(np.int64)
            symbol[shut[:n] & (size[:n] == i + 1)] += 256
            to, gain = self.step(s[:n], symbol)
            s[:n] = to
            t[:n] += gain
        state[order], total[order] = s, t
        return state, total

    def full(self) -> bool:
        return len(self.places) > MOST_STATES

    def renew(self) -> None:
        self._reset()


class Maps:
    """Chunk maps over the live states: [chunk, entry] -> exit and count. They compose associatively."""

    def __init__(self, to: np.ndarray, count: np.ndarray):
        self.to, self.count = to, count

    def then(self, other: Maps) -> Maps:
        return Maps(np.take_along_axis(other.to, self.to, 1), self.count + np.take_along_axis(other.count, self.to, 1))

    def scan(self) -> Maps:
        """Inclusive prefix composition in a logarithmic number of rounds."""
        now, step = Maps(self.to.copy(), self.count.copy()), 1
        while step < len(now.to):
            joined = Maps(now.to[:-step], now.count[:-step]).then(Maps(now.to[step:], now.count[step:]))
            now = Maps(np.concatenate([now.to[:step], joined.to]), np.concatenate([now.count[:step], joined.count]))
            step *= 2
        return now


def piece_tokens(transducer: Transducer, data: np.ndarray, start: np.ndarray, end: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each piece data[start:end]; pieces are in order and do not overlap."""
    cut = start // chunk != (end - 1) // chunk
    whole = np.flatnonzero(~cut)
    out = np.zeros(len(start), np.int64)
    a, b = start[whole], end[whole]
    back, first = equal_pieces(data, a, b, piece_keys(data, a, b))  # equal pieces take equal paths
    rep = whole[first]
    _, counts = transducer.run(data, start[rep], end[rep], np.ones(len(rep), bool), np.zeros(len(rep), np.int32))
    out[whole] = counts[back]
    split = np.flatnonzero(cut)
    if not len(split):
        return out
    chunks = -(-len(data) // chunk)
    # the tail that each chunk leaves open, and the head of the piece that enters it
    tail, head, closes = np.full((chunks, 2), -1, np.int64), np.zeros((chunks, 2), np.int64), np.zeros(chunks, bool)
    for p in split.tolist():
        a, b = int(start[p]), int(end[p])
        tail[a // chunk] = a, (a // chunk + 1) * chunk
        for c in range(a // chunk + 1, (b - 1) // chunk + 1):
            head[c] = c * chunk, min(b, (c + 1) * chunk)
            closes[c] = b <= (c + 1) * chunk
    opened = np.flatnonzero(tail[:, 0] >= 0)
    left, left_count = transducer.run(data, tail[opened, 0], tail[opened, 1], np.zeros(len(opened), bool), np.zeros(len(opened), np.int32))
    live = np.unique(np.concatenate([[0], left]))
    entered = np.flatnonzero(head[:, 1] > head[:, 0])
    while True:  # pieces over whole chunks may leave further states open
        lanes, states = np.repeat(entered, len(live)), np.tile(live, len(entered))
        states_in = np.where(states == 0, -1, states)
        ok = states_in >= 0
        ends, gains = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int64)
        e, g = transducer.run(data, head[lanes[ok], 0], head[lanes[ok], 1], closes[lanes[ok]], states_in[ok].astype(np.int32))
        ends[ok], gains[ok] = e, g
        more = np.setdiff1d(ends, live)
        if not len(more):
            break
        live = np.union1d(live, more)
    to, count = np.zeros((chunks, len(live)), np.int64), np.zeros((chunks, len(live)), np.int64)
    if len(entered):
        to[entered] = np.searchsorted(live, ends.reshape(len(entered), -1))
        count[entered] = gains.reshape(len(entered), -1)
    through = np.flatnonzero((head[:, 1] > head[:, 0]) & ~closes)
    after_close = np.ones(chunks, bool)
    after_close[through] = False
    to[after_close] = 0  # a boundary within the chunk: what follows does not depend on the entry
    tail_count = np.zeros(chunks, np.int64)
    to[opened], tail_count[opened] = np.searchsorted(live, left)[:, None], left_count
    whole_map = Maps(to, count + tail_count[:, None])
    passed = whole_map.scan()
    entry = np.concatenate([[0], passed.to[:-1, 0]])
    inside = np.concatenate([[0], np.cumsum(count[np.arange(chunks), entry])])  # head counts, now that entries are known
    for p in split.tolist():
        a, b = int(start[p]) // chunk, int(end[p] - 1) // chunk
        out[p] = tail_count[a] + inside[b + 1] - inside[a + 1]
    return out


UNKNOWN = 4


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 blank, 1 letter, 2 number, 3 other; 4 where Python's Unicode tables have none."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            out[c] = 1
        elif kind[0] == "N":
            out[c] = 2
        elif kind == "Cn":
            out[c] = UNKNOWN
    out[[9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


@lru_cache(maxsize=1)
def _unknown() -> np.ndarray:
    return _classes() == UNKNOWN


def ask(tokenizer, codes: set[int]) -> None:
    """Classes that the library's own, newer tables give to code points that Python's lack."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    for c in codes:
        sign = chr(c)
        twice = len(cut(sign + sign))
        _classes()[c] = 0 if not cut(sign) else 2 if twice == 2 else 1 if len(cut("a" + sign)) == 1 else 3


def pieces(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of normalized texts end to end, as code points: runs of letters, single numbers, runs
    of other signs, and the English contractions where an apostrophe begins a piece."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[code]
    begins = np.zeros(n + 1, bool)
    begins[at] = True
    before = np.concatenate([[0], kind[:-1]])
    before[at[:-1][at[:-1] < n]] = 0
    first = (kind != 0) & ((kind != before) | (kind == 2))
    marks = np.flatnonzero((code == 39) & (before != 3))
    if len(marks):
        wide = np.concatenate([code, [0, 0]])
        limit = at[np.searchsorted(at, marks, "right")]
        a, b = np.where(marks + 1 < limit, wide[marks + 1], 0), np.where(marks + 2 < limit, wide[np.minimum(marks + 2, n)], 0)
        single = np.isin(a, [ord(c) for c in "stmd"])
        double = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        first[marks[single | double] + 1] = False
        for size, which in ((2, marks[single]), (3, marks[double])):
            nxt = which + size
            nxt = nxt[nxt < n]
            first[nxt] = kind[nxt] != 0
        # an apostrophe right after a contraction's letters begins anew; other signs there do by their class
    start = np.flatnonzero(first)
    stop = np.concatenate([start[1:], [n]])
    blank = np.concatenate([np.flatnonzero(kind == 0), [n]])
    edges = np.minimum(blank[np.searchsorted(blank, start)], stop)
    return start, np.minimum(edges, at[np.searchsorted(at, start, "right")])


def normalized(text: str, tokenizer=None) -> str:
    """NFC and lower case; texts with code points that Python's tables lack are left to the library's normalizer."""
    if not text.isascii():
        if tokenizer is not None:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            if _unknown()[code].any():
                text = tokenizer.normalizer.normalize_str(text)
                ask(tokenizer, {c for c in map(ord, set(text)) if _classes()[c] == UNKNOWN})
                return text
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # letter by letter: no final form
    return text.lower()


@lru_cache(maxsize=2)
def compiled(name: str) -> tuple[Transducer, tuple[str, ...], object]:
    """(transducer, special strings, the library's tokenizer) of a file whose normalizer is NFC, blanks and lower case.
    The library is asked about code points that are newer than Python's tables."""
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        spec = json.load(file)
    kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE" or not spec["model"]["end_of_word_suffix"]:
        raise ValueError(f"{name} is not of the kind that this compiles")
    model = spec["model"]
    return Transducer(Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])), tuple(t["content"] for t in spec["added_tokens"]), Tokenizer.from_file(public_tokenizers.path(name))


def count_tokens(texts: list[str], transducer: Transducer, special: tuple[str, ...], tokenizer, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text; special strings are one token each and end the text before them."""
    parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        rest = [text]
        for s in special:
            if any(s in r for r in rest):
                cut = [x.split(s) for x in rest]
                extra[i] += sum(len(c) - 1 for c in cut)
                rest = [y for c in cut for y in c]
        parts += [normalized(r, tokenizer) for r in rest]
        owner += [i] * len(rest)
    joined = "".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    start, end = pieces(code, at)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) != len(code):
        place = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
        first_byte, last_byte = place[start], place[end]
    else:
        first_byte, last_byte = start, end
    if transducer.full():
        transducer.renew()
    counts = piece_tokens(transducer, data, first_byte, last_byte, chunk)
    of = np.searchsorted(at, start, "right") - 1
    out = extra
    np.add.at(out, np.array(owner, np.int64)[of], counts)
    return out


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts are counted, without begin, end or added special tokens; special strings inside a text are one token. A
    null or empty text has no tokens. Repeated rows and rows with a null id each come back; other columns are not read;
    an empty table gives an empty result.
    """

    def count(batches):
        transducer, special, tokenizer = compiled(vocabulary)
        for batch, data, at in slices(batches, "text"):
            n = count_tokens([t or "" for t in batch.column("text").to_pylist()], transducer, special, tokenizer)
            yield pa.record_batch({"doc_id": batch.column("id").cast(pa.int64()), "n_bytes": pa.array(np.diff(at)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
