"""Byte-pair encoding with a public vocabulary, by an index of pair occurrences.

The distinct words of a batch of texts are laid out as one array of byte symbols. Every adjacent
pair is indexed under its rank with all its positions; active ranks are applied in ascending
order, and each application updates the lists of the neighbouring pairs. Every word that occurs
in many texts is merged once. Words are found by the classes of their characters, for all texts
of a batch at a time."""

from __future__ import annotations

import base64
import heapq
import os
import sys
import unicodedata
from functools import lru_cache

import numpy as np

TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k"
MOST_BYTES = 100_000_000
CACHED_WORDS, CACHED_PAIRS = 400_000, 500_000

# The endings that an apostrophe at the start of a word takes with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 0


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    table = np.zeros(sys.maxunicode + 2, dtype=np.uint8)
    kinds = {"L": LETTER, "N": DIGIT}
    for c in range(sys.maxunicode + 1):
        k = kinds.get(unicodedata.category(chr(c))[0], OTHER)
        if k:
            table[c] = k
    for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = SPACE
    return table


def word_starts(codes: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Marks the first character of each word. codes: the characters of texts laid end to end;
    text_start marks each text's first one.

    A word is a run of letters, numbers or other characters with one blank before it, or a run
    of white space up to the last character that is followed by something else; an apostrophe
    that starts a word and one of ENDINGS after it are a word."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = char_classes()[codes]
    change = np.empty(n, dtype=bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    run = change | text_start
    space = kind == SPACE
    last_of_run = np.empty(n, dtype=bool)
    last_of_run[-1] = True
    last_of_run[:-1] = run[1:]
    ends_text = np.empty(n, dtype=bool)
    ends_text[-1] = True
    ends_text[:-1] = text_start[1:]
    # The last white space before something else starts a word of its own, or of the next run.
    tail = space & last_of_run & ~ends_text
    start = run | tail
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = tail[:-1] & (codes[:-1] == 32)
    start &= ~(run & ~space & blank_before)
    apostrophe = np.flatnonzero((codes == 39) & start & last_of_run & ~ends_text)
    if len(apostrophe):
        nxt = np.minimum(apostrophe + 1, n - 1)
        nx2 = np.minimum(apostrophe + 2, n - 1)
        two = (nx2 > nxt) & ~text_start[nx2]
        hit = np.zeros(len(apostrophe), dtype=np.int64)
        for e in ENDINGS:
            ok = codes[nxt] == ord(e[0])
            if len(e) == 2:
                ok &= two & (codes[nx2] == ord(e[1]))
            hit = np.where((hit == 0) & ok, len(e), hit)
        a, h = apostrophe[hit > 0], hit[hit > 0]
        start[a + 1] = False
        after = a + 1 + h
        inside = after < n
        after = after[inside]
        letters = kind[after] == LETTER
        start[after[letters]] = True
    return start


def vocabulary(name: str = DEFAULT, folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file, read by the driver and small enough to be sent to the workers, which
    need not have the folder."""
    path = os.path.join(folder, f"{name}.tiktoken")
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError(f"{path} has more than {MOST_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Encodes words with the ranks of one vocabulary file."""

    def __init__(self, file: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pieces = {i: p for p, i in self.ids.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def pair(self, a: int, b: int) -> int:
        """The rank of a pair of symbols, which is the id of their union, or -1."""
        m = self.merge.get((a, b))
        if m is None:
            m = self.merge[(a, b)] = self.ids.get(self.pieces[a] + self.pieces[b], -1)
        return m

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of the words into the cache, all by one index of pairs."""
        sym: list[int] = []
        bounds = [0]
        single, ids = self.single, self.ids
        todo = []
        for w in words:
            raw = w.encode("utf-8", "surrogatepass")
            whole = ids.get(raw)
            if whole is not None:
                self.words[w] = (whole,)
                continue
            todo.append(w)
            sym += [single[b] for b in raw]
            bounds.append(len(sym))
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        for b in bounds[1:]:
            if b:
                nxt[b - 1] = -1
            if b < n:
                prv[b] = -1
        where: dict[int, list[int]] = {}
        pair = self.pair
        for i in range(n):
            j = nxt[i]
            if j >= 0:
                r = pair(sym[i], sym[j])
                if r >= 0:
                    where.setdefault(r, []).append(i)
        active = list(where)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            for i in sorted(where.pop(rank)):
                j = nxt[i]
                if j < 0 or sym[i] < 0 or pair(sym[i], sym[j]) != rank:
                    continue  # one of the two has been merged otherwise since
                sym[i] = rank
                k = nxt[i] = nxt[j]
                sym[j] = -1
                nxt[j] = -1
                if k >= 0:
                    prv[k] = i
                    r = pair(rank, sym[k])
                    if r >= 0:
                        at = where.get(r)
                        if at is None:
                            where[r] = [i]
                            heapq.heappush(active, r)
                        else:
                            at.append(i)
                h = prv[i]
                if h >= 0:
                    r = pair(sym[h], rank)
                    if r >= 0:
                        at = where.get(r)
                        if at is None:
                            where[r] = [h]
                            heapq.heappush(active, r)
                        else:
                            at.append(h)
        for w, a, b in zip(todo, bounds, bounds[1:], strict=False):
            self.words[w] = tuple(s for s in sym[a:b] if s >= 0)

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """All words of all texts in order, and each text's number of words."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text_start = np.zeros(len(codes), dtype=bool)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        text_start[begins[lengths > 0]] = True
        cut = np.flatnonzero(word_starts(codes, text_start))
        stops = [*cut[1:].tolist(), len(codes)][: len(cut)]
        words = [joined[a:b] for a, b in zip(cut.tolist(), stops, strict=True)]
        counts = np.searchsorted(cut, ends) - np.searchsorted(cut, begins)
        return words, counts

    def encode_split(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, ...]]]:
        """(words, words per text, ids of each word)."""
        words, counts = self.split(texts)
        cache = self.words
        if len(cache) > CACHED_WORDS:
            cache.clear()
        if len(self.merge) > CACHED_PAIRS:
            self.merge.clear()
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            self.encode_words(new)
        return words, counts, [cache[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        _, counts, ids = self.encode_split(texts)
        per_word = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for w in ids for i in w), dtype=np.int32, count=int(per_word.sum()))
        total = np.concatenate([[0], np.cumsum(per_word)])
        ends = np.cumsum(counts)
        return flat, total[ends] - total[ends - counts]

    def count(self, texts: list[str]) -> np.ndarray:
        """Ids per text."""
        _, counts, ids = self.encode_split(texts)
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]


@lru_cache(maxsize=4)
def encoder(file: bytes | None = None) -> Encoder:
    """One encoder per Python worker and vocabulary, with its cache of words."""
    return Encoder(vocabulary() if file is None else file)
