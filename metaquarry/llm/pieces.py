"""Cutting oversized texts into overlapping pieces at natural boundaries, by pointer doubling.

Every token boundary of a text is joined to its farthest legal successor, the end of the piece
that starts `overlap` tokens before it. The table of successors is squared until the cuts reached
from the start cover the text: all greedy cuts of all texts of a batch in log2(pieces) steps."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.llm.bpe import DEFAULT, TOKENIZERS, Encoder, char_classes, encoder, vocabulary
from metaquarry.llm.tokens import by_size
from metaquarry.session import small

NONE, CHAR, WORD, SENTENCE, LINE, PARAGRAPH, END = -1, 0, 1, 2, 3, 4, 5
NAMES = ["char", "word", "sentence", "line", "paragraph", "end"]
FILL = 0.5

# Characters that end a sentence, those that do so only before white space first.
STOPS = ".!?;:…"
WIDE_STOPS = "。！？；"


@lru_cache(maxsize=1)
def _stops() -> np.ndarray:
    """1 for the characters of STOPS, 2 for those of WIDE_STOPS."""
    table = np.zeros(sys.maxunicode + 2, dtype=np.uint8)
    for kind, chars in ((1, STOPS), (2, WIDE_STOPS)):
        for c in chars:
            table[ord(c)] = kind
    return table


def boundary_levels(codes: np.ndarray, at: np.ndarray, words: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """The kind of boundary before character at[i] of a text: codes are its characters, words
    marks boundaries between words, safe those between characters."""
    n = len(codes)
    before, after = codes[np.maximum(at - 1, 0)], codes[np.minimum(at, n - 1)]
    blank = char_classes()[after] == 3
    newline = ((before == 10) | ((before == 13) & (after != 10))) & (after != 10) & (after != 13)
    breaks = np.cumsum(codes == 10)
    # Two line ends with nothing but white space between them: count back to the last visible character.
    visible = np.where(char_classes()[codes] != 3, np.arange(n), -1)
    last = np.maximum.accumulate(visible)[np.maximum(at - 1, 0)]
    ends = breaks[np.maximum(at - 1, 0)] - np.where(last >= 0, breaks[np.maximum(last, 0)], 0)
    kind = _stops()[before]
    stop = ((kind == 1) & blank) | (kind == 2)
    level = np.where(words, WORD, CHAR)
    level = np.where(words & stop, SENTENCE, level)
    level = np.where(words & newline, LINE, level)
    level = np.where(words & newline & (ends >= 2), PARAGRAPH, level)
    return np.where(safe, level, NONE)


def successors(level: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(next cut, start of the piece that ends there) for every boundary 0..n of one text.

    A piece after boundary b starts at the last boundary between characters that leaves `overlap`
    tokens before b, and ends at most `most` tokens later: at a paragraph, line or sentence if one
    lies in the farther part of the reach, else at any of them, else at a word, else anywhere
    between characters, else (a single character longer than the limit) behind it."""
    n = len(level) - 1
    idx = np.arange(n + 1)
    last = [np.maximum.accumulate(np.where(level >= k, idx, -1)) for k in range(END)]
    start = np.where(idx > 0, last[CHAR][np.maximum(idx - overlap, 0)], 0)
    reach = np.minimum(start + most, n)
    least = np.maximum(idx, start + overlap) + 1
    far = np.maximum(least, start + int(most * FILL))
    rules = [(reach == n, np.full(n + 1, n))]
    rules += [(last[k][reach] >= far, last[k][reach]) for k in (PARAGRAPH, LINE, SENTENCE)]
    rules += [(last[k][reach] >= least, last[k][reach]) for k in (SENTENCE, WORD, CHAR)]
    safe = np.where(level >= CHAR, idx, n + 1)
    following = np.minimum.accumulate(safe[::-1])[::-1]
    nxt = np.select([c for c, _ in rules], [v for _, v in rules], following[np.minimum(idx + 1, n)])
    nxt[n] = n
    return nxt, start


def all_cuts(nxt: np.ndarray) -> np.ndarray:
    """The boundaries reached from 0, ascending, by squaring the successor table."""
    hit = np.zeros(len(nxt), dtype=bool)
    hit[0] = True
    jump, n = nxt, 1
    while True:
        hit[jump[np.flatnonzero(hit)]] = True
        now = int(hit.sum())
        if now == n:
            return np.flatnonzero(hit)
        n, jump = now, jump[jump]


def cut_text(text: str, ids: np.ndarray, word_ends: np.ndarray, sizes: np.ndarray, most: int, overlap: int, enc: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start token, end token, start char, end char, level of the end) of the pieces of a text.

    ids are its tokens, word_ends the token boundaries between words, sizes the bytes of each id."""
    most, overlap = max(1, most), max(0, min(overlap, most - 1))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(ids)
    at_byte = np.concatenate([[0], np.cumsum(sizes[ids])])
    lead = np.append((raw & 0xC0) != 0x80, True)
    at_char = np.concatenate([[0], np.cumsum(lead[:-1])])[at_byte]
    safe = lead[at_byte]
    at_word = np.zeros(n + 1, dtype=bool)
    at_word[0] = True
    at_word[word_ends] = True
    bounds = np.flatnonzero(at_word)
    level = boundary_levels(codes, at_char, at_word, safe)
    level[0] = level[n] = END
    limit = most
    while True:
        nxt, start = successors(level, limit, min(overlap, limit - 1))
        cuts = all_cuts(nxt)
        begin, end = start[cuts[:-1]], cuts[1:]
        # A piece that starts or ends within a word may encode to more tokens by itself: its cut
        # words, and the word behind the first of them, are encoded again.
        loose = np.flatnonzero(~(at_word[begin] & at_word[end]))
        over = 0
        if len(loose):
            a, b = begin[loose], end[loose]
            head = np.where(at_word[a], a, np.minimum(bounds[np.minimum(np.searchsorted(bounds, a) + 1, len(bounds) - 1)], b))
            tail = np.where(at_word[b], b, np.maximum(bounds[np.searchsorted(bounds, b, side="right") - 1], head))
            ends = enc.count([text[at_char[x] : at_char[y]] for x, y in (*zip(a, head, strict=True), *zip(tail, b, strict=True))])
            over = int(max(0, (ends[: len(a)] + (tail - head) + ends[len(a) :]).max() - most))
        if over <= 0 or limit == 1:
            return begin, end, at_char[begin], at_char[end], level[end]
        limit = max(1, limit - over)


def split_oversized(docs: DataFrame, limits: DataFrame, *, tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, piece_no, start_token, end_token, start_char, end_char, n_tokens, shared_tokens,
    boundary, text): the pieces of each text with more tokens than its source allows, in order.

    Limits are max_tokens and overlap_tokens of the source, or of the row with a null source for
    others; without either, or with max_tokens null, a text is not cut. Pieces cover the text and
    have at most max_tokens tokens, counted in the text and, encoded by themselves, too; only a
    single character of more tokens is longer. A piece shares its last overlap_tokens with the
    next, one to three more where that many end within a character. shared_tokens is that number,
    0 for the last piece; boundary tells where it ends: paragraph, line, sentence, word, char, or end of the text. Null, empty and short texts give no
    row, equal texts are cut alike, further columns are ignored. Nothing is shuffled."""
    lim = limits.groupBy("source").agg(F.max(F.struct("max_tokens", "overlap_tokens")).alias("l"))
    own = small(lim.where("source is not null").select("source", F.col("l").alias("own")))
    row = lim.where("source is null").select("l.*").first()  # one row, the limits of all other sources
    rest = F.lit(None) if row is None else F.struct(F.lit(row[0]).cast("int").alias("max_tokens"), F.lit(row[1]).cast("int").alias("overlap_tokens"))
    d = docs.select("doc_id", "source", "text").where("length(text) > 0").join(own, "source", "left")
    d = d.select("doc_id", "text", F.coalesce("own", rest).alias("l")).select("doc_id", "text", F.col("l.max_tokens").cast("int").alias("most"), F.coalesce("l.overlap_tokens", F.lit(0)).cast("int").alias("overlap")).where("most is not null and octet_length(text) > most")

    held = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        sizes = np.zeros(max(enc.pieces) + 1, dtype=np.int64)
        for i, p in enc.pieces.items():
            sizes[i] = len(p)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            most, overlap = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b in by_size(texts):
                _, words, ids = enc.encode_split(texts[a:b])
                per_word = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                total = np.concatenate([[0], np.cumsum(per_word)])
                stop = np.cumsum(words)
                first = stop - words
                n = total[stop] - total[first]
                rows: list[list] = [[] for _ in range(9)]
                numbers: list[int] = []
                of: list[int] = []
                for i in np.flatnonzero(n > most[a:b]).tolist():
                    flat = np.fromiter((x for w in ids[first[i] : stop[i]] for x in w), dtype=np.int64, count=int(n[i]))
                    parts = cut_text(texts[a + i], flat, total[first[i] + 1 : stop[i] + 1] - total[first[i]], sizes, int(most[a + i]), int(overlap[a + i]), enc)
                    begin, end, c0, c1, level = (x.tolist() for x in parts)
                    of += [a + i] * len(begin)
                    numbers += range(len(begin))
                    for r, v in zip(rows, (begin, end, c0, c1, [y - x for x, y in zip(begin, end, strict=True)], [*(x - y for x, y in zip(end, begin[1:], strict=False)), 0], [NAMES[k] for k in level], [texts[a + i][x:y] for x, y in zip(c0, c1, strict=True)]), strict=False):
                        r += v
                if of:
                    ints = [pa.array(r, pa.int32()) for r in rows[:6]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(numbers, pa.int32()), *ints, pa.array(rows[6], pa.string()), pa.array(rows[7], pa.string())], names=["doc_id", "piece_no", "start_token", "end_token", "start_char", "end_char", "n_tokens", "shared_tokens", "boundary", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(cut_up, f"doc_id {kind}, piece_no int, start_token int, end_token int, start_char int, end_char int, n_tokens int, shared_tokens int, boundary string, text string")
