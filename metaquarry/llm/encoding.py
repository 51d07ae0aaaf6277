"""Text that was decoded with the wrong encoding: finding it and restoring the original.

A best-first search goes over the texts that encoding with one code, decoding with another, and
unescaping can reach from a suspicious word. States are visited once, by their hash; a cost of
how plausible the characters are side by side orders the search and picks its result, the
cheapest text reached. Words without any doubtful character are not searched, and each different
word of a table is searched once."""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaquarry.session import BROADCAST_ROWS, cut, tasks_for

STEP_COST, RARE_COST, UTF8_COST = 0.6, 0.15, 0.1
SUSPICIOUS, GAIN = 0.7, 0.6
# The cost a character at which a word is searched as a whole, the cost that makes
# a character part of a spot, how far a spot reaches beyond its costly characters, and the letters
# it needs to be read in a code other than UTF-8.
LONG_SHARE, NOTABLE, NEAR, FARTHEST, LETTERS = 0.04, 0.3, 4, 64, 3

# The codes in which texts are read wrongly, and those in which they were written.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp1254", "cp1253")
DOUBLE = ("gb18030", "cp950", "cp932", "cp949")
LEGACY = ("cp1251", "cp1250", "cp1252", "cp950", "gbk", "cp932", "koi8-r", "cp866", "cp850", "cp437", "mac_roman", "cp949")
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "gbk", "utf-8")
COMMON = ("cp1252", "cp1250", "cp1251", "cp950", "gbk", "cp932")
AS_UTF8 = (*SINGLE, *DOUBLE)
AS_LEGACY = {a: [b for b in LEGACY if a != b and {a, b} != {"latin-1", "cp1252"}] for a in ("cp1252", "latin-1", "cp1251", "cp1250", "gbk", "cp950", "cp932", "koi8-r", "cp866", "cp850", "cp437", "mac_roman")}
# A word whose cost is above this pays its steps but those to UTF-8 in proportion to its cost, so
# that no way with more than two of them can pay off, however long the word. Steps to UTF-8 make
# a text shorter each time.
FULL_PRICE = 2.4

_RUN = re.compile("[^\x00-\x7f]+")
_CJK = re.compile("([\u3000-\u9fff\uac00-\ud7a3\uff00-\uff60\U00020000-\U0003ffff]+)")
_CUT = re.compile("[\x00-\x7f\u3000-\u3004\u3006-\u3020\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff60]")
_STRAY = re.compile("[\udc80-\udcff]")
_SPACE = re.compile("([ \t\r\n\f\v]+)")
_ESCAPED = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]\w+);|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[89A-Fa-f][0-9A-Fa-f]){2,}")

# Symbols that stand right after a letter in sound text.
AFTER = set("’‘”“»›…–—‐‑™®²³ªº°′″·´，。、；：！？）】」』〉》％‰")
# The replacement character, and it and the byte order mark read as a single-byte code.
MARKS = ("�", "ï¿½", "ï»¿")
PLAIN = set("’‘“”„‚–—…«»‹›•€°→≤≥≠")
# The cost of a letter of another script among its own kind, and where such begin.
OWN_SCRIPT, FIRST_SCRIPT = 0.02, 0x530
QUOTES_OPEN = set("“‘„‚«‹「『（《〈【")


def _to_bytes(text: str, code: str) -> bytes:
    """Encodes; where a single-byte code leaves positions free, they stand for the C1 characters."""
    try:
        return text.encode(code)
    except UnicodeError:
        if code not in ("cp1252", "cp1250", "cp1254", "cp1253"):
            raise
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(code) for c in text)


def _from_byte(b: int, code: str) -> str:
    try:
        return bytes([b]).decode(code)
    except UnicodeError:
        return chr(b)


def step_cost(op: tuple[str, str]) -> float:
    """What a step costs: UTF-8 rarely fits by chance, and codes that are read or written rarely
    cost more than the common ones."""
    a, b = op
    return UTF8_COST if b == "utf-8" else STEP_COST + RARE_COST * ((b not in COMMON) + (a not in READ_AS))


def apply(text: str, a: str, b: str) -> str | None:
    """The text read again: as bytes of code a, decoded with code b; None where that fails.

    UTF-8 is tried run by run of the characters beyond ASCII, as its sequences never mix with
    ASCII; other codes take the whole word."""
    if b == "utf-8":
        done = False

        def again(m: re.Match) -> str:
            nonlocal done
            try:
                raw = _to_bytes(m[0], a)
                new = raw.decode("utf-8", "surrogateescape")
            except UnicodeError:
                return m[0]
            if len(new) == len(raw):
                return m[0]
            done = True
            # Bytes that are no part of a sequence were right as they were.
            return _STRAY.sub(lambda x: _from_byte(ord(x[0]) & 0xFF, a), new)

        if a in DOUBLE:
            try:
                return _to_bytes(text, a).decode("utf-8")
            except UnicodeError:
                return None
        new = _RUN.sub(again, text)
        return new if done else None
    try:
        return _to_bytes(text, a).decode(b)
    except UnicodeError:
        return None


def unescape(text: str) -> str | None:
    """Entities, \\u and \\x escapes and percent signs replaced; None if there are none."""
    if not _ESCAPED.search(text):
        return None
    new = html.unescape(text)
    new = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), new)

    def percent(m: re.Match) -> str:
        try:
            return bytes.fromhex(m[0].replace("%", "")).decode("utf-8")
        except UnicodeError:
            return m[0]

    new = re.sub(r"(?:%[89A-Fa-f][0-9A-Fa-f])+", percent, new)
    return new if new != text else None


@lru_cache(maxsize=100_000)
def traits(c: str) -> tuple[str, float]:
    """(script or kind, cost by itself) of a character."""
    o = ord(c)
    if o < 128:
        return ("a" if c.isalpha() else "0" if c.isdigit() else " " if c in " \t\r\n" else "."), 0.0
    if c == "�":
        return "?", 8.0
    cat = unicodedata.category(c)
    if cat in ("Cc", "Co", "Cn", "Cs"):
        return "?", 4.0
    if cat == "Cf":
        return "s", 0.0 if o in (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF) else 1.5
    if cat[0] == "Z":
        return " ", 0.0
    if o < 0x250:
        return ("l", 0.0 if o < 0x100 else 0.05 if o < 0x180 else 1.0) if cat[0] == "L" and o not in (0xAA, 0xBA) else ("s", 0.1)
    if 0x1E00 <= o < 0x1F00:
        return "l", 0.1
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "g", 0.1
    if 0x400 <= o < 0x530:
        return "c", 0.0 if 0x410 <= o < 0x450 or c in "Ёё" else 0.7
    if 0x3040 <= o < 0x3100 or o in (0x30FC, 0x3005):
        return "k", 0.0
    if 0xFF61 <= o < 0xFFA0:
        return "h", 0.1
    if 0x3100 <= o < 0x3130:
        return "h", 1.5
    if 0x4E00 <= o < 0xA000:
        return "z", _han(c)
    if 0x3400 <= o < 0x4E00 or o >= 0x20000:
        return "z", 2.0
    if 0xAC00 <= o < 0xD7A4:
        return "o", 0.4
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        return "p", 0.0
    if 0x2500 <= o < 0x25A0:
        return "b", 0.1
    if cat[0] in "SPN":
        return "s", 0.0 if c in PLAIN else 0.1
    return "x", 1.2 if cat[0] == "M" else 1.5


def _han(c: str) -> float:
    """Han characters of the first level of a national set are common, others less so."""
    for code, low, high in (("big5", 0xA4, 0xC6), ("gb2312", 0xB0, 0xD7), ("euc_jp", 0xB0, 0xCF)):
        try:
            raw = c.encode(code)
        except UnicodeError:
            continue
        if len(raw) == 2 and low <= raw[0] <= high:
            return 0.0 if code != "gb2312" else 0.05
    for code in ("big5", "gb2312", "euc_jp"):
        try:
            c.encode(code)
        except UnicodeError:
            continue
        return 0.8
    return 1.6


def cost(text: str) -> float:
    """How implausible the characters of a word are, alone and side by side."""
    return sum(costs(text))


def cost_up_to(text: str, most: float) -> float:
    """The cost if it is below `most`, else some sum of at least that."""
    total = 0.0
    for c in costs(text):
        total += c
        if total >= most:
            break
    return total


def costs(text: str) -> Iterator[float]:
    """The share of each character in the cost of a word."""
    kinds = [traits(c) for c in text]
    latin_run = 0
    n = len(text)
    for i, c in enumerate(text):
        k, total = kinds[i]
        if k in "a0. " and c != "\xa0":
            latin_run = 0
            yield total
            continue
        p = text[i - 1] if i else " "
        pk = kinds[i - 1][0] if i else " "
        nk = kinds[i + 1][0] if i + 1 < n else " "
        if k == "l":
            latin_run += 1
            if latin_run >= 3:
                total += 0.5
            if c.isupper() and p.islower():
                total += 1.5
            if pk in "cg" or nk in "cg":
                total += 2.0
            if nk in "zko":
                total += 0.5
        else:
            latin_run = 0
        if k == "c":
            if pk in "al" or nk in "al":
                total += 2.0
            if c.isupper() and p.islower():
                total += 1.0
        elif k == "g":
            if pk in "alc" or nk in "alc":
                total += 1.0
        elif k == "b":
            if pk in "alczk" or nk in "alczk":
                total += 1.5
        elif k in "zk":
            if pk in "lc" or p.islower():
                total += 0.8
            if nk in "lc" or text[i + 1 : i + 2].islower():
                total += 0.8
        elif k == "x":
            if i and pk == "x" and ord(p) >> 8 == ord(c) >> 8 or nk == "x" and ord(text[i + 1]) >> 8 == ord(c) >> 8:
                total = OWN_SCRIPT if ord(c) >= FIRST_SCRIPT else total
        elif k == "o":
            if pk in "alc" or nk in "alc":
                total += 0.8
        elif k == "h":
            if pk in "zkgl" or nk in "zkgl":
                total += 0.6
            if pk == "a" or nk == "a":
                total += 0.8
        elif k == "s":
            before, after = pk in "alc", nk in "alc"
            if c == "\xad":
                total += 0.0 if pk == "a" and nk == "a" else 1.4
            elif before and after and c not in "’'·‐‑-–—…/":
                total += 2.0
            elif before and c not in AFTER:
                total += 1.6
            elif after and c not in QUOTES_OPEN and c not in "¿¡–—’§©®±~≈≤≥≠→←·•…“”‘€£¥$#№°":
                total += 1.2
            elif pk == "s" and c not in AFTER and p not in AFTER:
                total += 0.5
            if pk == "l" and p in "ÃÂâ" and c not in "’”»":
                total += 1.2
            if c in "¡¿" and nk == "l" and i + 2 == n and text[i + 1].isupper():
                total += 1.4
            if c in QUOTES_OPEN and pk in "al" and nk in "al.0":
                total += 0.6
        elif k == " " and p in ("Ã", "Â") and not text[max(i - 2, 0) : i - 1].isupper():
            total += 1.6
        yield total


@lru_cache(maxsize=200_000)
def restore_word(word: str) -> tuple[str, tuple[tuple[str, str], ...], bool]:
    """(cheapest text, the operations that lead there, whether the word is garbled).

    A long word is judged as a whole and then spot by spot, as a spot must not pass for sound
    because of the sound text around it; the operations are those of the whole word, else of its
    first spot. A word with a mark of a lost character is garbled though nothing restores it."""
    plain = unescape(word)
    if plain is not None:
        best, path, bad = restore_word(plain)
        return (best, (("unescape", ""), *path), True) if path else (word, (), bad)
    begin = cost(word)
    lost = any(m in word for m in MARKS)
    best, path = word, ()
    if begin >= max(SUSPICIOUS, LONG_SHARE * len(word)):
        best, path, _ = search(word)
    if begin >= SUSPICIOUS and len(word) * LONG_SHARE > SUSPICIOUS:
        best, first = restore_spots(best)
        path = path or first
    return best, path, lost or bool(path)


def spots(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the costly places of a long word; places less than NEAR apart are one."""
    begin = end = -1
    for i, c in enumerate(costs(text)):
        if c < NOTABLE:
            continue
        if begin >= 0 and i - end >= NEAR:
            yield begin, end
            begin = i
        begin, end = (begin if begin >= 0 else i), i + 1
    if begin >= 0:
        yield begin, end


def restore_spots(word: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    """(the word with its garbled spots restored, the operations of the first one).

    First the stretches without CJK characters, as a garbled spot among these need not touch any;
    then the whole, for codes that were read as CJK ones."""
    out, first = [], ()
    for i, stretch in enumerate(_CJK.split(word)):
        if i % 2 == 0 and _RUN.search(stretch):
            stretch, path = _restore_spots(stretch)
            first = first or path
        out.append(stretch)
    new, path = _restore_spots("".join(out)) if len(out) > 1 else (out[0], ())
    return new, first or path


def _restore_spots(word: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    """A spot is tried by itself, with a few neighbours, as its whole run up to ASCII or CJK
    punctuation, and with the word if that is short; what lowers the cost of the place most is
    taken, against fixed thresholds. Codes other than UTF-8 fit somewhere by chance, so they count
    for spots with a few letters and, as to Han characters, for whole runs only."""
    out, done, first = [], 0, ()
    for begin, end in spots(word):
        if begin < done:
            continue
        left, right = begin, end
        while left > done and begin - left < FARTHEST and not _CUT.match(word[left - 1]):
            left -= 1
        while right < len(word) and right - end < FARTHEST and not _CUT.match(word[right]):
            right += 1
        tries = [(begin, end), (max(begin - NEAR, done), min(end + NEAR, len(word))), (left, right)]
        if done == 0 and len(word) <= FARTHEST:
            tries.append((0, len(word)))
        chosen, most = None, 0.0
        for lo, hi in dict.fromkeys(tries):
            part = word[lo:hi]
            new, path, gain = search(part)
            kinds = [traits(c)[0] for c in part]
            weak = any(k in "zko" for k in kinds) and (lo, hi) != (left, right) or sum(k in "alcgzko" for k in kinds) < LETTERS
            if not path or weak and any(b != "utf-8" for _, b in path):
                continue
            before, after = word[max(lo - NEAR, done) : lo], word[hi : hi + NEAR]
            gain -= cost(before + new + after) - cost(new) - (cost(before + part + after) - cost(part))
            if gain >= GAIN and gain > most:
                chosen, most = (lo, hi, new, path), gain
        if chosen:
            lo, hi, new, path = chosen
            out += [word[done:lo], new]
            done = hi
            first = first or path
    return "".join(out) + word[done:], first


def steps(text: str, price: float, bound: float) -> Iterator[tuple[tuple[str, str], float, str]]:
    """(operation, what it costs, text it leads to) of all that cost less than bound."""
    new = unescape(text)
    if new is not None and STEP_COST * price < bound:
        yield ("unescape", ""), step_cost(("unescape", "")) * price, new
    if text.isascii():
        return
    if UTF8_COST < bound:
        for a in AS_UTF8:
            new = apply(text, a, "utf-8")
            if new is not None:
                yield (a, "utf-8"), UTF8_COST, new
    for a, codes in AS_LEGACY.items():
        if STEP_COST * price >= bound:
            break
        try:
            raw = _to_bytes(text, a)
        except UnicodeError:
            continue
        for b in codes:
            paid = step_cost((a, b)) * price
            if paid < bound:
                try:
                    yield (a, b), paid, raw.decode(b)
                except UnicodeError:
                    continue


@lru_cache(maxsize=200_000)
def search(word: str) -> tuple[str, tuple[tuple[str, str], ...], float]:
    """(cheapest text, the operations that lead there, what is gained by them); no operations
    where nothing better enough is reached. Texts are taken up cheapest first. The search ends
    when no queued text can become cheaper than the best one by what its steps cost already, so
    its result is exact; there is no limit to the texts it may visit but that cost."""
    begin = cost(word)
    if begin < SUSPICIOUS:
        return word, (), 0.0
    price = max(1.0, begin / FULL_PRICE)
    best, best_cost, best_path = word, begin, ()
    bound = min(begin - GAIN, 0.6 * begin) + 1e-9
    heap: list[tuple[float, int, str, tuple, float]] = [(begin, 0, word, (), 0.0)]
    count = 0
    visited = {hash(word): 0.0}  # of each text the least its steps have cost
    while heap:
        _, _, text, path, spent = heapq.heappop(heap)
        if spent > visited[hash(text)]:
            continue
        for op, price_of, new in steps(text, price, bound - spent):
            paid = spent + price_of
            # Nothing that is reached by this step can be cheaper than its steps.
            if paid >= min(bound, visited.get(hash(new), bound)):
                continue
            visited[hash(new)] = paid
            c = paid + cost_up_to(new, bound - paid)
            if c < best_cost:
                best, best_cost, best_path = new, c, (*path, op)
                bound = min(bound, c)
            if paid + UTF8_COST < bound:
                count += 1
                heapq.heappush(heap, (c, count, new, (*path, op), paid))
    decoded = any(op[0] != "unescape" for op in best_path)
    if decoded and begin - best_cost >= GAIN and best_cost <= 0.6 * begin:
        return best, best_path, begin - best_cost
    return word, (), 0.0


Found = dict[str, tuple[str, tuple[tuple[str, str], ...]]]


def restore(text: str, found: Found | None = None) -> tuple[str, bool]:
    """(the text with its garbled words restored, whether any is garbled).

    found has the garbled words with what they become and by which operations; if it is not given,
    each word is searched here. Words of a line that the search leaves alone are read again in the
    way of their neighbours if that does not make them less plausible, so short words follow the
    long ones."""
    if not _RUN.search(text) and not _ESCAPED.search(text):
        return text, False
    out, garbled = [], False
    for line in re.split("(\n)", text):
        if line.isascii() and "&" not in line and "\\" not in line and "%" not in line:
            out.append(line)
            continue
        words = _SPACE.split(line)
        ways: Counter = Counter()
        alone = []
        for i, w in enumerate(words):
            if _RUN.search(w) or _ESCAPED.search(w):
                if found is None:
                    new, path, bad = restore_word(w)
                else:
                    bad = w in found
                    new, path = found.get(w, (w, ()))
                garbled |= bad
                if path:
                    ways[path] += 1
                    words[i] = new
                elif not w.isascii():
                    alone.append(i)
        if ways:
            way = min(ways, key=lambda x: (-ways[x], x))
            for i in alone:
                new: str | None = words[i]
                for op in way:
                    new = new and (unescape(new) if op[0] == "unescape" else apply(new, *op))
                if new and cost(new) <= cost(words[i]) + 0.1:
                    words[i] = new
        out.append("".join(words))
    return "".join(out), garbled


# Words that cost nothing: lower case letters of Western Europe, three of them nowhere side by
# side, among ASCII; Cyrillic words, in capitals, small letters or with a first capital.
_OTHER = "[\\x00-@\\[-`{-\\x7f]"
PLAIN_WORD = f"^(?:(?:[\\x00-\\x7f]++|[ß-öø-ÿ](?![ß-öø-ÿ]{{2}}))*+|{_OTHER}*+(?:[А-ЯЁ]*+[а-яё]*+{_OTHER}++)*+[А-ЯЁ]*+[а-яё]*+)$"
BLANKS = "[ \\t\\r\\n\\f\\x0B]+"
DOUBTFUL = "[^\\x00-\\x7f]|&#?\\w+;|\\\\[ux][0-9a-fA-F]{2}|%[89A-Fa-f][0-9A-Fa-f]%"
ESCAPE = "&#?\\w+;|\\\\[ux][0-9a-fA-F]{2}|%[89A-Fa-f][0-9A-Fa-f]%"
SALTS = 16


def garbled_words(rows: DataFrame) -> DataFrame:
    """(record_key, text, word, becomes, ways) of each garbled word of the rows (record_key, text),
    once for each row it is in.

    Each different word is searched once: words are combined before the shuffle and dealt out
    evenly. Their verdicts go back to the rows by a broadcast if they are few, else by a join that
    is salted by the row, so a word that a third of the rows hold is not one task."""
    words = F.filter(F.array_distinct(F.split("text", BLANKS)), lambda w: w.rlike(DOUBTFUL) & (w.rlike(ESCAPE) | ~w.rlike(PLAIN_WORD)))
    within = rows.select("record_key", "text", F.explode(words).alias("word"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, new, ways = [], [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                best, path, bad = restore_word(w)
                if bad:
                    kept.append(i)
                    new.append(best)
                    ways.append([x for op in path for x in op])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64())), pa.array(new, pa.string()), pa.array(ways, pa.list_(pa.string()))], names=["word", "becomes", "ways"])

    different = rows.select(F.explode(words).alias("word")).distinct().repartition(tasks_for(rows))
    bad = cut(different.mapInArrow(look, "word string, becomes string, ways array<string>"))
    if bad.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return within.join(F.broadcast(bad), "word")
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return within.withColumn("salt", F.pmod(F.xxhash64("record_key"), F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"]).drop("salt")


def doubtful_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(record_key, text) of the rows that may be garbled: pure ASCII without escapes cannot be."""
    return rows.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("text")).where("record_key is not null").where(F.col("text").rlike(DOUBTFUL))


def garbled_keys(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(table_name, record_key) of the rows whose text is garbled, each key once. Null keys and
    null or empty texts are no case."""
    return garbled_words(doubtful_rows(rows, key, text)).select(F.lit(name).alias("table_name"), "record_key").distinct()


def garbled_texts(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(table_name, record_key, text, restored, is_complete) of the rows whose text is garbled.

    restored is the original as far as it can be reached; is_complete is false where marks of lost
    characters are left. Rows that repeat count once; null keys and null or empty texts are no
    case."""

    def put_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                known = {x["word"]: (x["becomes"], tuple(zip(x["ways"][::2], x["ways"][1::2], strict=True))) for x in found}
                new.append(restore(t, known)[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["record_key", "text", "restored"])

    # The words of one row: no more than its text holds.
    found = garbled_words(doubtful_rows(rows, key, text)).groupBy("record_key", "text").agg(F.collect_set(F.struct("word", "becomes", "ways")).alias("found"))
    new = found.mapInArrow(put_in, "record_key string, text string, restored string")
    return new.select(F.lit(name).alias("table_name"), "record_key", "text", "restored", (~F.col("restored").contains("�")).alias("is_complete"))
