import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows
from metaquarry.llm import bpe, tokens

tiktoken = pytest.importorskip("tiktoken")
# Fixed value: the pattern the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def plain():
    with open(os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(texts):
    flat, counts = bpe.encoder().encode(texts)
    out, at = [], 0
    for n in counts.tolist():
        out.append(flat[at : at + n].tolist())
        at += n
    return out


FIXED = ["", " ", "  ", "a", "it's 'store 're 'll'd", "x  y\n\n z \t", "é中文字🙂\u200b", "aaaaaaaaaaaaaaaa", "<|endoftext|>", "\r\n\r\n", "'", "''s", " 's", "1'm 23'42", "\u3000a\u00a0b", "x" * 5000, "'s'", "don't'"]


def test_fixed_texts(plain):
    assert ids(FIXED) == [plain(t) for t in FIXED]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'strevmld.-_19aé中\u3000\u00a0\u0301²")), st.characters(exclude_categories=["Cs", "Cn"])), max_size=30), max_size=6))
def test_any_texts(plain, texts):
    assert ids(texts) == [plain(t) for t in texts]


def test_long_random_text(plain):
    r = random.Random(1)
    text = "".join(r.choice(["CREATE ", "tbl_", "'", "0042", "\n", "  ", "資料", "ß", ";", "xyzzy"]) for _ in range(60_000))
    assert ids([text, text[:7]]) == [plain(text), plain(text[:7])]


def test_cache_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    e = bpe.Encoder(bpe.vocabulary())
    for t in ("alpha beta gamma delta", "epsilon zeta", "alpha"):
        assert e.encode([t])[0].tolist() == plain(t)
    assert len(e.words) < 9


def test_tables(spark, plain):
    df = spark.createDataFrame([(1, "it's", "z"), (2, None, "z"), (3, "", None), (None, "a b", "z"), (3, "", None)], "doc_id long, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.token_ids(df).collect()]
    assert got == [(1, plain("it's")), (2, []), (3, []), (None, plain("a b")), (3, [])]
    assert rows(tokens.token_counts(df, "doc_id", "ids").select("doc_id", "n_tokens")) == [(None, 2), (1, 2), (2, 0), (3, 0), (3, 0)]
    assert tokens.token_ids(df.limit(0)).collect() == []


def test_slices():
    texts = ["a" * 5, "", "b" * 5, "c" * 50, "d"]
    assert list(tokens.by_size(texts, 10)) == [(0, 3), (3, 4), (4, 5)] and list(tokens.by_size([], 10)) == []


def test_a_vocabulary_of_no_bound_is_refused(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="more than 10 bytes"):
        bpe.vocabulary()
