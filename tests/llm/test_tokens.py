"""Token counts and BPE against the tokenizers library on the whole text."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from smframe.llm import bpe, token_counts

TEXTS = [
    "", " ", "\n", "a", "  a  b ", "Hello, world's best! it's I'LL we've 'tis ''s !'s", "tabs\tand\n\nnew  lines \n x", "ünï çödé ñandú ŉ İstanbul ǅ ΟΔΥΣΣΕΥΣ ﬁ", "日本語テキスト と 空白　全角", "x<|endoftext|> y <|startoftext|>z<|endoftext|", "12345 3.14 a1b2c3 --- ___ &&& $$$###", "é ́x a b c\u0085d\x1cx\x0bz", "no" * 500 + " end", "👩‍👩‍👧 emoji 🏳️‍🌈", "\r\n\r\n  \r\n", "don't'd've ('re) x's's",
]


def fuzz(n):
    r = random.Random(5)
    alphabet = [" ", "  ", "\n", "\t", "a", "B", "ing", "'", "s", "1", "é", "ß", "!", "<|endoftext|>", "́", " ", "日", "'ll", "-", "The", "\x1f", "\x1c", "\u180e", "\u200b", "\ufeff", "\x85", "\u2003"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    t, c = Tokenizer.from_file(path), token_counts.Counter(path, remembered=50)
    for x in TEXTS + fuzz(3000):
        want = len(t.encode(x, add_special_tokens=False).ids)
        assert c.count(x) == want, x
        assert c.count(x, chunk=7, overlap=2) == want, x
        assert c.count(x, chunk=16, overlap=5) == want, x


def test_documents_are_spliced_with_the_default_chunks(spark):
    """The registered query over sf0.01 equals the library on whole texts, and its texts are spliced."""
    from smframe.llm.queries import QUERIES

    path, d = public_tokenizers.path(token_counts.VOCABULARY), "/root/testdata/sf0.01"
    t, c = Tokenizer.from_file(path), token_counts.Counter(path)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op7_token_counts"](spark, d).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in docs.items()}
    assert {i: c.count(x) for i, x in docs.items()} == got
    assert c.splices >= sum(len(x) > token_counts.CHUNK for x in docs.values()) > 100, c.splices


def test_memory_is_bounded_by_characters():
    c = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY), remembered=5_000)
    for k in range(20):
        c.count(" ".join(f"{k}{j}" * 40 for j in range(50)))
        assert sum(map(len, c.n)) <= 5_000 + token_counts.CHUNK
    b = bpe.FragmentCoder(public_tokenizers.path(bpe.VOCABULARY), remembered=5_000)
    for k in range(20):
        b.code(" ".join(f"x{k}{j}" * 40 for j in range(20)))
        assert sum(map(len, b.words)) <= 10_000


def test_overlap_widens_where_no_boundary_is_found():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    t, c = Tokenizer.from_file(path), token_counts.Counter(path)
    x = "start " + "q" * 3000 + " middle " + " " * 900 + "end"
    assert c.count(x, chunk=100, overlap=4) == len(t.encode(x, add_special_tokens=False).ids)


def test_fragments_encode_and_decode_as_the_library():
    path = public_tokenizers.path(bpe.VOCABULARY)
    t, c = Tokenizer.from_file(path), bpe.FragmentCoder(path, remembered=40)
    for x in TEXTS + fuzz(3000):
        e = t.encode(x, add_special_tokens=False).ids
        ids, out = c.code(x, block=16)
        assert ids == " ".join(map(str, e)), x
        assert out == t.decode(e, skip_special_tokens=False), x


def test_cuts_are_certain():
    path = public_tokenizers.path(bpe.VOCABULARY)
    cuts = bpe.certain_cuts(Tokenizer.from_file(path))
    assert cuts[ord("a"), ord(".")] and cuts[ord(" "), ord("a")]
    assert not cuts[ord("'"), ord("s")] and not cuts[ord("a"), ord("b")] and not cuts[ord("|"), ord("s")]
    assert b"".join(bpe.cut_bytes(b"ab.cd 12", cuts)) == b"ab.cd 12"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b", "x", "n"), (1, "a b", "x", "n"), (2, None, "x", "n"), (None, "It's <|endoftext|> 5", None, None), (3, "", "x", "n"), (4, "word " * 70000, "x", "n")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids_sha256 string")


def test_operators_take_nulls_ties_and_clashing_columns(docs, spark):
    path = public_tokenizers.path(token_counts.VOCABULARY)
    t = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path).collect()
    src = docs.collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((r.doc_id or 0, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in src)
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0
    path = public_tokenizers.path(bpe.VOCABULARY)
    t = Tokenizer.from_file(path)
    want = []
    for r in src:
        e = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or 0, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(t.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    got = bpe.encode(docs, path).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert bpe.encode(docs.limit(0), path).count() == 0


def test_ids_and_texts_where_asked_for(spark):
    path = public_tokenizers.path(bpe.VOCABULARY)
    t = Tokenizer.from_file(path)
    texts = ["one two  three", "", None, "x1!y2", "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df, path, ids_too=True, decoded_too=True).collect()}
    for i, x in enumerate(texts):
        e = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].ids == e and got[i].decoded == t.decode(e, skip_special_tokens=False) and got[i].n_tokens == len(e)
