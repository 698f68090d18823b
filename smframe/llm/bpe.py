"""BPE encoding and decoding by forced boundaries (word_bpe_49k.json).

A byte pair that occurs inside no vocabulary token, and whose bytes belong to different classes of the
pre-tokeniser (white space, letters, digits, the rest), is a certain cut: no token spans it, and the scan starts
afresh behind it. Texts are cut there, each fragment is encoded by the tokenizers library alone, and the ids are
concatenated. Fragments repeat, so each worker remembers a bounded number of them.

Null and empty texts have no tokens; ties, repeated rows and extra columns are carried row by row; no shuffle.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: ASCII letters and bytes beyond ASCII: between two of these there never is a certain cut.
UNCUT = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 digit, 3 any other ASCII byte, 9 not ASCII (never cut beside)."""
    kind = np.full(256, 9, np.uint8)
    kind[:128] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 0
    for lo, hi, k in (("0", "9", 2), ("A", "Z", 1), ("a", "z", 1)):
        kind[ord(lo) : ord(hi) + 1] = k
    return kind


def _byte_of() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def certain_cuts(tokenizer, suffix: str = "</w>") -> np.ndarray:
    """256 x 256: whether a text may be cut between two bytes."""
    back, inside = _byte_of(), np.zeros((256, 256), bool)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for token in tokenizer.get_vocab():
        raw = token.encode() if token in special else bytes(back[c] for c in token.removesuffix(suffix) if c in back)
        for pair in zip(raw, raw[1:]):
            inside[pair] = True
    lower = np.arange(256)
    lower[65:91] += 32
    kind = _classes()
    cut = (kind[:, None] != kind[None, :]) & (kind[:, None] < 9) & (kind[None, :] < 9) & ~inside[lower][:, lower]
    cut[ord("'"), :] = False  # an apostrophe may begin a contraction
    return cut


def cut_bytes(raw: bytes, cuts: np.ndarray) -> list[bytes]:
    """raw in pieces, cut at every certain boundary."""
    if len(raw) < 2:
        return [raw] if raw else []
    a = np.frombuffer(raw, np.uint8)
    at = [0, *(np.flatnonzero(cuts[a[:-1], a[1:]]) + 1).tolist(), len(raw)]
    return [raw[i:j] for i, j in zip(at, at[1:])]


class FragmentCoder:
    """Encodes and decodes texts fragment by fragment; remembers words of up to `remembered` bytes in all, their fragments, and those of the block at hand."""

    def __init__(self, path: str, remembered: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cuts, self.remembered, self.held = certain_cuts(self.tokenizer), remembered, 0
        vocabulary = self.tokenizer.get_vocab()
        self.names = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.names[i] = token
        self.numbers = [*map(str, range(len(self.names)))]
        #: Of a word, and of a fragment: its ids and its decoded tokens, each joined by spaces.
        self.words: dict[bytes, tuple[str, str]] = {}
        self.fragments: dict[bytes, tuple[str, str]] = {}

    def _cut(self, word: bytes) -> list[bytes]:
        if not word.translate(None, UNCUT):
            return [word]
        head = word[:-1]
        if not head.translate(None, UNCUT):
            return [head, word[-1:]] if head and self.cuts[head[-1], word[-1]] else [word]
        return cut_bytes(word, self.cuts)

    def _learn(self, words: list[bytes]) -> None:
        cut = [self._cut(w) for w in words]
        new = [f for f in {f for fs in cut for f in fs} if f not in self.fragments]
        for f, e in zip(new, self.tokenizer.encode_batch_fast([f.decode("utf-8", "surrogatepass") for f in new], add_special_tokens=False)):
            ids = e.ids
            self.fragments[f] = (" ".join([self.numbers[i] for i in ids]), " ".join([self.names[i] for i in ids]))
        for w, fs in zip(words, cut):
            if len(fs) == 1:
                self.words[w] = self.fragments[fs[0]]
            else:
                parts = [x for f in fs if (x := self.fragments[f])[0]]
                self.words[w] = (" ".join([x[0] for x in parts]), " ".join([x[1] for x in parts]))

    def code(self, text: str, block: int = 1 << 20) -> tuple[str, str]:
        """(ids joined by spaces, decoded text). White space is a certain cut, so a long text is taken in blocks of words."""
        ids, out, words = [], [], text.encode("utf-8", "surrogatepass").split()
        for k in range(0, len(words), block):
            part = words[k : k + block]
            rows = [*map(self.words.get, part)]
            if None in rows:
                new = [*{w for w, r in zip(part, rows) if r is None}]
                size = sum(map(len, new))
                if self.held + size > self.remembered:
                    self.words.clear(), self.fragments.clear()
                    new = [*{*part}]
                    self.held, size = 0, sum(map(len, new))
                self.held += size
                self._learn(new)
                rows = [*map(self.words.__getitem__, part)]
            ids += [r[0] for r in rows if r[0]]
            out += [r[1] for r in rows if r[0]]
        return " ".join(ids), " ".join(out)


@lru_cache(maxsize=2)
def coder(path: str) -> FragmentCoder:
    return FragmentCoder(path)


def encode(docs: DataFrame, path: str, ids_too: bool = False, decoded_too: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; where asked for, also ids and decoded."""
    more = ", ids array<int>" * ids_too + ", decoded string" * decoded_too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            texts, n, digests, parts, decoded = b.column("text"), [], [], [], []
            for i in range(len(texts)):
                ids, out = c.code(texts[i].as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                digests.append((hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(out.encode("utf-8", "surrogatepass")).hexdigest()))
                if ids_too:
                    parts.append(np.array(ids.split(), np.int32) if ids else np.zeros(0, np.int32))
                if decoded_too:
                    decoded.append(out)
            if not n:
                continue
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), *map(pa.array, zip(*digests))]
            if ids_too:
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.concatenate(parts))))
            if decoded_too:
                cols.append(pa.array(decoded, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids_too, *["decoded"] * decoded_too])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
