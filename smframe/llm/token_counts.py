"""Token counts by overlap resynchronisation (byte_bpe_50k.json).

Byte-level BPE encodes the pieces of its pre-tokeniser independently, and that scan keeps no state at a piece's
end. A huge text is encoded in overlapping chunks, each with the offsets of its piece boundaries. A boundary that
both neighbours have, before the left chunk's end, is stable: what precedes it, the left chunk saw whole; from it
on, both see the same text. The counts are spliced at the first such boundary; where the overlap has none (a run
without any boundary), the overlap is widened to the right until it has one or the text ends.

Null and empty texts have no tokens. Rows are independent: no shuffle, and ties or repeated rows don't matter.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a chunk, and of the least overlap on each side of its end.
CHUNK, OVERLAP = 4_000, 128

# White space as the library's pre-tokeniser takes it, the code points of Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of anything but white space left whole, with a space before: a coarsening of the pre-tokeniser's pieces.
COARSE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Counter:
    """Counts tokens of texts piece by piece; remembers pieces of up to `remembered` characters in all, and those of the chunk at hand."""

    def __init__(self, path: str, remembered: int = 3_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered, self.n, self.held, self.splices = remembered, {}, 0, 0
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else re.compile(r"(?!)")

    def pieces(self, text: str) -> tuple[list[str], list[int]]:
        """The coarse pieces of text, which holds no special token, and the tokens of each."""
        found = COARSE.findall(text)
        if new := [p for p in {*found} if p not in self.n]:
            size = sum(map(len, new))
            if self.held + size > self.remembered:
                self.n.clear()
                new = [*{*found}]
                self.held, size = 0, sum(map(len, new))
            self.held += size
            self.n.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        return found, [*map(self.n.__getitem__, found)]

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if not text:
            return 0
        found = self.special.findall(text) if "<" in text else ()
        parts = self.special.split(text) if found else [text]
        return len(found) + sum(self.spliced(p, chunk, overlap) if len(p) > chunk else sum(self.pieces(p)[1]) for p in parts)

    def spliced(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of text from overlapping chunks, joined at common stable boundaries."""
        start, total, end = 0, 0, chunk
        while True:
            left, counts = self.pieces(text[start:end])
            if end >= len(text):
                return total + sum(counts)
            ends = [*accumulate(map(len, left), initial=start)]
            begin = max(start, end - overlap)
            right = {*accumulate(map(len, COARSE.findall(text[begin : end + overlap])), initial=begin)} - {begin}
            common = next((k for k, at in enumerate(ends) if begin < at < end and at in right), None)
            if common is None:  # alignment fails: a wider overlap reaches further right
                end, overlap = end + overlap, 2 * overlap  # at least doubles, so a run without boundaries is read a few times at most
                continue
            total += sum(counts[:common])
            self.splices += 1
            start, end, overlap = ends[common], ends[common] + chunk, OVERLAP


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = b.column("text")
            n = [c.count(texts[i].as_py() or "", chunk, overlap) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
