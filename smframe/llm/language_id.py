"""Language ID by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece; a word's probability is
the sum, over all ways to cut it into pieces, of the products of their probabilities: a forward pass in logarithms, one
character of all words at a time. No piece spans white space, so a text's logarithm is the sum of its words'. The
probabilities come from expectation maximisation: forwards and backwards over the counted words of a sample, expected
counts summed by Spark. Languages share what little they know of rare pieces: each falls back on all together.

A character that is no piece is one unknown piece. The prediction is the language of greatest posterior (its share of
training rows as prior); the score is that posterior. Equal ones go to the first language by name.

A null text, one without a letter, and any text where no language was learned are `und` with score 0. Null lang and null text teach nothing. A
null doc_id isn't held out. Repeated rows and ties are rows of their own; extra columns aren't read; no rows, none given.
The sample: all training rows of a language, or where there are more than `most`, those with the least hashes of doc_id and text, `most`
in expectation. Whole texts are read in either case; a worker remembers a bounded number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smframe.llm.common import discard, stored

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_LANGUAGE = "und"
#: Expected counts are summed as whole numbers of this share, so that no order of arrival changes a sum.
UNIT = 1 << 20


def pieces(path: str) -> list[str]:
    """The pieces of text of a SentencePiece vocabulary; no controls, bytes, or pieces across words."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    all_ = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return sorted({p for p in all_ if MARK not in p[1:]})


@dataclass(frozen=True)
class Trie:
    """The pieces by their characters: sorted keys (node << 21 | code point), the node each leads to, and the piece that ends in a node or -1."""

    keys: np.ndarray
    to: np.ndarray
    ends: np.ndarray
    slots: np.ndarray  #: of each hash the edge that has it, or -1; where several do, -2, and the keys are searched

    BITS = 20

    @staticmethod
    def hashed(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - Trie.BITS)).astype(np.int64)

    @staticmethod
    def of(words: list[str]) -> Trie:
        edges, ends = {}, [-1]
        for k, w in enumerate(words):
            node = 0
            for c in w:
                key = node << 21 | ord(c)
                node = edges.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = k
        keys = np.array(sorted(edges), np.int64)
        slots, h = np.full(1 << Trie.BITS, -1, np.int64), Trie.hashed(keys)
        slots[h] = np.arange(len(keys))
        slots[np.flatnonzero(np.bincount(h, minlength=len(slots)) > 1)] = -2
        return Trie(keys, np.array([edges[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64), slots)

    def step(self, node: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to; -1 where there is none."""
        key = node << 21 | c
        at = self.slots[Trie.hashed(key)]
        several = np.flatnonzero(at == -2)
        at[several] = np.minimum(np.searchsorted(self.keys, key[several]), len(self.keys) - 1)
        return np.where((at >= 0) & (self.keys[at] == key), self.to[at], -1)


class Lattice:
    """All pieces at all places of some words. Word k has nodes from first[k] (before it) to last[k] (behind it)."""

    def __init__(self, trie: Trie, words: list[str], unknown: int):
        marked = [MARK + w for w in words]
        n = np.fromiter(map(len, marked), np.int64, len(marked))
        self.first = np.cumsum(n + 1) - (n + 1)
        self.last = self.first + n
        size = int(n.sum())
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), n)
        place = np.arange(size) + word  # the node before each character
        left = np.repeat(np.cumsum(n), n) - np.arange(size)  # characters from here to the word's end
        found = []
        at, node, length = np.arange(size), np.zeros(size, np.int64), 0
        while len(at):
            node = trie.step(node, chars[at + length])
            length += 1
            alive = node >= 0
            at, node = at[alive], node[alive]
            piece = trie.ends[node]
            hit = piece >= 0
            found.append((at[hit], np.full(np.count_nonzero(hit), length), piece[hit]))
            if length == 1:  # a character that is no piece
                known = np.zeros(size, bool)
                known[at[hit]] = True
                rest = np.flatnonzero(~known)
                found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), unknown)))
            more = left[at] > length
            at, node = at[more], node[more]
        start, length, piece = (np.concatenate(x) for x in zip(*found))
        self.word, self.src, self.dst, self.piece = word[start], place[start], place[start] + length, piece
        self.nodes = size + len(words)
        self.time = np.arange(self.nodes) - np.repeat(self.first, n + 1)

    def _sweep(self, log_p: np.ndarray, back: bool) -> np.ndarray:
        """The logarithm of the sum over all ways from a word's start to each node; backwards, from each node to its end."""
        src, dst = (self.dst, self.src) if back else (self.src, self.dst)
        turn = -self.time[dst] if back else self.time[dst]
        order = np.lexsort((src, dst, turn))
        src, dst, turn, p = src[order], dst[order], turn[order], log_p[order]
        out = np.full((self.nodes, *log_p.shape[1:]), -np.inf)
        out[self.last if back else self.first] = 0.0
        begins = np.flatnonzero(np.append(True, turn[1:] != turn[:-1]))
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(turn)]):
            x = out[src[i:j]] + p[i:j]
            group = np.flatnonzero(np.append(True, dst[i + 1 : j] != dst[i : j - 1]))
            top = np.maximum.reduceat(x, group, axis=0)
            sizes = np.diff(np.append(group, j - i))
            out[dst[i:j][group]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes, axis=0)), group, axis=0))
        return out

    def scores(self, log_p: np.ndarray) -> np.ndarray:
        """The logarithm of each word's probability; log_p: (pieces, languages)."""
        return self._sweep(log_p[self.piece], False)[self.last]

    def expected(self, log_p: np.ndarray) -> np.ndarray:
        """The posterior probability of each match; log_p: of each match, in its word's language."""
        a, b = self._sweep(log_p, False), self._sweep(log_p, True)
        return np.exp(a[self.src] + log_p + b[self.dst] - a[self.last][self.word])


def runs(words: list[str], most: int = 200_000) -> Iterator[list[str]]:
    """words in runs of about `most` characters; those of like length meet, so that the sweeps are short."""
    words = sorted(words, key=len)
    k = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= most:
            yield words[k : i + 1]
            k, size = i + 1, 0
    if k < len(words):
        yield words[k:]


@dataclass(frozen=True)
class Model:
    """languages in order, their log priors, log_p (pieces and one for the unknown, languages), and the pieces' trie."""

    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray
    trie: Trie


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def estimate(counts: np.ndarray, back_off: float = 2000.0) -> np.ndarray:
    """log probabilities (pieces, languages) from expected counts: each language backs off on all, all on even shares."""
    all_ = counts.sum(1) + 0.1
    q = all_ / all_.sum()
    return np.log((counts + back_off * q[:, None]) / (counts.sum(0) + back_off))


def fit(docs: DataFrame, path: str, most: int = 2000, rounds: int = 3) -> Model | None:
    """The model of all languages that docs teach; None if there are none. most: training rows of a language, in expectation."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not n:
        return None
    languages, vocabulary = sorted(n), pieces(path)
    trie, unknown = Trie.of(vocabulary), len(vocabulary)
    number = F.create_map(*(F.lit(x) for k, v in enumerate(languages) for x in (v, k)))
    share = F.create_map(*(F.lit(x) for v in languages for x in (v, most / n[v])))
    u = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    words = known.where(u < share[F.col("lang")]).select(number[F.col("lang")].alias("k"), F.explode(F.split("text", r"\s+")).alias("word"))
    words = stored(words.where("word <> ''").groupBy("k", "word").agg(F.count(F.lit(1)).alias("n")))
    log_p = np.full((unknown + 1, len(languages)), -np.log(unknown + 1))
    for _ in range(rounds):
        counts = np.zeros(log_p.shape)
        # at most a row for each piece and language
        for r in expected_counts(words, trie, log_p).collect():
            counts[r["piece"], r["k"]] = r["n"] / UNIT
        log_p = estimate(counts)
    discard(words)
    rows = np.array([n[x] for x in languages], float)
    return Model(languages, np.log(rows / rows.sum()), log_p, trie)


def expected_counts(words: DataFrame, trie: Trie, log_p: np.ndarray) -> DataFrame:
    """k, piece, n: expected uses of each piece in each language's words (k, word, n), in units of 1 / UNIT."""
    size, languages = log_p.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * languages, np.int64)
        for b in batches:
            of: dict[str, list[tuple[int, int]]] = {}
            for k, w, n in zip(*(b.column(c).to_pylist() for c in ("k", "word", "n"))):
                of.setdefault(w, []).append((k, n))
            for run_ in runs([*of]):
                many = [(w, k, n) for w in run_ for k, n in of[w]]
                lattice = Lattice(trie, [w for w, _, _ in many], size - 1)
                k, n = (np.array([x[i] for x in many]) for i in (1, 2))
                share = lattice.expected(log_p[lattice.piece, k[lattice.word]])
                np.add.at(total, lattice.piece * languages + k[lattice.word], np.rint(share * n[lattice.word] * UNIT).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at % languages).astype(np.int32)), pa.array((at // languages).astype(np.int32)), pa.array(total[at])], ["k", "piece", "n"])

    return words.select("k", "word", "n").mapInArrow(run, "k int, piece int, n long").groupBy("k", "piece").agg(F.sum("n").alias("n"))


class Scorer:
    """Log probabilities of texts; remembers up to `remembered` words.

    Words of up to SHORT characters take the forward pass in plain numbers, scaled by SCALE for each character, which
    keeps them within the range of doubles; longer ones take it in logarithms.
    """

    SHORT, SCALE = 40, float(np.log(1000.0))

    def __init__(self, model: Model, remembered: int = 300_000):
        self.model, self.remembered = model, remembered
        lengths = np.zeros(len(model.log_p))
        lengths[-1] = 1
        # a piece's length is its depth in the trie; keys lead from lower to higher nodes
        depth = np.zeros(len(model.trie.ends), np.int64)
        for parent, to in sorted(zip((model.trie.keys >> 21).tolist(), model.trie.to.tolist()), key=lambda e: e[1]):
            depth[to] = depth[parent] + 1
        last = np.flatnonzero(model.trie.ends >= 0)
        lengths[model.trie.ends[last]] = depth[last]
        self.scaled = np.exp(model.log_p + self.SCALE * lengths[:, None])
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)))

    def _learn(self, words: set[str]) -> None:
        new, n = [*words], len(self.known)
        if n + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows[:n], np.zeros((n + 2 * len(new), len(self.model.languages)))])
        for run in runs(new):
            k = len(self.known)
            self.known.update(zip(run, range(k, k + len(run))))
            short = len(run[-1]) < self.SHORT
            self.rows[k : k + len(run)] = self._short(run) if short else Lattice(self.model.trie, run, len(self.model.log_p) - 1).scores(self.model.log_p)

    def _short(self, words: list[str]) -> np.ndarray:
        """The logarithm of each word's probability, all words a character at a time: what begins at one place lies together."""
        marked = [MARK + w for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        turns, n = int(size.max()), len(words)
        padded = "".join([w.ljust(turns, "\0") for w in marked]).encode("utf-32-le", "surrogatepass")
        chars = np.ascontiguousarray(np.frombuffer(padded, np.uint32).reshape(n, turns).T).astype(np.int64).ravel()
        at = np.flatnonzero((np.arange(turns)[:, None] < size[None, :]).ravel())
        left = size[at % n] - at // n
        node, length, matches = np.zeros(len(at), np.int64), 0, []
        while len(at):
            node = self.model.trie.step(node, chars[at + length * n])
            length += 1
            piece = np.where(node >= 0, self.model.trie.ends[node], -1)
            if length == 1:
                piece = np.where(piece < 0, len(self.model.log_p) - 1, piece)
            hit = np.flatnonzero(piece >= 0)
            src = at[hit]
            matches.append((length, src, piece[hit], np.searchsorted(src, np.arange(turns + 1) * n).tolist()))
            more = (node >= 0) & (left > length)
            at, node, left = at[more], node[more], left[more]
        out = np.zeros(((turns + 1) * n, len(self.model.languages)))
        out[:n] = 1.0
        for t in range(1, turns + 1):
            for length, src, piece, cuts in matches[:t]:
                i, j = cuts[t - length], cuts[t - length + 1]
                if i < j:
                    s = src[i:j]
                    out[s + length * n] += out[s] * self.scaled[piece[i:j]]
        return np.log(out[size * n + np.arange(n)]) - self.SCALE * size[:, None]

    def score(self, texts: list[str], block: int = 200_000) -> np.ndarray:
        """(texts, languages): the texts' log probabilities; what is new in about a block of words is learned at once."""
        out, held, size = np.zeros((len(texts), len(self.model.languages))), [], 0
        for i, t in enumerate(texts):
            words = t.split()
            for k in range(0, len(words), block):
                held.append((i, words[k : k + block]))
                size += len(held[-1][1])
                if size >= block:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, parts: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        words = set().union(*(w for _, w in parts))
        new = words.difference(self.known)
        if new and len(self.known) + len(new) > self.remembered:
            self.known, new = {}, words
        self._learn(new)
        for i, w in parts:
            out[i] += self.rows[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))].sum(0)
        if sum(map(len, new)) > 1 << 22:  # very long words aren't kept
            self.known = {}


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in batches:
            if not b.num_rows:
                continue
            known = np.flatnonzero(b.column("letters").to_numpy(zero_copy_only=False)) if scorer else np.zeros(0, np.int64)
            lang, score = [UNKNOWN_LANGUAGE] * b.num_rows, np.zeros(b.num_rows)
            texts = b.column("text")
            for k in range(0, len(known), 512):
                rows = known[k : k + 512]
                s = scorer.score([texts[i].as_py() for i in rows.tolist()]) + model.prior
                best = s.argmax(1)
                score[rows] = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                for i, j in zip(rows.tolist(), best.tolist()):
                    lang[i] = model.languages[j]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    src = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
