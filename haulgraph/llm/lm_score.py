"""Language-model scores by a weighted backoff automaton over the whole corpus.

The n-grams of a corpus need not fit anywhere at once. Documents are dealt into chunks of about ``CHUNK_TOKENS`` tokens.
Each chunk sends its distinct words and word pairs with their training counts to buckets of the hash range, where counts
meet; what other chunks know of too comes back, the rest a chunk knows itself. So each chunk holds exactly the part of
the corpus's automaton that its texts can reach:

* the root, with an arc for every word: log10((c + 0.5) / (N + 0.5 (V + 1)));
* a state for every training word (and the beginning of a text), with an arc for every training pair:
  log10((c(v, w) + m p(w)) / (c(v) + m)), p being the root's probability: Dirichlet smoothing with mass m;
* from each such state a failure arc to the root of weight log10(m / (c(v) + m)).

Each state's probabilities sum to one. One left-to-right traversal of a text carries the state and adds up the weights.
As the state after a token is the token's own, or the root, a chunk's traversals advance together as arrays.

Defined results: null text is empty text, a single end token; a null doc_id is not learned from and not held out; equal
rows score alike; without training tokens all probabilities are 1 (N = V = 0, c = 0); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, binary_rows, bucket_of, mix, pack, row_chunks, runs, tidy, tidy_group, unpack, word_hashes

CHUNK_TOKENS = 1_500_000
SLICE = 4 << 20
#: Text for each bucket of counts; buckets grow with the input, so what one task holds doesn't.
BUCKET_BYTES = 16 << 20
BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U64(0x9E3779B97F4A7C15) ^ mix(b))


def _with_ends(w: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each row with its end token: hash, row, and the hash before (the beginning's for the first)."""
    count = np.bincount(row, minlength=rows) + 1
    last = np.cumsum(count) - 1
    token = np.empty(len(w) + rows, U64)
    at = np.ones(len(token), bool)
    at[last] = False
    token[at], token[last] = w, END
    before = np.empty(len(token), U64)
    before[1:] = token[:-1]
    before[last - count + 1] = BEGIN
    return token, np.repeat(np.arange(rows), count), before


def _chunks(batches: Iterator[pa.RecordBatch]):
    """Chunks of whole documents: name, ids, whether each is learned from, tokens, rows, tokens before."""
    part, number = TaskContext.get().partitionId(), 0
    ids, learn, tokens, rows, before, held, docs = [], [], [], [], [], 0, 0

    def whole():
        return (part << 32) + number, pa.chunked_array(ids).combine_chunks(), np.concatenate(learn), np.concatenate(tokens), np.concatenate(rows), np.concatenate(before)

    for batch in batches:
        data, offsets = binary_rows(batch.column(1))
        for a, b in row_chunks(offsets, SLICE):
            w, row, _, _ = word_hashes(data, offsets[a : b + 1])
            t, r, p = _with_ends(w, row, b - a)
            ids.append(batch.column(0).slice(a, b - a))
            learn.append(batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool))
            tokens.append(t), rows.append(r + docs), before.append(p)
            held, docs = held + len(t), docs + b - a
            if held >= CHUNK_TOKENS:
                yield whole()
                number += 1
                ids, learn, tokens, rows, before, held, docs = [], [], [], [], [], 0, 0
    if docs:
        yield whole()


def _counted(h: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and how often each is learned."""
    order = np.argsort(h)
    h, learned = h[order], learned[order]
    lead = runs(h)
    return h[lead[:-1]], np.add.reduceat(learned.astype(np.int64), lead[:-1]).astype(np.uint32) if len(h) else np.zeros(0, np.uint32)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, learn, token, row, before in _chunks(batches):
            learned = learn[row]
            beginning = learned & (before == BEGIN)
            words = _counted(np.concatenate((token, [BEGIN])), np.concatenate((learned, [False])))
            words[1][words[0] == BEGIN] = beginning.sum()
            kinds = [words, _counted(pair_hash(before, token), learned)]
            cuts = [np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1)) for h, _ in kinds]
            for b in range(buckets):
                blobs = [pa.array([pack(x[c[b] : c[b + 1]])], pa.binary()) for (h, n), c in zip(kinds, cuts, strict=True) for x in (h, n)]
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([name], pa.int64()), *blobs], ["bucket", "chunk", "words", "word_counts", "pairs", "pair_counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Counts of what several chunks know of, for each; and this bucket's share of N and V."""
    chunks = np.array(table.column("chunk").to_pylist(), np.int64)
    out: dict[str, list] = {}
    tokens = distinct = 0
    for h_name, c_name in (("words", "word_counts"), ("pairs", "pair_counts")):
        hs = [unpack(x.as_py(), U64) for x in table.column(h_name)]
        who = np.repeat(np.arange(len(hs)), [len(x) for x in hs])
        h, n = np.concatenate(hs), np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column(c_name)]).astype(np.int64)
        del hs
        order = np.argsort(h, kind="stable")
        h, n, who = h[order], n[order], who[order]
        lead = runs(h)
        total = np.add.reduceat(n, lead[:-1]) if len(h) else n
        if h_name == "words":
            real = h[lead[:-1]] != BEGIN
            tokens, distinct = int(total[real].sum()), int((total[real] > 0).sum())
        size = np.diff(lead)
        total = np.repeat(total, size)
        keep = np.repeat(size > 1, size) & (total > n)
        h, total, who = h[keep], total[keep], who[keep]
        order = np.argsort(who, kind="stable")
        cuts = np.searchsorted(who[order], np.arange(len(chunks) + 1))
        h, total = h[order], total[order]
        out[h_name] = [pack(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        out[c_name] = [pack(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    first = np.arange(len(chunks)) == 0
    return pa.table({"chunk": pa.array(chunks), **{k: pa.array(v, pa.binary()) for k, v in out.items()}, "tokens": pa.array(np.where(first, tokens, 0)), "distinct": pa.array(np.where(first, distinct, 0))})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's documents as indices into its sorted words."""
    for name, ids, learn, token, row, _ in _chunks(batches):
        words, index = np.unique(token, return_inverse=True)
        yield pa.record_batch([pa.array([name], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([pack(learn.astype(np.uint8))], pa.binary()), pa.array([pack(words)], pa.binary()), pa.array([pack(index.astype(np.uint32))], pa.binary()), pa.array([pack(np.bincount(row, minlength=len(ids)).astype(np.uint32))], pa.binary())], ["chunk", "ids", "learn", "words", "index", "lengths"])


class Automaton:
    """A part of the automaton: states and arcs of some words and pairs."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, tokens: int, distinct: int, mass: float):
        self.words, self.counts, self.pairs, self.pair_counts, self.mass = words, counts, pairs, pair_counts, mass
        self.root = (counts + 0.5) / (tokens + 0.5 * (distinct + 1))

    def traverse(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log10 weight of each step: by the state's arc, or its failure arc and the root's arc."""
        with np.errstate(over="ignore"):
            key = pair_hash(self.words[state], self.words[token])
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        seen = np.where(self.pairs[at] == key, self.pair_counts[at], 0)
        c = self.counts[state]
        return np.log10((seen + self.mass * self.root[token]) / (c + self.mass))


def _total(h: np.ndarray, n: np.ndarray, blobs: list[tuple[bytes, bytes]]) -> np.ndarray:
    n = n.astype(np.int64)
    for a, b in blobs:
        n[np.searchsorted(h, unpack(a, U64))] = unpack(b, np.int64)
    return n


def _score(tokens: int, distinct: int, mass: float):
    names = ["doc_id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for x in left.to_pylist():
            learn, words, index, lengths = unpack(x["learn"], np.uint8) > 0, unpack(x["words"], U64), unpack(x["index"], np.uint32).astype(np.int64), unpack(x["lengths"], np.uint32).astype(np.int64)
            rows = len(lengths)
            row = np.repeat(np.arange(rows), lengths)
            own = np.bincount(index, learn[row], len(words)).astype(np.int64)
            words, own = np.concatenate((words, [BEGIN])), np.concatenate((own, [int(learn.sum())]))
            order = np.argsort(words)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words, own, index, begin = words[order], own[order], place[index], place[-1]
            state = np.empty_like(index)
            state[1:] = index[:-1]
            state[np.cumsum(lengths) - lengths] = begin
            pairs, pair_own = _counted(pair_hash(words[state], words[index]), learn[row])
            get = lambda a, b: list(zip(right.column(a).to_pylist(), right.column(b).to_pylist(), strict=True))
            counts, pair_counts = _total(words, own, get("words", "word_counts")), _total(pairs, pair_own, get("pairs", "pair_counts"))
            automaton = Automaton(words, counts, pairs, pair_counts, tokens, distinct, mass)
            step = automaton.traverse(state, index)
            base = np.log10(automaton.root)[index]
            out.append(pa.table([pa.array(x["ids"], pa.int64()), pa.array(learn), pa.array(lengths), pa.array(np.bincount(row, counts[index] > 0, rows).astype(np.int64)), pa.array(np.full(rows, tokens)), pa.array(np.bincount(row, base, rows)), pa.array(np.bincount(row, step, rows))], names))
        if not out:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, learn, mass: float = 48.0, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    ``learn``: a boolean column, true for rows to count n-grams in.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    asked = texts.mapInArrow(tidy(_ask(buckets)), "bucket int, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary")
    known = scratch.cut(asked.groupBy("bucket").applyInArrow(tidy_group(_answer), "chunk long, words binary, word_counts binary, pairs binary, pair_counts binary, tokens long, distinct long"))
    tokens, distinct = known.agg(F.sum("tokens"), F.sum("distinct")).first()
    parts = texts.mapInArrow(tidy(_texts), "chunk long, ids array<long>, learn binary, words binary, index binary, lengths binary")
    schema = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(tidy_group(_score(tokens or 0, distinct or 0, mass)), schema)
