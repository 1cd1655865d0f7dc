"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``WINDOW`` words, half overlapping, over every whole text. Their TF-IDF vectors are over the words
of the benchmark items, less those in more than ``max_df`` of all passages (each item keeps its ``KEEP`` rarest).

1. One pass counts the passages that hold each word.
2. One pass is the sketch of a randomised SVD: every task adds A'(A R) over its passages for a random R of ``OVERSAMPLE``
   columns more than the rank; the sums meet in Spark by blocks of words. From the sketch Y = C R of C = A'A alone, C is
   approximated as Y (R'Y)^-1 Y' (Nystrom), whose eigenvectors are A's right singular vectors and whose eigenvalues are
   their squared singular values; those of the ``rank`` largest span the latent space.
3. One pass projects all passages, takes those whose cosine to an item reaches ``cosine`` and, whatever their cosine,
   those that hold enough of the item's rarer words (``_Shared``), and verifies each on the words of the passage and its
   surroundings: the longest common subsequence must cover ``copy`` of the item's words, or ``paraphrase`` of them while
   the item's answer, its last sentence, is there in order as well. An item of fewer than ``least`` words must be there
   whole and unbroken.

The route by shared words leaves out no passage that verification accepts, so results depend neither on the rank nor on
the cosine.

What is sent to every task, vocabulary, basis and items, is bounded: items are worked through in blocks of
``ITEM_BLOCK``, or of ``BLOCK_WORDS`` words, and each item is looked for as a whole, whatever its length.

Defined results: null or empty texts and items match nothing; an item that occurs twice is reported by each id; null ids
are carried as they are; one row for each document and item that match, with the best passage's figures (of rows that
repeat a doc_id, the best of all), and none for clean documents; texts of any length are read whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, U64, Scratch, binary_rows, row_chunks, runs, tidy, tidy_group, word_hashes
from .ngram_join import without

HALF = 32
WINDOW = 2 * HALF
KEEP = 8
ITEM_BLOCK = 512
BLOCK_WORDS = 1 << 20
LONG_ITEM = 2048
OVERSAMPLE = 16
CHUNK_BYTES = 1 << 20
BREAK = IS_SPACE.copy()
BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Vocabulary:
    """Word hashes to numbers, by a table on their low bits."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.bits = max(8, int(np.ceil(np.log2(max(2, len(words))))) + 6)
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot = (self.words & U64((1 << self.bits) - 1)).astype(np.int64)
        self.table[slot] = np.arange(len(words))
        clash = np.flatnonzero(self.table[slot] != np.arange(len(words)))
        self.clash = clash[np.argsort(self.words[clash])]

    def number(self, h: np.ndarray) -> np.ndarray:
        at = self.table[(h & U64((1 << self.bits) - 1)).astype(np.int64)].astype(np.int64)
        if not len(self.words):
            return at
        at[self.words[at] != h] = -1
        if len(self.clash):
            rest = self.words[self.clash]
            k = np.minimum(np.searchsorted(rest, h), len(rest) - 1)
            at = np.where(rest[k] == h, self.clash[k], at)
        return at


def _passages(batch_column, vocabulary: Vocabulary):
    """For chunks of rows: first row, rows, word hashes and rows, and the vocabulary's words: number, half window."""
    data, offsets = binary_rows(batch_column)
    for a, b in row_chunks(offsets, CHUNK_BYTES):
        h, row, _, _ = word_hashes(data, offsets[a : b + 1], space=BREAK)
        count = np.bincount(row, minlength=b - a)
        begin = np.cumsum(count) - count
        # each row has its words' half windows and an empty one after them, so windows never span rows
        halves = -(-count // HALF) + (count > 0)
        first = np.cumsum(halves) - halves
        half = first[row] + (np.arange(len(h)) - begin[row]) // HALF
        number = vocabulary.number(h)
        hit = np.flatnonzero(number >= 0)
        yield a, b, h, begin, count, first, int(halves.sum()), number[hit], half[hit]


def _count(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(vocabulary.words), np.int64), 0
        for batch in batches:
            for *_, n, number, half in _passages(batch.column(1), vocabulary):
                # a window is a half and the next one
                key = np.unique(np.concatenate((half, half - 1)) * len(seen) + np.concatenate((number, number)))
                seen += np.bincount(key % len(seen), minlength=len(seen))
                total += n
        yield pa.record_batch([pa.array(np.concatenate((np.arange(len(seen)), [-1]))), pa.array(np.concatenate((seen, [total])))], ["word", "passages"])

    return run


def _rows_of(matrix: np.ndarray, at: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return np.add.reduceat(matrix[at], lead, axis=0) if len(lead) else np.zeros((0, matrix.shape[1]), matrix.dtype)


def _windows(weighted: np.ndarray, number: np.ndarray, half: np.ndarray, n: int) -> np.ndarray:
    """Sums of the weighted rows over each window (a half and the next)."""
    lead = runs(half)[:-1]
    sums = np.zeros((n + 1, weighted.shape[1]), np.float32)
    if len(half):
        sums[half[lead]] = _rows_of(weighted, number, lead)
    return sums[:-1] + sums[1:]


def sketch(size: int, width: int) -> np.ndarray:
    """The random columns R."""
    return np.random.default_rng(5).standard_normal((size, width))


def right_vectors(y: np.ndarray, r: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest singular values of A and their right singular vectors, from Y = A'A R and R."""
    shift = np.sqrt(y.shape[0]) * np.finfo(float).eps * np.linalg.norm(y, 2) if y.any() else 0.0
    if not shift:
        return np.zeros(0), np.zeros((y.shape[0], 0))
    y = y + shift * r
    core = r.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    good = values > values[-1] * 1e-12
    half = y @ (turn[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(half, full_matrices=False)
    s = np.sqrt(np.maximum(s * s - shift, 0))
    keep = np.flatnonzero(s > s[0] * 1e-6)[:rank]
    return s[keep], u[:, keep]


WORDS_BLOCK = 64
#: Sums of tasks meet in so many groups first, so neither step holds more than its share of the tasks or these.
SUM_GROUPS = 1024


def _range(vocabulary: Vocabulary, weight: np.ndarray, rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = (weight[:, None] * sketch(len(weight), rank)).astype(np.float32)
        total = np.zeros((len(weight), rank), np.float64)
        for batch in batches:
            for *_, n, number, half in _passages(batch.column(1), vocabulary):
                live = weight[number] > 0
                number, half = number[live], half[live]
                if not len(number):
                    continue
                y = _windows(spread, number, half, n)
                both = y.copy()
                both[1:] += y[:-1]  # the two windows that a half is in
                order = np.argsort(number, kind="stable")
                lead = runs(number[order])[:-1]
                at = number[order][lead]
                total[at] += weight[at, None] * _rows_of(both, half[order], lead)
        for k in range(0, len(weight), WORDS_BLOCK):
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId() % SUM_GROUPS], pa.int32()), pa.array([total[k : k + WORDS_BLOCK].tobytes()], pa.binary())], ["block", "part", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
    first = table.slice(0, 1)
    return pa.table({"block": first.column("block"), "part": first.column("part"), "sums": pa.array([total.tobytes()], pa.binary())})


def places(a: list[int]) -> dict[int, int]:
    """Where each word stands, as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs_of(where: dict[int, int], n: int, b: list[int]) -> int:
    """Length of the longest common subsequence with ``n`` words of such places, by bit-parallel rows."""
    v = full = (1 << n) - 1
    for m in filter(None, map(where.get, b)):
        u = v & m
        v = (v + u | v - u) & full
    return n - v.bit_count()


def lcs(a: list[int], b: list[int]) -> int:
    return lcs_of(places(a), len(a), b)


class _Shared:
    """Windows that hold enough of an item's rarer words for its longest common subsequence to reach ``share``.

    A subsequence of ``need`` words holds all but the item's other words at most: with ``rare`` the item's rarest words up
    to where those left are fewer than ``need``, less ``least``, it has ``least`` of ``rare``. Each word counts as often as
    it is in the item, for each half window that holds it, so no sum is too low.
    """

    def __init__(self, vocabulary: Vocabulary, items: list[tuple], df: np.ndarray, share: float):
        self.least, self.reach, posts = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), []
        for i, (_, words, _) in enumerate(items):
            own, times = np.unique(vocabulary.number(np.array(words, U64)), return_counts=True)
            need = max(1, int(np.ceil(share * len(words) - 1e-9)))
            self.least[i], self.reach[i] = max(1, need // 3), -(-max(0, len(words) - HALF) // HALF)
            order = np.lexsort((own, df[own]))
            rare = order[: int(np.searchsorted(np.cumsum(times[order]), len(words) - need + self.least[i])) + 1]
            posts.append(np.stack((own[rare], np.full(len(rare), i), times[rare])))
        word, item, times = np.concatenate(posts, axis=1)
        order = np.argsort(word, kind="stable")
        self.item, self.times = item[order], times[order]
        self.begin = np.searchsorted(word[order], np.arange(len(vocabulary.words) + 1))

    def windows(self, number: np.ndarray, half: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items; a window's surroundings are ``reach`` halves to either side."""
        key = np.unique(half * len(self.begin) + number)
        half, number = key // len(self.begin), key % len(self.begin)
        many = self.begin[number + 1] - self.begin[number]
        at = np.repeat(self.begin[number] - np.cumsum(many) + many, many) + np.arange(many.sum())
        # of all halves of a window's surroundings, the first with a rare word sees the others after it
        stride = n + 2 * int(self.reach.max()) + 2
        key = self.item[at] * stride + np.repeat(half, many)
        order = np.argsort(key, kind="stable")
        lead = runs(key[order])[:-1]
        if not len(order):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, sums = key[order][lead], np.concatenate(([0], np.cumsum(np.add.reduceat(self.times[at][order], lead))))
        item = key // stride
        last = np.searchsorted(key, key + 2 * self.reach[item] + 1, side="right")
        enough = np.flatnonzero(sums[last] - sums[:-1] >= self.least[item])
        item, half = item[enough], key[enough] % stride
        wide = 2 * self.reach[item] + 2
        window = np.repeat(half - 1 - self.reach[item] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
        return np.clip(window, 0, n - 1), np.repeat(item, wide)


def _unbroken(words: list[int], text: list[int]) -> bool:
    """Whether ``words`` stand in ``text`` one after another."""
    n = len(words)
    return any(text[k : k + n] == words for k, x in enumerate(text[: len(text) - n + 1]) if x == words[0])


def _find(vocabulary: Vocabulary, latent: np.ndarray, items: list[tuple], item_latent: np.ndarray, shared: _Shared, cosine: float, copy: float, paraphrase: float, least: int):
    names = ["doc_id", "row_key", "item_id", "common", "share", "kind"]
    sets = [set(vocabulary.number(np.array(words, U64)).tolist()) for _, words, _ in items]
    lengths = [len(words) for _, words, _ in items]
    where = [places(words) for _, words, _ in items]
    repeats = [len(words) - len(own) for (_, words, _), own in zip(items, sets, strict=True)]
    telling = (latent != 0).any(1)
    widest = -(-max(0, max(len(words) for _, words, _ in items) - HALF) // HALF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, h, begin, count, first, n, number, half in _passages(batch.column(1), vocabulary):
                if not len(number):
                    continue
                window, item = shared.windows(number, half, n)
                pairs = [window * len(items) + item]
                # the vocabulary's words of every half window, one after another
                every, at_half = number, np.searchsorted(half, np.arange(n + 1))
                live = telling[number]
                number, half = number[live], half[live]
                used = np.unique(np.concatenate((half, np.maximum(half - 1, 0))))
                y = _windows(latent, number, half, n)[used]
                length = np.sqrt((y * y).sum(1))
                for k in range(0, len(used), 20_000):
                    near = (y[k : k + 20_000] @ item_latent.T) >= cosine * np.maximum(length[k : k + 20_000, None], 1e-6)
                    near &= length[k : k + 20_000, None] > 1e-6
                    w, i = np.nonzero(near)
                    pairs.append(used[k + w] * len(items) + i)
                best: dict[tuple[int, int], tuple] = {}
                key = np.unique(np.concatenate(pairs))
                # no subsequence is longer than the item's words that are there at all: first in the whole text, then around
                worded, ends = np.flatnonzero(count), np.concatenate((first[1:], [n]))
                owner = worded[np.searchsorted(first[worded], key // len(items), side="right") - 1]
                both, back = np.unique(owner * len(items) + key % len(items), return_inverse=True)
                can, last = np.zeros(len(both), bool), -1
                for k, (row, i) in enumerate(zip(*(x.tolist() for x in np.divmod(both, len(items))), strict=True)):
                    if row != last:
                        last, there = row, set(every[at_half[first[row]] : at_half[ends[row]]].tolist())
                    can[k] = repeats[i] + len(sets[i] & there) >= paraphrase * lengths[i]
                key, owner = key[can[back]], owner[can[back]]
                for k in range(0, len(key), 100_000):
                    last, near, tried = -1, None, {}
                    for window, i, row in zip(*(x.tolist() for x in np.divmod(key[k : k + 100_000], len(items))), owner[k : k + 100_000].tolist(), strict=True):
                        if window != last:
                            last = window
                            at, low, high = int(begin[row]) + (window - int(first[row])) * HALF, int(begin[row]), int(begin[row] + count[row])
                            wide = max(int(first[row]), window - widest), min(int(ends[row]), window + 2 + widest)
                            if wide != near:
                                near, there = wide, set(every[at_half[wide[0]] : at_half[wide[1]]].tolist())
                        if repeats[i] + len(sets[i] & there) < paraphrase * lengths[i]:
                            continue
                        reach = max(0, lengths[i] - HALF)
                        # windows of a long item that begin within a quarter of its length are looked at together
                        room = lengths[i] // 4 if lengths[i] > LONG_ITEM else 1
                        from_ = low + (at - low) // room * room
                        part = max(low, from_ - reach), min(high, from_ + room - 1 + WINDOW + reach)
                        if tried.get(i) == part:  # the same words as of the window before
                            continue
                        tried[i] = part
                        _, words, answer = items[i]
                        text = h[part[0] : part[1]].tolist()
                        if len(words) < least and not _unbroken(words, text):
                            continue
                        common = lcs_of(where[i], lengths[i], text)
                        share = common / len(words)
                        kind = "copy" if share >= copy else "paraphrase" if share >= paraphrase and lcs(answer, text) >= 0.8 * len(answer) else None
                        if kind and (old := best.get((row, i))) is None or kind and old[0] < common:
                            best[row, i] = (common, share, kind)
                if best:
                    keys = sorted(best)
                    rows = pa.array([r + a for r, _ in keys])
                    yield pa.record_batch([batch.column(0).take(rows), batch.column(2).take(rows), pa.array([items[i][0] for _, i in keys], pa.int64()), *(pa.array([best[x][j] for x in keys], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.string())))], names)

    return run


def _item(item_id, text: str) -> tuple:
    """Id, words and answer: the last sentence of three words or more, else the last six words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    words = word_hashes(raw, np.array([0, len(raw)]), space=BREAK)[0].tolist()
    ends = [i for i, c in enumerate(text[:-1]) if c in ".?!\n"]
    answer: list[int] = []
    for cut in reversed(ends):
        tail = np.frombuffer(text[cut + 1 :].encode(), np.uint8)
        answer = word_hashes(tail, np.array([0, len(tail)]), space=BREAK)[0].tolist()
        if len(answer) >= 3:
            break
    return item_id, words, answer if 3 <= len(answer) < len(words) else words[-6:]


def _matches(docs: DataFrame, benchmark: DataFrame, rank: int, max_df: float, cosine: float, copy: float, paraphrase: float, least: int) -> DataFrame:
    """doc_id, row_key (xxhash64 of the text as binary), item_id, common, share and kind of every match."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_key"))
    schema = "doc_id long, row_key long, item_id long, common int, share double, kind string"
    out = spark.createDataFrame([], schema)
    held: list[tuple] = []

    def search() -> DataFrame:
        vocabulary = Vocabulary(np.array(sorted({w for _, words, _ in held for w in words}), U64))
        size = len(vocabulary.words)
        counted = texts.mapInArrow(tidy(_count(vocabulary)), "word long, passages long").groupBy("word").agg(F.sum("passages").alias("n")).collect()
        df, total = np.zeros(size), 0
        for r in counted:
            if r["word"] < 0:
                total = r["n"]
            else:
                df[r["word"]] = r["n"]
        keep = df <= max_df * total
        for _, words, _ in held:
            own = np.unique(vocabulary.number(np.array(words, U64)))
            keep[own[np.lexsort((own, df[own]))[:KEEP]]] = True
        weight = np.where(keep, np.log((total + 1) / (df + 1)) + 1, 0).astype(np.float32)
        width = min(rank + OVERSAMPLE, size)
        schema_of_sums = "block int, part int, sums binary"
        parts = texts.mapInArrow(tidy(_range(vocabulary, weight, width)), schema_of_sums)
        parts = parts.groupBy("block", "part").applyInArrow(tidy_group(_add), schema_of_sums).groupBy("block").applyInArrow(tidy_group(_add), schema_of_sums).collect()
        if not parts:
            return out
        found = np.concatenate([np.frombuffer(r["sums"], np.float64) for r in sorted(parts, key=lambda r: r["block"])]).reshape(size, width)
        # items that no passage resembles have no direction of their own
        _, basis = right_vectors(found, sketch(size, width), rank)
        latent = (weight[:, None] * basis).astype(np.float32)
        vectors = np.stack([latent[vocabulary.number(np.array(words, U64))].sum(0) for _, words, _ in held])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-6)[:, None]
        return texts.mapInArrow(tidy(_find(vocabulary, latent, list(held), vectors.astype(np.float32), _Shared(vocabulary, held, df, paraphrase), cosine, copy, paraphrase, least)), schema)

    for r in benchmark.filter("text is not null").select("item_id", "text").toLocalIterator():
        item_id, words, answer = _item(r["item_id"], r["text"])
        if words:
            held.append((item_id, words, answer))
        if len(held) >= ITEM_BLOCK or sum(len(x[1]) for x in held) >= BLOCK_WORDS:
            out = out.unionByName(search())
            held = []
    if held:
        out = out.unionByName(search())
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 192, max_df: float = 0.01, cosine: float = 0.2, copy: float = 0.6, paraphrase: float = 0.55, least: int = 5) -> DataFrame:
    """doc_id, item_id, common, share and kind of every document of ``docs`` that holds an item of ``benchmark``."""
    out = _matches(docs, benchmark, rank, max_df, cosine, copy, paraphrase, least)
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("common", "share", "kind")).alias("best")).select("doc_id", "item_id", "best.common", "best.share", "best.kind")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 192, max_df: float = 0.01, cosine: float = 0.2, copy: float = 0.6, paraphrase: float = 0.55, least: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` less the documents (doc_id and text) that hold an item of ``benchmark``."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = _matches(docs, benchmark, rank, max_df, cosine, copy, paraphrase, least)
    return without(docs, scratch.cut(found.select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()))
