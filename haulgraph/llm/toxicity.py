"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of ASCII letters, digits and non-ASCII characters; a sequence is a line, however long.
Token labels come from document labels: of all words, prefixes and suffixes, those are chosen that toxic documents have and
hardly any others, beyond chance among as many features (near copies count once); tokens with a chosen feature in toxic
documents are toxic. The field has hashed features (the word, its affixes, both neighbours) and transitions, and is
trained on those tokens by its exact gradient. Forward-backward marginals give offending spans; their sum, largest
value and share feed a logistic regression on the document labels. All lines advance together in blocks of ``BLOCK`` tokens;
where a line goes on, a block's recursion is a product of two-by-two matrices that carries the state into the next block.

Training reads at most ``max_docs`` toxic and three times as many other labelled documents (those of least hash); it is a
fitted classifier, and that bound is its only sample. Scoring reads every whole text.

Defined results: null and empty texts get the score of a text without tokens; texts are read whole, whatever their length;
equal texts, repeated rows too, get equal scores; of rows with one doc_id the training takes one; labels of a doc_id that
appears more than once count as toxic if any is; rows with null labels are not used; without training rows
of both labels every score is the share of toxic ones (0 if there are none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, binary_rows, mix, row_chunks, runs, tidy, word_hashes

BREAK = np.zeros(256, bool)
BREAK[:128] = True
BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
AFFIXES = (3, 4, 5, 6, 7, -3, -4, -5)
FEATURES = 1 << 18
BLOCK = 64
CHUNK_BYTES = 1 << 19


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Row, start, end, sequence and features (a column each) of every token."""
    with np.errstate(over="ignore"):
        word, row, s, e, *affix = word_hashes(data, offsets, space=BREAK, affixes=AFFIXES)
        lo, hi = offsets[0], offsets[-1]
        newline = np.concatenate(([0], np.cumsum(data[lo:hi] == 10)))
        line = newline[s - lo] if len(s) else s
        fresh = np.ones(len(s), bool)
        fresh[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        sequence = np.cumsum(fresh) - 1
        before, after = np.zeros(len(s), U64), np.zeros(len(s), U64)
        before[1:] = np.where(sequence[1:] == sequence[:-1], word[:-1], U64(0))
        after[:-1] = np.where(sequence[1:] == sequence[:-1], word[1:], U64(0))
        near = [mix(before ^ U64(0x11)), mix(after ^ U64(0x22))]
        short = lambda x: (x >> U64(32)).astype(np.uint32)
        return row, s, e, sequence, [short(x) for x in (word, *affix)], [short(x) for x in near]


def _columns(own: list[np.ndarray], near: list[np.ndarray]) -> np.ndarray:
    return np.stack([(x % np.uint32(FEATURES)).astype(np.int32) for x in (*own, *near)])


class Field:
    """A chain of two labels: emission weights of features, transition potentials, and the documents' regression."""

    def __init__(self, weight: np.ndarray, transition: np.ndarray, bias: float):
        self.weight, self.transition, self.bias = weight, transition, bias
        self.regression = np.zeros(4)

    def emission(self, columns: np.ndarray) -> np.ndarray:
        return np.clip(self.weight[columns].sum(0) + self.bias, -30, 30)

    def marginals(self, emission: np.ndarray, line: np.ndarray):
        """Forward-backward over all lines at once: each token's probability of the toxic label.

        With two labels, the ratio of the forward values of the labels is all that is carried on, and likewise backward.
        """
        begin = np.flatnonzero(np.diff(line, prepend=-1))
        at = np.arange(len(line)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(line)])))) if len(line) else line
        place = at % BLOCK
        block = np.cumsum(place == 0) - 1
        depth = at[place == 0] // BLOCK
        n, width = len(depth), int(place.max()) + 1 if len(place) else 0
        grid = np.ones((width, n))
        live = np.zeros((width, n), bool)
        grid[place, block], live[place, block] = np.exp(emission), True
        t = np.exp(self.transition)
        enter, leave = self._carry(grid, live, depth, t)
        forward, backward = np.empty_like(grid), np.ones_like(grid)
        for k in range(width):
            f = forward[k - 1] if k else enter
            forward[k] = grid[k] * (t[0, 1] + f * t[1, 1]) / (t[0, 0] + f * t[1, 0])
            if k == 0:
                forward[0] = np.where(depth > 0, forward[0], grid[0])
        for k in range(width - 1, -1, -1):
            if k == width - 1:
                backward[k] = leave
            else:
                x = grid[k + 1] * backward[k + 1]
                backward[k] = np.where(live[k + 1], (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), leave)
        odds = forward * backward
        return (odds / (1 + odds))[place, block], (forward, backward, grid, live, t, enter, depth)

    def _carry(self, grid: np.ndarray, live: np.ndarray, depth: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forward ratio before each block and the backward ratio at its last token, where a line has several."""
        enter, leave = np.ones(len(depth)), np.ones(len(depth))
        deeper = np.concatenate((depth[1:] > 0, [False]))[: len(depth)]
        some = np.flatnonzero(deeper | (depth > 0))
        if not len(some):
            return enter, leave
        one, none = np.ones(len(some)), np.zeros(len(some))
        ahead, back = [one, none, none, one], [one, none, none, one]  # matrices by rows

        def times(a: list, b: list, on: np.ndarray, old: list) -> list:
            c = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
            size = sum(c)
            return [np.where(on, x / size, y) for x, y in zip(c, old, strict=True)]

        for k in range(len(grid)):
            x, on = grid[k, some], live[k, some]
            first = (depth[some] == 0) & (k == 0)
            step = [np.where(first, 0, x * t[1, 1]), np.where(first, x, x * t[0, 1]), np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0])]
            ahead = times(step, ahead, on, ahead)
            back = times(back, [x * t[1, 1], np.full_like(x, t[1, 0]), x * t[0, 1], np.full_like(x, t[0, 0])], on, back)
        turn = lambda m, r, i: (m[0][i] * r + m[1][i]) / (m[2][i] * r + m[3][i])
        order = np.argsort(depth[some], kind="stable")
        levels = np.searchsorted(depth[some][order], np.arange(depth.max() + 2))
        for d in range(depth.max() + 1):
            i = order[levels[d] : levels[d + 1]]
            go = i[deeper[some[i]]]
            enter[some[go] + 1] = turn(ahead, enter[some[go]], go)
        for d in range(depth.max(), 0, -1):
            i = order[levels[d] : levels[d + 1]]
            leave[some[i] - 1] = turn(back, leave[some[i]], i)
        return enter, leave

    def pairs(self, parts) -> np.ndarray:
        """Expected transitions."""
        forward, backward, grid, live, t, enter, depth = parts
        if not grid.size:
            return np.zeros((2, 2))

        def expected(r: np.ndarray, x: np.ndarray, on: np.ndarray) -> np.ndarray:
            cells = np.stack([np.broadcast_to(t[0, 0], r.shape), t[0, 1] * x, r * t[1, 0], r * t[1, 1] * x])
            return (cells / cells.sum(0) * on).reshape(4, -1).sum(1).reshape(2, 2)

        return expected(forward[:-1], grid[1:] * backward[1:], live[1:]) + expected(enter, grid[0] * backward[0], depth > 0)

    def document(self, p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Inputs of the documents' regression."""
        total, count = np.bincount(row, p, rows), np.bincount(row, minlength=rows)
        most = np.zeros(rows)
        np.maximum.at(most, row[p > 0.01], p[p > 0.01])
        return np.stack([np.ones(rows), most, np.log1p(total), total / np.maximum(count, 1)], 1)

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.regression, -30, 30)))


    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each row."""
        row, _, _, sequence, own, near = _tokens(data, offsets)
        p, _ = self.marginals(self.emission(_columns(own, near)), sequence)
        return self.scores(self.document(p, row, len(offsets) - 1))


def _distinct(word: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Documents to learn words from: of near copies (an equal least hash of five words, under either mix) the first."""
    with np.errstate(over="ignore"):
        n = max(0, len(word) - 4)
        h = sum((word[j : j + n].astype(U64) * U64(2 * j + 3) for j in range(5)), np.zeros(n, U64))
        same = row[:n] == row[4 : n + 4]
        keep = np.ones(rows, bool)
        for salt in (0x77, 0x99):
            least = np.full(rows, 2**64 - 1, U64)
            np.minimum.at(least, row[:n][same], mix(h[same] ^ U64(salt)))
            first = np.zeros(rows, bool)
            first[np.unique(least, return_index=True)[1]] = True
            keep &= first | (least == U64(2**64 - 1))
        return keep


def _telling(own: list[np.ndarray], row: np.ndarray, toxic: np.ndarray, use: np.ndarray, least: int, purity: float) -> np.ndarray:
    """Features that toxic documents have and hardly any others, beyond what chance explains among so many features."""
    share = max(1e-6, min(1 - 1e-6, toxic[use].mean()))
    seen = []
    for f in own:
        keep = use[row] & (f > 0)
        value, who = f[keep], row[keep]
        order = np.lexsort((who, value))
        value, who = value[order], who[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
        value, who = value[new], who[new]
        lead = runs(value)
        if len(value):
            seen.append((value[lead[:-1]], np.diff(lead), np.add.reduceat(toxic[who].astype(np.int64), lead[:-1])))
    if not seen:
        return np.zeros(0, np.uint32)
    value, count, bad = (np.concatenate(x) for x in zip(*seen, strict=True))
    q = np.clip(bad / count, 1e-9, 1 - 1e-9)
    surprise = count * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))  # Chernoff's bound
    tried = max(1, int((count >= least).sum()))
    return value[(bad >= least) & (q >= purity) & (surprise > np.log(tried))]


def _spans(sequence: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of about ``size`` tokens that part no line."""
    cuts = [0]
    while cuts[-1] < len(sequence):
        at = min(cuts[-1] + size, len(sequence))
        cuts.append(int(np.searchsorted(sequence, sequence[at - 1], side="right")))
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def train(texts: list[bytes], toxic: np.ndarray, shares: np.ndarray, steps: int = 30, least: int = 4, purity: float = 0.9, lessons: int = 400) -> Field:
    """A field from labelled documents; shares: how many documents each stands for.

    Words are chosen and the regression fitted on all of them, the field on the first ``lessons`` of either label.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    row, _, _, sequence, own, near = _tokens(data, offsets)
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)), -4.0)
    if toxic.any() and not toxic.all():
        found = _telling(own, row, toxic, _distinct(own[0], row, len(texts)), least, purity)
        label = np.zeros(len(row), bool)
        for f in own:
            label |= np.isin(f, found)
        label &= toxic[row]
        lesson = np.isin(row, np.concatenate([np.flatnonzero(toxic == y)[:lessons] for y in (False, True)]))
        columns, order, label = _columns([f[lesson] for f in own], [f[lesson] for f in near]), np.cumsum(np.diff(sequence[lesson], prepend=-1) != 0) - 1, label[lesson]
        same = order[1:] == order[:-1]
        seen = np.bincount((label[:-1] * 2 + label[1:])[same], minlength=4).reshape(2, 2)
        power, slow = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8)
        for _ in range(steps):
            p, parts = field.marginals(field.emission(columns), order)
            off = label - p
            slope = sum(np.bincount(c, off, FEATURES) for c in columns) - 0.1 * field.weight
            power += slope**2
            field.weight += 0.6 * slope / np.sqrt(power)
            turn = seen - field.pairs(parts) - 0.1 * field.transition
            slow += turn**2
            field.transition += 0.3 * turn / np.sqrt(slow)
        p = np.concatenate([field.marginals(field.emission(_columns([f[x:y] for f in own], [f[x:y] for f in near])), sequence[x:y] - sequence[x])[0] for x, y in _spans(sequence, 200_000)])
    else:
        p = np.zeros(len(row))
    inputs = field.document(p, row, len(texts))
    share = np.average(toxic, weights=shares) if len(texts) else 0.0
    field.regression[0] = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    if toxic.any() and not toxic.all():
        weight = shares / shares.sum()
        for _ in range(25):  # Newton steps with a small ridge
            q = field.scores(inputs)
            slope = inputs.T @ (weight * (toxic - q)) - 1e-4 * field.regression
            curve = (inputs * (weight * q * (1 - q))[:, None]).T @ inputs + 1e-4 * np.eye(4)
            field.regression += np.clip(np.linalg.solve(curve, slope), -3, 3)
    field.weight = field.weight.astype(np.float32)
    return field


def _score(field: Field, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_rows(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                part = offsets[a : b + 1]
                row, s, e, sequence, own, near = _tokens(data, part)
                p, _ = field.marginals(field.emission(_columns(own, near)), sequence)
                score = field.scores(field.document(p, row, b - a))
                columns, names = [batch.column(0).slice(a, b - a), pa.array(score)], ["doc_id", "score"]
                if spans:
                    out: list[list[dict]] = [[] for _ in range(b - a)]
                    for k in np.flatnonzero(p >= 0.5):
                        at = part[row[k]]
                        chars = lambda x, at=at: int(((data[at:x] & 0xC0) != 0x80).sum())
                        out[row[k]].append({"start": chars(s[k]), "stop": chars(e[k]), "p": float(p[k])})
                    columns.append(pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))))
                    names.append("spans")
                yield pa.record_batch(columns, names)

    return run


def _reject(field: Field, position: int, at_least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_rows(batch.column(position).cast(pa.binary()))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                stays = field.rows(data, offsets[a : b + 1]) < at_least
                yield batch.slice(a, b - a).filter(pa.array(stays))

    return run


def reject(docs: DataFrame, field: Field, at_least: float = 0.3) -> DataFrame:
    """``docs`` less the rows that score ``at_least`` or more, each row by its own text."""
    return docs.mapInArrow(tidy(_reject(field, docs.columns.index("text"), at_least)), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 400) -> Field:
    """Train on ``docs`` (doc_id, text) whose doc_id is in ``labels`` (doc_id, toxic)."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # one pass over the labels: how many there are of each, and the chosen ids
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = {r["doc_id"]: r["toxic"] for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs * (3 - 2 * y)).collect()}
    wanted = docs.sparkSession.createDataFrame([(k,) for k in sorted(chosen)], "doc_id long")
    # one text of each id, so what comes to the driver is bounded in rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(wanted), "doc_id")
    texts = sorted((r["doc_id"], bytes(r["text"] or b"")) for r in found.groupBy("doc_id").agg(F.max("text").alias("text")).collect()) if chosen else []
    toxic = np.array([chosen[k] == 1 for k, _ in texts], bool)
    shares = np.where(toxic, total.get(1, 0) / max(1, toxic.sum()), total.get(0, 0) / max(1, (~toxic).sum()))
    return train([t for _, t in texts], toxic, shares)


def score(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """doc_id, score and, if asked for, offending character spans of every row of ``docs``."""
    more = ", spans array<struct<start int, stop int, p double>>" if spans else ""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_score(field, spans)), f"doc_id long, score double{more}")
