"""SentencePiece encoding and decoding for merge-type vocabularies.

Adjacent symbols merge in the order of a score-ordered agenda: the pair whose piece scores highest, leftmost among
equals, until no adjacent pair is a piece. Characters that no piece begins after, and spaces (which only begin pieces),
part a text into units that never merge with each other, so each unit has its own agenda. All new units of a batch
advance together: a round takes the head of every unit's agenda, merges it and renews the two pairs beside it.

Each new unit's ids are held against the sentencepiece library in the same Arrow batch, and so are whole texts of each:
the longest and the one of middle length. A difference raises. (Holding every whole text doubles the cost; tests do so.)
Ids are decoded by the library. A task keeps units in a two-generation cache of bounded size.

Defined results: null text encodes as empty text (begin and end ids only) and decodes to empty text; other columns are
ignored; a repeated row repeats its result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_rows, row_chunks, tidy

SPACE = "▁"
CACHE_UNITS = 200_000
TEXT_BYTES = 1 << 19
NEVER = np.int64(1) << 24
PLACE = 36
LONG_UNIT = 256


class MergeCodec:
    """A merge-type vocabulary: its pairs, their ranks, and the units of texts."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model)
        size = library.get_piece_size()
        pieces = library.id_to_piece(list(range(size)))
        special = [library.is_control(i) or library.is_unknown(i) or library.is_unused(i) for i in range(size)]
        byte = [library.is_byte(i) for i in range(size)]
        plain = {p: i for i, p in enumerate(pieces) if not special[i] and not byte[i]}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece holds a space after other characters")
        self.ids = dict(plain)
        for p in list(plain):  # a character that is no piece by itself is a symbol all the same
            for c in p:
                self.ids.setdefault(c, len(self.ids) + size)
        order = sorted({library.get_score(i) for i in plain.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(order)}
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (rank[library.get_score(i)], i)
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.pair.tolist()], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.pair.tolist()], np.int64)
        self.size = size
        self.byte_id = {bytes([int(pieces[i][1:-1], 16)]): i for i in range(size) if byte[i]}
        self.unknown = library.unk_id()
        self.bos, self.eos = library.bos_id(), library.eos_id()
        if any("\n" in p for p in plain):
            raise ValueError("a piece holds a newline")
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the pair, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, at, -1)

    def merge(self, units: list[str]) -> list[list[int]]:
        """Symbols of each unit when its agenda is empty."""
        length = np.array([len(u) for u in units], np.int64)
        text = "".join(units)
        chars, inverse = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        known = [self.ids.get(chr(c), -1 - int(c)) for c in chars]
        symbol = np.array(known, np.int64)[inverse]
        unit = np.repeat(np.arange(len(units)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        best = np.full(len(symbol), NEVER)
        n = len(symbol)
        i = np.flatnonzero(unit[:-1] == unit[1:]) if n else np.zeros(0, np.int64)
        at = self.lookup(symbol[i], symbol[i + 1])
        best[i[at >= 0]] = self.rank[at[at >= 0]]
        while n := len(symbol):
            lead = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1))
            head = np.minimum.reduceat(best << PLACE | np.arange(n) - np.repeat(lead, np.diff(np.concatenate((lead, [n])))), lead)
            busy = head < NEVER << PLACE
            if not busy.all():
                stay = np.repeat(busy, np.diff(np.concatenate((lead, [n]))))
                done.append((unit[~stay], symbol[~stay]))
                symbol, unit, best = symbol[stay], unit[stay], best[stay]
                if not (n := len(symbol)):
                    break
                lead = np.concatenate(([0], np.flatnonzero(unit[1:] != unit[:-1]) + 1))
                head = head[busy]
            x = lead + (head & ((1 << PLACE) - 1))
            symbol[x] = self.merged[self.lookup(symbol[x], symbol[x + 1])]
            keep = np.ones(n, bool)
            keep[x + 1] = False
            x -= np.arange(len(x))  # one symbol goes from each unit before
            symbol, unit, best = symbol[keep], unit[keep], best[keep]
            for y in (x - 1, x):
                y = y[y >= 0]
                inside = (y + 1 < len(symbol)) & (unit[y] == unit[np.minimum(y + 1, len(symbol) - 1)])
                near, end = y[inside], y[~inside]
                # a pair before the merged one counts only if it is of the same unit; the last symbol of a unit has none
                at = self.lookup(symbol[near], symbol[near + 1])
                best[near] = np.where(at >= 0, self.rank[at], NEVER)
                best[end] = NEVER
        if not done:
            return [[] for _ in units]
        unit, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(unit, kind="stable")
        symbol, bounds = symbol[order].tolist(), np.searchsorted(unit[order], np.arange(len(units) + 1))
        return [symbol[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def merge_long(self, unit: str) -> list[int]:
        """The same for one long unit, with its agenda as a heap."""
        symbol = [self.ids.get(c, -1 - ord(c)) for c in unit]
        after, before = [*range(1, len(unit)), -1], list(range(-1, len(unit) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(at: list[int]) -> None:
            a, b = np.array([symbol[i] for i in at]), np.array([symbol[after[i]] for i in at])
            for i, k in zip(at, self.lookup(a, b).tolist(), strict=True):
                if k >= 0:
                    heapq.heappush(agenda, (int(self.rank[k]), i, symbol[i], symbol[after[i]]))

        offer(list(range(len(unit) - 1)))
        gone = [False] * len(unit)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j < 0 or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i] = int(self.merged[self.lookup(np.array([a]), np.array([b]))[0]])
            gone[j], after[i] = True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer([k for k in (before[i], i) if k >= 0 and after[k] >= 0])
        return [s for s, x in zip(symbol, gone, strict=True) if not x]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as little-endian 32-bit integers, checked against the library."""
        chars = {i: c for c, i in self.ids.items() if i >= self.size}
        out = []
        short = iter(self.merge([u for u in units if len(u) <= LONG_UNIT]))
        for symbols in (next(short) if len(u) <= LONG_UNIT else self.merge_long(u) for u in units):
            ids = []
            for s in symbols:
                if 0 <= s < self.size:
                    ids.append(s)
                else:  # a character outside the vocabulary
                    raw = (chr(-1 - s) if s < 0 else chars[s]).encode()
                    ids += [self.byte_id[raw[k : k + 1]] for k in range(len(raw))] if self.byte_id else [self.unknown]
            out.append(np.array(ids, "<u4").tobytes())
        spaced = [u[1:].replace(SPACE, " ") if u[0] == SPACE and len(u) > 1 else "\n" + u for u in units]
        skip = [0 if u[0] == SPACE and len(u) > 1 else len(self.library.encode("\n")) for u in units]
        for u, mine, k, theirs in zip(units, out, skip, self.library.encode(spaced, num_threads=1), strict=True):
            if mine != np.array(theirs[k:], "<u4").tobytes():
                raise ValueError(f"the agenda and the library differ on {u!r}")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end ids, as little-endian 32-bit integers."""
        parts = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        missing = set().union(*parts) - self.young.keys()
        fresh = []
        for u in missing:
            if (known := self.old.get(u)) is not None:
                self.young[u] = known
            else:
                fresh.append(u)
        for k in range(0, len(fresh), 50_000):
            some = fresh[k : k + 50_000]
            self.young.update(zip(some, self.encode_units(some), strict=True))
        get = self.young.__getitem__
        bos, eos = int(self.bos).to_bytes(4, "little"), int(self.eos).to_bytes(4, "little")
        out = [bos + b"".join(map(get, p)) + eos for p in parts]
        if len(self.young) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        return out

    def check(self, text: str) -> None:
        """Hold a whole text against the library."""
        if np.frombuffer(self.encode([text])[0], "<u4").tolist() != self.library.encode(text, add_bos=True, add_eos=True):
            raise ValueError(f"the agenda and the library differ on {text[:200]!r}")

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<i4").tolist() for x in ids], num_threads=1)


def codec(model: str) -> MergeCodec:
    """This process's codec of a model file; it outlives the task that made it."""
    held = sys.modules.setdefault("_haulgraph_codecs", types.ModuleType("_haulgraph_codecs")).__dict__
    if model not in held:
        held[model] = MergeCodec(model)
    return held[model]


def _encode(model: str, shipped: str | None, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(SparkFiles.get(shipped) if shipped else model)
        try:
            for batch in batches:
                _, offsets = binary_rows(batch.column(1).cast(pa.binary()))
                order = np.argsort(np.diff(offsets), kind="stable")
                for k in {len(order) // 2, len(order) - 1} if len(order) else ():
                    own.check(batch.column(1)[int(order[k])].as_py() or "")
                for at, end in row_chunks(offsets, TEXT_BYTES):
                    texts = [t or "" for t in batch.column(1).slice(at, end - at).to_pylist()]
                    ids = own.encode(texts)
                    back = own.decode(ids)
                    columns = [batch.column(0).slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64())]
                    if whole:
                        columns += [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(back)]
                    else:
                        columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())]
                    yield pa.record_batch(columns, ["doc_id", "n_tokens", *(("ids", "decoded") if whole else ("ids_sha256", "decoded_sha256", "round_trip"))])
        finally:
            own.young, own.old = {}, {}

    return run


def encode_documents(docs: DataFrame, model: str, digests: bool = False, ship: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids and decoded text of every row of ``docs`` (doc_id, text); or their SHA-256 digests and whether the
    decoded text equals the text.

    ``model``: path of the model file on every executor; ``ship`` sends the driver's file to the executors first.
    """
    shipped = None
    if ship:
        docs.sparkSession.sparkContext.addFile(model)
        shipped = model.rpartition("/")[2]
    rest = "ids_sha256 string, decoded_sha256 string, round_trip boolean" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", F.col("text")).mapInArrow(tidy(_encode(model, shipped, not digests)), f"doc_id long, n_tokens long, {rest}")
