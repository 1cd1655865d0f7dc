"""N-gram Jaccard join of whole texts, with set-relation skipping.

A set is the distinct ``n``-word shingles of a text. Two sets link when 100 * |intersection| >= percent * |union|.

* **Index lists.** Every shingle's list of distinct sets is built once, in buckets of the hash range; a shingle of one
  set only can link nothing and stays behind. Sets order their shingles rare first, and only the lists of a set's
  prefix are probed: two linked sets share a shingle in their prefixes.
* **Blocks by position.** Within a list, entries are sorted by set size and cut into blocks that keep their smallest
  and largest size and smallest prefix position; a probe skips each block whose bound on the overlap is too low.
* **Derived answers.** Each list names pivots, the sets of least hash. The shingles of a set whose list names the same
  pivot are a lower bound of its overlap with that pivot; where the bound suffices the two are linked, and the set's
  answers are derived from the pivot's: whatever is already reachable through a pivot is not probed again. Only pairs of
  sets in different components are left. They are verified in order of their least shared shingle, which brings similar
  sets together: of a set A with computed overlaps and the next set B, an overlap of B with C is within |A less B| and
  |B less A| of that of A with C, so most of B's answers follow from A's and only the rest are intersected.

Equal sets (one 64-bit digest) are one node, so copies cost their own rows only. Shingles are 64-bit hashes.

Defined results: null text or text without words is an empty set and links with nothing; a text with fewer words than
``n`` is one shingle, its whole sequence; each input row gives one output row, so a repeated doc_id repeats; a null
doc_id takes part and never is a component id while its component has another; rows of one doc_id are told apart by their
texts; ``drop_near_copies`` keeps all columns, whatever their names, and the others ignore them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, binary_rows, bucket_of, components, mix, pack, row_chunks, runs, tidy, tidy_group, unpack, word_hashes

CHUNK_BYTES = 1 << 20
FLUSH = 1_500_000
BUCKET_ENTRIES = 3_000_000
BLOCK = 64
#: Sets tried as hubs of each list in the rounds before the exhaustive one (0), which only sees what they leave apart.
HUB_ROUNDS = (1, 0)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row and hash, sorted by both, and the size of each row's set."""
    with np.errstate(over="ignore"):
        rows = len(offsets) - 1
        w, row, _, _ = word_hashes(data, offsets)
        count = np.bincount(row, minlength=rows)
        begin = np.concatenate(([0], np.cumsum(count)))
        weight = mix(np.arange(n, dtype=U64) + U64(991))
        h = np.zeros(len(w), U64)
        for j in range(n):
            h[: len(w) - j] += w[j:] * weight[j]
        left = begin[row + 1] - np.arange(len(w))
        whole = left >= n
        h = mix(h)
        short = np.flatnonzero((count > 0) & (count < n))
        for r in short:
            at = begin[r]
            h[at] = mix(np.array([int(sum(int(x) * int(q) for x, q in zip(w[at : at + count[r]], weight, strict=False)) + int(count[r])) & (2**64 - 1)], U64) ^ U64(0xABCDEF))[0]
            whole[at] = True
        h, row = h[whole], row[whole]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        return row, h, np.bincount(row, minlength=rows)


def set_digest(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x5151)))))
        end = np.cumsum(size)
        return mix(total[end] - total[end - size] ^ size.astype(U64)).view(np.int64)


def _digests(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_rows(batch.column(2))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                row, h, size = shingle_sets(data, offsets[a : b + 1], n)
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size.astype(np.int64)), pa.array(set_digest(row, h, size))], ["doc_id", "row_key", "n_shingles", "node"])

    return run


def _postings(n: int, buckets: int):
    """Packed (shingle, set) entries by bucket of the hash range."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h, who = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        node, size = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        order = np.argsort(h)
        h, who = h[order], who[order]
        bounds = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        for b in range(buckets):
            x, y = bounds[b], bounds[b + 1]
            if x < y:
                mine, local = np.unique(who[x:y], return_inverse=True)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([pack(h[x:y])], pa.binary()), pa.array([pack(local.astype(np.uint32))], pa.binary()), pa.array([pack(node[mine])], pa.binary()), pa.array([pack(size[mine].astype(np.uint32))], pa.binary())], ["bucket", "h", "who", "node", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries, rows = [], 0, 0
        for batch in batches:
            data, offsets = binary_rows(batch.column(0))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                row, h, size = shingle_sets(data, offsets[a : b + 1], n)
                node = set_digest(row, h, size)
                held.append((h, (row + rows).astype(np.uint32), node, size))
                entries, rows = entries + len(h), rows + len(size)
                if entries >= FLUSH:
                    yield from flush(held)
                    held, entries, rows = [], 0, 0
        if entries:
            yield from flush(held)

    return run


def _lists(node_buckets: int):
    """One bucket's lists: what each set has of shingles that other sets share, with two pivots of each list."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        nodes = [unpack(x.as_py(), np.int64) for x in table.column("node")]
        sizes = [unpack(x.as_py(), np.uint32) for x in table.column("size")]
        first = np.concatenate(([0], np.cumsum([len(x) for x in nodes])))
        h = np.concatenate([unpack(x.as_py(), U64) for x in table.column("h")])
        who = np.concatenate([unpack(x.as_py(), np.uint32) + U64(first[i]).astype(np.uint32) for i, x in enumerate(table.column("who"))])
        node, at, inverse = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
        size = np.concatenate(sizes)[at]
        who = inverse[who].astype(np.uint32)
        del inverse
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        del order
        # sort by set within each list, drop copies: a list is a run of equal hashes
        lead = runs(h)
        rank = np.repeat(np.arange(len(lead) - 1, dtype=U64), np.diff(lead))
        key = np.sort(rank << U64(32) | who.astype(U64))
        del h, who, rank
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        rank, who = key >> U64(32), (key & U64(0xFFFFFFFF)).astype(np.int64)
        del key
        lead = runs(rank)
        df = np.diff(lead)
        shared = np.repeat(df >= 2, df)
        who, df = who[shared], df[df >= 2]
        if not len(df):
            return _no_parts()
        start = np.concatenate(([0], np.cumsum(df)))[:-1]
        ident = np.repeat(np.arange(len(df), dtype=U64) | U64(bucket << 32), df)
        level = np.repeat(np.minimum(255, np.log2(df) * 12).astype(np.uint8), df)
        # nodes are sorted by digest, which is random: the least index is one pivot, the least of another mix the second
        other = np.argsort(mix(node.view(U64)))
        place = np.empty(len(node), np.int64)
        place[other] = np.arange(len(node))
        one = np.repeat(np.minimum.reduceat(who, start), df)
        two = np.repeat(other[np.minimum.reduceat(place[who], start)], df)
        home = bucket_of(mix(node.view(U64)), node_buckets)
        order = np.argsort(home[who] << 32 | who, kind="stable")
        who, ident, level, one, two = who[order], ident[order], level[order], one[order], two[order]
        bounds = np.searchsorted(home[who], np.arange(node_buckets + 1))
        out = []
        for b in range(node_buckets):
            x, y = bounds[b], bounds[b + 1]
            if x < y:
                used, local = np.unique(np.concatenate((who[x:y], one[x:y], two[x:y])), return_inverse=True)
                local = local.astype(np.uint32).reshape(3, -1)
                out.append((b, pack(node[used]), pack(size[used]), pack(local[0]), pack(ident[x:y]), pack(level[x:y]), pack(local[1]), pack(local[2])))
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _PART_TYPES, strict=True)], _PART)

    return run


_PART = ["home", "node", "size", "who", "ident", "level", "one", "two"]
_PART_TYPES = [pa.int32()] + [pa.binary()] * 7


def _no_parts() -> pa.Table:
    return pa.table([pa.array([], t) for t in _PART_TYPES], _PART)


def _prefix_sets(percent: int):
    """Sets that may link: links with pivots, and prefixes and ids of what they share with other sets."""

    def run(table: pa.Table) -> pa.Table:
        nodes = [unpack(x.as_py(), np.int64) for x in table.column("node")]
        first = np.concatenate(([0], np.cumsum([len(x) for x in nodes])))
        get = lambda c, t: np.concatenate([unpack(x.as_py(), t) for x in table.column(c)])
        node, at, inverse = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
        size = get("size", np.uint32)[at].astype(np.int64)
        placed = lambda c: np.concatenate([inverse[unpack(x.as_py(), np.uint32) + first[i]] for i, x in enumerate(table.column(c))])
        who = placed("who")
        ident, level = get("ident", U64), get("level", np.uint8)
        order = np.lexsort((ident, level, who))
        who, ident = who[order], ident[order]
        votes = []
        for c in ("one", "two"):
            pivot = placed(c)[order]
            key = np.sort(who.astype(np.int64) << 32 | pivot)
            lead = runs(key)
            votes.append((key[lead[:-1]], np.diff(lead)))
        key, overlap = np.concatenate([x[0] for x in votes]), np.concatenate([x[1] for x in votes])
        a, b = key >> 32, key & 0xFFFFFFFF
        sure = (a != b) & (100 * overlap >= percent * (size[a] + size[b] - overlap))
        key = np.unique(key[sure])
        a, b = key >> 32, key & 0xFFFFFFFF
        lead = runs(who)
        mine = who[lead[:-1]]
        n, k = size[mine], np.diff(lead)
        prefix = n - (percent * n + 99) // 100 + 1 - (n - k)
        live = prefix > 0
        parts = [ident[x:y] for x, y in zip(lead[:-1][live], lead[1:][live], strict=True)]
        some, none = len(a), int(live.sum())
        return pa.table({
            "a": pa.array(np.concatenate((node[a], node[mine[live]])), pa.int64()), "b": pa.array([*node[b].tolist(), *[None] * none], pa.int64()),
            "n": pa.array([*[None] * some, *n[live].tolist()], pa.int64()), "prefix": pa.array([*[None] * some, *prefix[live].tolist()], pa.int64()),
            "low": pa.array([*[None] * some, *(int(x.min()) for x in parts)], pa.int64()), "ids": pa.array([*[None] * some, *map(pack, parts)], pa.binary()),
        })

    return run


def _probes(buckets: int, percent: int):
    """Packed prefix entries by bucket of the shingle id; rest: the set's shared shingles from that one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size, prefix = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            if not len(node):
                continue
            ids = [unpack(x.as_py(), U64)[:p] for x, p in zip(batch.column(4), prefix, strict=True)]
            who = np.repeat(np.arange(len(ids)), prefix)
            shared = prefix + (percent * size + 99) // 100 - 1
            rest = np.repeat(shared, prefix) - np.concatenate([np.arange(p) for p in prefix])
            ids = np.concatenate(ids)
            home = bucket_of(mix(ids), buckets)
            order = np.argsort(home, kind="stable")
            home, ids, who, rest = home[order], ids[order], who[order], rest[order]
            lead = runs(home)
            for x, y in zip(lead[:-1], lead[1:], strict=True):
                mine, local = np.unique(who[x:y], return_inverse=True)
                yield pa.record_batch([pa.array([home[x]], pa.int32()), *(pa.array([pack(v)], pa.binary()) for v in (ids[x:y], local.astype(np.uint32), rest[x:y].astype(np.uint32), node[mine], root[mine], size[mine], (shared / size)[mine]))], ["bucket", "ids", "who", "rest", "node", "root", "size", "share"])

    return run


def _candidates(percent: int, hubs: int = 0):
    """Pairs of sets in different components that a list brings together, by blocks of a list.

    With ``hubs``, only pairs of the list's so many sets of least private share with one set of every other component:
    linear in the list, and in a group of edited copies most sets link with the least edited ones.
    """

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, t: [unpack(x.as_py(), t) for x in table.column(c)]
        nodes = get("node", np.int64)
        first = np.concatenate(([0], np.cumsum([len(x) for x in nodes])))
        node, root, size = np.concatenate(nodes), np.concatenate(get("root", np.int64)), np.concatenate(get("size", np.int64))
        who = np.concatenate([x + first[i] for i, x in enumerate(get("who", np.uint32))]).astype(np.int64)
        share = np.concatenate(get("share", np.float64))
        ids, rest = np.concatenate(get("ids", U64)), np.concatenate(get("rest", np.uint32)).astype(np.int64)
        order = np.lexsort((size[who], ids))
        ids, who, rest = ids[order], who[order], rest[order]
        lead = runs(ids)
        found = []
        for x, y in zip(lead[:-1], lead[1:], strict=True):
            w = who[x:y]
            r, n, k = root[w], size[w], rest[x:y]
            if y - x < 2 or (r == r[0]).all():
                continue
            if hubs:
                best = np.lexsort((node[w], -share[w]))
                lead_of = best[np.unique(r[best], return_index=True)[1]]  # the best set of each component
                for hub in best[:hubs]:
                    far = lead_of[r[lead_of] != r[hub]]
                    ok = 100 * np.minimum(n[far], n[hub]) >= percent * np.maximum(n[far], n[hub])
                    found.append(np.stack((np.full(ok.sum(), w[hub]), w[far[ok]]), 1))
                if len(found) > 20_000:
                    found = [np.unique(np.concatenate(found), axis=0)]
                continue
            block = np.arange(0, len(w), BLOCK)
            smallest, longest = n[block], np.maximum.reduceat(k, block)
            for i in range(len(w) - 1):
                # if this is the first shingle that two sets share, what both have from here on bounds their overlap
                at = (i + 1) // BLOCK
                may = (100 * n[i] >= percent * smallest[at:]) & ((100 + percent) * np.minimum(k[i], longest[at:]) >= percent * (n[i] + smallest[at:]))
                may[0] = True
                for b in np.flatnonzero(may) + at:
                    j = slice(max(i + 1, b * BLOCK), (b + 1) * BLOCK)
                    far = (r[j] != r[i]) & (100 * n[i] >= percent * n[j]) & ((100 + percent) * np.minimum(k[i], k[j]) >= percent * (n[i] + n[j]))
                    if far.any():
                        hit = w[j][far]
                        found.append(np.stack((np.full(len(hit), w[i]), hit), 1))
            if len(found) > 20_000:
                found = [np.unique(np.concatenate(found), axis=0)]
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        pairs = np.concatenate(found)
        pairs = np.unique(np.sort(node[pairs], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


class Answers:
    """Overlaps of the sets of a sorted run with their candidates, each as bounds, derived from the set before where they
    suffice to decide, else counted."""

    def __init__(self, percent: int):
        self.percent, self.last, self.known, self.counted = percent, None, {}, 0

    def _decided(self, low: int, high: int, total: int) -> bool | None:
        if 100 * low >= self.percent * (total - low):
            return True
        return None if 100 * high >= self.percent * (total - high) else False

    def of(self, mine: np.ndarray, n: int, candidates: list[tuple]) -> list[bool]:
        """Whether the set ``mine`` (sorted ids; ``n`` shingles in all) links with each of (name, m, sorted ids)."""
        gain = loss = None
        if self.last is not None and len(mine) and len(self.last) and mine[0] == self.last[0]:
            both = len(np.intersect1d(mine, self.last, assume_unique=True))
            gain, loss = len(mine) - both, len(self.last) - both
        out, now = [], {}
        for name, m, load in candidates:
            low, high, linked = 0, min(n, m), None
            if gain is not None and (old := self.known.get(name)) is not None:
                low, high = max(0, old[0] - loss), min(high, old[1] + gain)
                linked = self._decided(low, high, n + m)
            if linked is None:
                low = high = len(np.intersect1d(mine, load(), assume_unique=True))
                self.counted += 1
                linked = self._decided(low, high, n + m)
            now[name] = (low, high)
            out.append(linked)
        self.last, self.known = mine, now
        return out


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answers = Answers(percent)
        for f in batches:
            keep = []
            ids = lambda blob: np.sort(unpack(blob, U64))
            for _, g in f.groupby("a", sort=False):
                keep += answers.of(ids(g.x.iloc[0]), int(g.n.iloc[0]), [(b, int(m), lambda y=y: ids(y)) for b, m, y in zip(g.b, g.m, g.y, strict=True)])
            yield f.loc[np.array(keep, bool), ["a", "b"]] if len(f) else f[["a", "b"]]

    return run


def _sets(docs: DataFrame, n: int, percent: int, scratch: Scratch):
    """Written tables: each row's set (doc_id, row_key, n_shingles, node), proved links, and what other sets share of each."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    sets = scratch.cut(keyed.mapInArrow(tidy(_digests(n)), "doc_id long, row_key long, n_shingles long, node long"))
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ENTRIES))
    homes = max(8, -(-total // (4 * BUCKET_ENTRIES)))
    posts = docs.select(text.alias("text")).mapInArrow(tidy(_postings(n, buckets)), "bucket int, h binary, who binary, node binary, size binary")
    parts = posts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidy_group(_lists(homes)), "home int, node binary, size binary, who binary, ident binary, level binary, one binary, two binary")
    live = scratch.cut(parts.groupBy("home").applyInArrow(tidy_group(_prefix_sets(percent)), "a long, b long, n long, prefix long, low long, ids binary"))
    active = live.filter("b is null").select(F.col("a").alias("node"), "n", "prefix", "low", "ids")
    return sets, live.filter("b is not null").select("a", "b"), active, buckets


def _linked(active: DataFrame, roots: DataFrame | None, buckets: int, percent: int, hubs: int, scratch: Scratch) -> DataFrame:
    """Pairs of sets that link, of those that the lists bring together across roots."""
    mark = scratch.mark()
    rooted = active.withColumn("root", F.col("node")) if roots is None else active.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    probes = rooted.select("node", "root", "n", "prefix", "ids").mapInArrow(tidy(_probes(buckets, percent)), "bucket int, ids binary, who binary, rest binary, node binary, root binary, size binary, share binary")
    pairs = scratch.cut(probes.groupBy("bucket").applyInArrow(tidy_group(_candidates(percent, hubs)), "a long, b long").distinct())
    left = active.select(F.col("node").alias("a"), "n", "low", F.col("ids").alias("x"))
    right = active.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("ids").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "low", "x", "y").sortWithinPartitions("low", "a", "b")
    found = scratch.cut(both.mapInPandas(tidy(_verify(percent)), "a long, b long"))
    scratch.only(mark, found)
    return found


def _classes(docs: DataFrame, n: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each row's set, and each set's component: its least document (doc_id, row_key)."""
    if not 50 < percent <= 100:
        raise ValueError("percent: above 50, to 100")
    mark = scratch.mark()
    sets, links, active, buckets = _sets(docs, n, percent, scratch)
    labels = components(scratch, links)
    for hubs in HUB_ROUNDS:
        more = _linked(active, labels, buckets, percent, hubs, scratch)
        if not more.isEmpty():
            links = links.union(more)
            scratch.drop(labels)
            labels = components(scratch, links)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_key")
    firsts = sets.filter("n_shingles > 0").groupBy("node").agg(F.min(place).alias("doc"))
    named = scratch.cut(firsts.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "doc"))
    least = named.groupBy("root").agg(F.min("doc").alias("least"))
    ids = scratch.cut(named.join(least, "root").select("node", F.col("least.doc_id").alias("first_id"), F.col("least.row_key").alias("first_key")))
    scratch.only(mark, sets, ids)
    return sets, ids


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    sets, ids = _classes(docs, n, percent, scratch or Scratch(docs.sparkSession))
    empty = F.col("n_shingles") == 0
    out = sets.join(ids, (sets.node == ids.node) & ~empty, "left")
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("first_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` less all but one document of each component, that of the least doc_id.

    A document is a doc_id with a text: rows that repeat both stay or go together, and so a null or repeated doc_id never
    takes other texts along. Rows without words stay.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    sets, ids = _classes(docs, n, percent, scratch)
    later = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("row_key") == F.col("first_key")))
    mark = scratch.mark()
    gone = sets.filter("n_shingles > 0").join(ids, "node").filter(later).select(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).distinct()
    gone = scratch.cut(gone)
    scratch.drop(sets, ids)
    scratch.only(mark, gone)
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are not in ``gone`` (gone_id, gone_key); null ids match each other."""
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("binary")).alias("key"))
    return keyed.join(gone, keyed.id.eqNullSafe(gone.gone_id) & (keyed.key == gone.gone_key), "left_anti").select("row.*")


def jaccard_links(docs: DataFrame, n: int = 5, percent: int = 75, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """All links (a, b) between distinct sets, and each row's set (doc_id, n_shingles, node).

    Every pair of sets that link is one row, so a group of many different near copies has the square of its size of them;
    copies of a set have none. ``jaccard_components`` needs no such pairs.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent: above 50, to 100")
    scratch = scratch or Scratch(docs.sparkSession)
    sets, links, active, buckets = _sets(docs, n, percent, scratch)
    pair = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return links.union(_linked(active, None, buckets, percent, 0, scratch)).select(*pair).distinct(), sets.select("doc_id", "n_shingles", "node")
