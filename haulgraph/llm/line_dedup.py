"""Line deduplication by a deletion-neighbourhood join.

Lines are what newlines separate; a line's tokens are its words, A-Z lower-cased. A line is dropped if an earlier line, by
(doc_id, text, line number), is within ``max_edits`` word insertions, deletions or substitutions, where both lines have
``min_words`` words or more; ``min_words=0`` takes every line. Shorter lines match only as wholes; lines without words
stay.

Equal lines meet by hash first. A distinct line can be within one edit of another only if the two agree on one half, so
lines alone in all their halves leave here (with a larger bound all stay). Those left emit their deletion neighbourhood,
the line itself and every variant without up to ``max_edits`` of its words, as hashed keys with the places of the words
left out. Of two lines with an equal variant, the edits at each place number the larger of the two lines' words left out
there, so the places decide. A variant needs only the earliest line for each set of places, against which the others'
edit distance is verified on their words, so groups cost their size and not its square.

Defined results: null text stays null; a document is a doc_id with a text, so rows that repeat both are one position and
stay together, while other texts of a repeated or null doc_id are documents of their own; a null doc_id counts as the
earliest, and texts of one doc_id come in the order of their hash; other columns pass through untouched, whatever their
names, but for those called as the two counts, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Scratch, binary_rows, mix, powers, row_chunks, tidy, word_hashes

CHUNK_BYTES = 1 << 20


def _prefix_sums(w: np.ndarray) -> np.ndarray:
    total = np.zeros(len(w) + 1, U64)
    np.cumsum(w * powers(len(w) + 1)[0][: len(w)], out=total[1:])
    return total


def _span(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the words from a to b, wherever they stand."""
    return (total[b] - total[a]) * powers(len(total) + 1)[1][a]


def _line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin (byte), and the row of each line."""
    lo, hi = offsets[0], offsets[-1]
    after = np.flatnonzero(data[lo:hi] == 10) + lo + 1
    row = np.searchsorted(offsets, after - 1, side="right") - 1
    begin = np.concatenate((offsets[:-1], after))
    row = np.concatenate((np.arange(len(offsets) - 1), row))
    order = np.lexsort((begin, row))
    return begin[order], row[order]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words: its hash and three keys of halves."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = binary_rows(batch.column(2))
            for a, b in row_chunks(offsets, CHUNK_BYTES):
                part = offsets[a : b + 1]
                w, row, at, _ = word_hashes(data, part)
                begin, owner = _line_bounds(data, part)
                # a word's line: an empty row's line has no bytes, so among equal beginnings the last line holds the word
                line = np.searchsorted(begin, at, side="right") - 1
                n_words = np.bincount(line, minlength=len(begin))
                full = np.flatnonzero(n_words)
                s = np.concatenate(([0], np.cumsum(n_words)))[full]
                n = n_words[full]
                e = s + n
                total = _prefix_sums(w)
                first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1)) if len(owner) else np.zeros(1, np.int64)
                number = np.arange(len(begin)) - np.repeat(first, np.diff(np.concatenate((first, [len(owner)])))) if len(owner) else np.zeros(0, np.int64)
                half, shorter = n // 2, (n - 1) // 2
                keys = [mix(_span(total, s, s + half) ^ half.astype(U64)), mix(_span(total, e - (n - half), e) ^ (n - half).astype(U64) ^ U64(1 << 40))]
                odd = n % 2 == 1
                keys.append(np.where(odd, mix(_span(total, e - (n - 1 - shorter), e) ^ (n - 1 - shorter).astype(U64) ^ U64(1 << 40)), mix(_span(total, s, s + shorter) ^ shorter.astype(U64))))
                owners = pa.array(owner[full])
                yield pa.record_batch([*(batch.column(k).slice(a, b - a).take(owners) for k in (0, 1)), pa.array(number[full].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(mix(_span(total, s, e) ^ n.astype(U64)).view(np.int64)), *(pa.array(k.view(np.int64)) for k in keys)], ["doc_id", "row_key", "line_no", "n_words", "line", "k1", "k2", "k3"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document."""
    for batch in batches:
        found = []
        for text, want in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or b"").split(b"\n")
            found += [(x["line"], raw[x["line_no"]]) for x in want.as_py() if x["line_no"] < len(raw)]
        yield pa.record_batch([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["line", "words"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The deletion neighbourhood of each line: place -1 is the line itself."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = binary_rows(batch.column(1))
            for a, b in row_chunks(offsets, CHUNK_BYTES >> 2):
                w, row, _, _ = word_hashes(data, offsets[a : b + 1])
                n = np.bincount(row, minlength=b - a)
                s = np.concatenate(([0], np.cumsum(n)))
                up = powers(len(w) + 2)[0]
                total = _prefix_sums(w)
                i = np.arange(len(w))
                begin, end = s[row], s[row + 1]
                place = i - begin
                without = _span(total, begin, i) + _span(total, i + 1, end) * up[place]
                whole = _span(total, s[:-1], s[1:])
                key = np.concatenate((mix(without ^ (n[row] - 1).astype(U64)), mix(whole ^ n.astype(U64)))).view(np.int64)
                rows = np.concatenate((row, np.arange(b - a)))
                place = np.concatenate((place, np.full(b - a, -1))).astype(np.int32)
                for x in range(0, len(key), 200_000):
                    y = slice(x, x + 200_000)
                    yield pa.record_batch([pa.array(key[y]), pa.array(place[y]), *(batch.column(c).take(pa.array(rows[y] + a)) for c in (0, 2, 3, 4))], ["variant", "place", "line", "doc", "row_key", "at"])


def neighbourhood(words: list, most: int) -> Iterator[tuple[tuple, list[int]]]:
    """Every variant of a line without up to ``most`` of its words, and where they were: place * 16 + how many before."""
    for k in range(min(most, len(words)) + 1):
        for out in combinations(range(len(words)), k):
            places = [p - i for i, p in enumerate(out)]
            yield tuple(w for i, w in enumerate(words) if i not in out), [p * 16 + places[:i].count(p) for i, p in enumerate(places)]


def _wide_variants(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["variant", "places", "line", "doc", "row_key", "at"]
        types = [pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            out = []
            for line, raw, *where in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                for kept, places in neighbourhood(raw.translate(_LOWER).split(), most):
                    out.append((int.from_bytes(hashlib.blake2b(b" ".join(kept), digest_size=8).digest(), "little", signed=True), places, line, *where))
                    if len(out) >= 50_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two token lists is ``most`` at most."""
    if most == 1:
        return within_one(a, b)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(old + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1] <= most


def within_one(a: list, b: list) -> bool:
    """Whether the edit distance of two token lists is one at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _verify(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(x.as_py().translate(_LOWER).split(), y.as_py().translate(_LOWER).split(), most) for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.record_batch([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["line"])

    return run


def _rebuild(position: int, names: list[str]):
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(position).to_pylist()
            for k, gone in enumerate(batch.column(width)):
                if gone.is_valid:
                    drop = set(gone.as_py())
                    text[k] = "\n".join(x for i, x in enumerate(text[k].split("\n")) if i not in drop)
            columns = [pa.array(text, batch.column(i).type) if i == position else batch.column(i) for i in range(width)]
            yield pa.record_batch(columns, names)

    return run


def _near(distinct: DataFrame, texts: DataFrame, max_edits: int, min_words: int, scratch: Scratch) -> DataFrame:
    """Distinct lines (line) within the bound of an earlier one."""
    where = F.struct("doc", "row_key", "at", "line")
    long = distinct.filter(F.col("n_words") >= min_words)
    wanted = long.select("line", "doc", "row_key", "at")
    if max_edits == 1:
        keys = long.select("line", F.explode(F.array("k1", "k2", "k3")).alias("key"))
        met = scratch.cut(keys.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y")).filter("x < y").select("key"))
        kin = keys.join(met, "key", "left_semi").select("line").distinct()
        wanted = scratch.cut(long.join(kin, "line").select("line", "doc", "row_key", "at"))
        scratch.drop(met)
    by_doc = wanted.groupBy("doc", "row_key").agg(F.collect_list(F.struct("line", F.col("at").alias("line_no"))).alias("want"))
    held = texts.join(by_doc.hint("merge"), texts.doc_id.eqNullSafe(by_doc.doc) & (texts.row_key == by_doc.row_key)).select("text", "want")
    words = scratch.cut(held.mapInArrow(tidy(_fetch), "line long, words binary").dropDuplicates(["line"]))
    near = words.join(wanted, "line").select("line", "words", "doc", "row_key", "at")
    if max_edits == 1:
        variants = scratch.cut(near.mapInArrow(tidy(_variants), "variant long, place int, line long, doc long, row_key long, at int"))
        edited, whole = variants.filter("place >= 0"), variants.filter("place < 0")
        first = scratch.cut(edited.groupBy("variant", "place").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("variant", "place", "first"))
        same = edited.join(first, ["variant", "place"]).filter("line <> first.line").select("line", F.col("first.line").alias("other"))
        one = whole.select("variant", where.alias("w"))
        least = scratch.cut(edited.groupBy("variant").agg(F.min(where).alias("first")))
        later = edited.join(one, "variant").filter(F.col("w") < where).select("line", F.col("w.line").alias("other"))
        sooner = one.join(least, "variant").filter("first < w").select(F.col("w.line").alias("line"), F.col("first.line").alias("other"))
        pairs = same.union(later).union(sooner).distinct()
    else:
        variants = scratch.cut(near.mapInArrow(tidy(_wide_variants(max_edits)), "variant long, places array<int>, line long, doc long, row_key long, at int"))
        first = scratch.cut(variants.groupBy("variant", F.col("places").alias("others")).agg(F.min(where).alias("first")))
        edits = F.size("places") + F.size("others") - F.size(F.array_intersect("places", "others"))
        pairs = variants.join(first, "variant").filter((edits <= max_edits) & (F.col("first") < where) & (F.col("first.line") != F.col("line"))).select("line", F.col("first.line").alias("other")).distinct()
    pairs = scratch.cut(pairs)
    left, right = words.select("line", F.col("words").alias("x")), words.select(F.col("line").alias("other"), F.col("words").alias("y"))
    return pairs.join(left, "line").join(right, "other").select("line", "x", "y").mapInArrow(tidy(_verify(max_edits)), "line long").distinct()


def dropped_lines(docs: DataFrame, max_edits: int = 1, min_words: int = 8, scratch: Scratch | None = None) -> DataFrame:
    """(gone_id, gone_key, gone array<int>): the lines of ``docs`` (doc_id, text) that repeat an earlier one, by document.

    gone_key is xxhash64 of the text as binary.
    """
    if max_edits < 0:
        raise ValueError("max_edits: 0 or more")
    scratch = scratch or Scratch(docs.sparkSession)
    mark = scratch.mark()
    text = F.col("text").cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    lines = scratch.cut(texts.mapInArrow(tidy(_lines), "doc_id long, row_key long, line_no int, n_words int, line long, k1 long, k2 long, k3 long"))
    known = lines.groupBy("line").agg(F.min(F.struct("doc_id", "row_key", "line_no")).alias("at"), F.count(F.lit(1)).alias("times"), F.min("n_words").alias("n_words"), *(F.min(k).alias(k) for k in ("k1", "k2", "k3")))
    distinct = scratch.cut(known.select("line", F.col("at.doc_id").alias("doc"), F.col("at.row_key").alias("row_key"), F.col("at.line_no").alias("at"), "times", "n_words", "k1", "k2", "k3"))
    within_bound = _near(distinct, texts, max_edits, min_words, scratch) if max_edits else lines.limit(0).select("line")
    near = scratch.cut(within_bound.withColumn("near", F.lit(True)))
    scratch.only(mark, lines, distinct, near)
    marked = scratch.cut(distinct.join(near, "line", "left").filter("times > 1 or near").select("line", "doc", F.col("row_key").alias("first_key"), "at", F.coalesce("near", F.lit(False)).alias("near")))
    scratch.drop(distinct, near)
    earliest = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("row_key") == F.col("first_key")) & (F.col("line_no") == F.col("at"))
    hit = lines.select("doc_id", "row_key", "line_no", "line").join(marked, "line").filter(~earliest | F.col("near"))
    gone = scratch.cut(hit.groupBy(F.col("doc_id").alias("gone_id"), F.col("row_key").alias("gone_key")).agg(F.collect_set("line_no").alias("gone")))
    scratch.only(mark, gone)
    return gone


def drop_lines(docs: DataFrame, max_edits: int = 1, min_words: int = 8, scratch: Scratch | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the text of every row less its repeated lines, and how many lines each had and lost as ``counts``."""
    gone = dropped_lines(docs, max_edits, min_words, scratch)
    fields = [f for f in docs.schema if f.name.lower() not in {c.lower() for c in counts}]
    names = [f.name for f in fields]
    text = F.col("text").cast("binary")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"))
    joined = keyed.join(gone.hint("merge"), keyed.id.eqNullSafe(gone.gone_id) & (keyed.key == gone.gone_key), "left")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n", -1)))
    plain = joined.select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)), n_lines.alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("dropped"), "gone")
    schema = T.StructType([*fields, *(T.StructField(c, T.IntegerType()) for c in counts)])
    return plain.mapInArrow(tidy(_rebuild(names.index("text"), schema.names)), schema)
