"""Audit of how document filters interact: what each removes in every order, from one mask of failures a document.

Duplicates are found by sorting. Documents are dealt by ranges of (fingerprint of the text, doc_id) and sorted in each
part by fingerprint, full text and doc_id, so copies stand together and a group of any size spreads over parts. A row is
compared with its predecessor: it fails if the same text came before with a smaller doc_id. At a part's first and last
fingerprint the predecessor may stand in another part; there the rows that nothing came before (one for each distinct
text) keep their text, and meet by it afterwards. Range bounds hold fingerprints and doc_ids alone, so no text goes
to the driver; texts of an equal fingerprint are told apart by the sort and at the boundaries alike.

A text's other conditions are worked out once for its run of copies. Masks are then counted by part, and as all figures
add up over masks, the audit of all orders reads 2^filters rows a part.

Defined results: a null text is empty; a null part is the empty string; a null doc_id comes before nothing and nothing
comes before it, so it never fails as a duplicate and has no labels; rows that repeat a doc_id and text count each, and
fail only if a smaller doc_id has the text; of repeated labels of a doc_id any 1 counts. Without documents there are no parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import permutations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, SLICE_BYTES, Scratch, _slices, binary_rows, tidy

CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
ROWS = 4096


class Facts(NamedTuple):
    """What the conditions read of a text: bytes are UTF-8, words are runs outside ASCII white space."""

    words: int
    distinct: int
    capitals: int
    chars: int
    symbols: int


def facts(text: bytes, symbols: bytes) -> Facts:
    n, seen = 0, set()
    cuts = [(0, len(text))] if len(text) <= SLICE_BYTES else _slices(IS_SPACE[np.frombuffer(text, np.uint8)], SLICE_BYTES)
    for a, b in cuts:
        words = text[a:b].split()
        n += len(words)
        seen.update(words)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    return Facts(n, len(seen), without(CAPITALS), len(text.translate(None, CONTINUATION)), without(symbols))


#: Conditions A to D; the duplicate condition is the last letter.
CONDITIONS: tuple[Callable[[Facts], bool], ...] = (
    lambda f: f.words < 100,
    lambda f: 100 * f.distinct < 80 * f.words,
    lambda f: 100 * f.capitals > 10 * f.chars,
    lambda f: f.symbols > 0,
)
SYMBOLS = b"#$%&*|"


def _masks(conditions: tuple[Callable[[Facts], bool], ...], symbols: bytes):
    twice = 1 << len(conditions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_rows: dict[tuple, int] = {}  # rows of this fingerprint that nothing came before, by doc_id, part, mask, text
        print_, text, least, mask, first = None, None, None, 0, True

        def flush(edge: bool) -> None:
            out.extend((d, p, m, n, t if edge else None) for (d, p, m, t), n in open_rows.items())
            open_rows.clear()

        def ready() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ([],) * 5
            batch = pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "part", "mask", "n", "edge"])
            out.clear()
            return batch

        for batch in batches:
            data, offsets = binary_rows(batch.column(1))
            prints, ids, parts = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for k in range(batch.num_rows):
                own = data[offsets[k] : offsets[k + 1]].tobytes()
                if prints[k] != print_:
                    flush(first)
                    first, print_, text = print_ is None, prints[k], None
                if own != text:
                    f = facts(own, symbols)
                    text, least, mask = own, None, sum(1 << i for i, fails in enumerate(conditions) if fails(f))
                if ids[k] is None:
                    out.append((None, parts[k], mask, 1, None))
                elif least is None or ids[k] == least:
                    least = ids[k]
                    key = least, parts[k], mask, text
                    open_rows[key] = open_rows.get(key, 0) + 1
                else:
                    out.append((ids[k], parts[k], mask | twice, 1, None))
                if len(out) >= ROWS:
                    yield ready()
        flush(True)
        yield ready()

    return run


def failure_masks(docs: DataFrame, part: Column, conditions: tuple[Callable[[Facts], bool], ...] = CONDITIONS, symbols: bytes = SYMBOLS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, part, mask, n): bit i of mask is condition i's failure, the bit after the last a duplicate's; n rows have it."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.xxhash64(text).alias("print"), text.cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"))
    dealt = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")
    found = scratch.cut(dealt.mapInArrow(tidy(_masks(conditions, symbols)), "doc_id long, part string, mask int, n long, edge binary"))
    edges = found.filter("edge is not null")
    first = edges.groupBy("edge").agg(F.min("doc_id").alias("least"))
    twice = F.when(F.col("doc_id") > F.col("least"), 1 << len(conditions)).otherwise(0)
    met = edges.join(first, "edge").select("doc_id", "part", F.col("mask").bitwiseOR(twice).alias("mask"), "n")
    return found.filter("edge is null").drop("edge").unionByName(met)


def audit(masks: DataFrame, labels: DataFrame, filters: int) -> DataFrame:
    """The counters of every part, order of filters and step, from (doc_id, part, mask, n) and labels (doc_id, quality, toxic).

    kept after the step; removed here; redundant: fails, but went earlier; unique_fails: fails this filter only; good_lost
    and toxic_lost: of the removed; shapley: what the filter removes, over all orders (a document that fails m filters
    is removed by each of them in one m-th of the orders).
    """
    is_1 = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_1("quality").alias("good"), is_1("toxic").alias("bad"))
    joined = masks.filter("doc_id is not null").join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))
    nameless = masks.filter("doc_id is null").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("bad"))
    counted = joined.unionByName(nameless).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("bad"))

    letters = "".join(chr(65 + i) for i in range(filters))
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(letters))), " ")
    each = counted.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(filters))))
    place = lambda x: F.locate(x, F.col("filter_order"))
    bits = lambda holds: sum((F.when(holds(place(x)), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    each = each.withColumn("own", bits(lambda at: at == F.col("step"))).withColumn("before", bits(lambda at: at < F.col("step")))
    mask, own = F.col("mask"), F.col("own")
    fails, gone = mask.bitwiseAND(own) != 0, mask.bitwiseAND(F.col("before")) != 0
    total = lambda holds, x="n": F.sum(F.when(holds, F.col(x)).otherwise(F.lit(0))).cast("long")
    share = F.col("n") * (F.lit(math.factorial(filters)) / F.greatest(F.bit_count(mask), F.lit(1))).cast("long")
    return each.groupBy("part", "filter_order", F.col("step").cast("int").alias("step")).agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"), total(mask == own).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"), total(fails & ~gone, "bad").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(F.lit(0))).cast("long").alias("shapley"),
    )
