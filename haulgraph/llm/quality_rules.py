"""Rules of quality by text and by how many documents of a host share a line.

Each document is read once: words, characters in words, symbols, repeated lines and words in repeated windows of eight,
and its distinct normalised lines (A-Z lower-cased, digits as 0, words a space apart) as 64-bit hashes. A line's count
is the number of distinct documents of its host that hold it; documents are distinct by text, so copies of one text count
once and do not make its lines common. A line goes if its count is above both limits: ``most_docs`` documents, and
``most_per_mille`` thousandths of the host's distinct documents. A document is depleted, and rejected, if fewer than
``least_left`` hundredths of its words are left.

A document's lines are dealt by host, line and text before they are counted, and counts are summed within tasks first,
so a host or a line that every document has costs no task more than its share; rows meet the common lines by a join of
written tables that can split a hot line.

Defined results: a null text has no words, and with the base limit of words fails; a document without lines with words
loses none; a null host is a host of its own; rows that repeat a doc_id are judged each on its own text; very long texts
are read in slices, a line at any length; columns beside those named pass through ``strip_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, IS_SPACE, LOWER_VALUE, U64, Scratch, binary_rows, mix, row_chunks, tidy, unused, word_hashes
from .line_dedup import _line_bounds, _prefix_sums, _span

CHUNK_BYTES = 1 << 20
WINDOW = 8
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True
LINE_VALUE = LOWER_VALUE.copy()
LINE_VALUE[48:58] = LINE_VALUE[48]


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """For each row, its words that stand in a window found twice or more in the row."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(n_rows, np.int64)
    total, first = _prefix_sums(words), np.arange(n - WINDOW + 1)
    first = first[row[first] == row[first + WINDOW - 1]]
    key = mix(_span(total, first, first + WINDOW) ^ mix(row[first].astype(U64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + WINDOW, -1)
    return np.bincount(row, weights=np.cumsum(edge[:-1]) > 0, minlength=n_rows).astype(np.int64)


def line_keys(data: np.ndarray, offsets: np.ndarray):
    """The lines of the rows: where each begins, its row, its normalised hash and its words."""
    w, _, at, _ = word_hashes(data, offsets, LINE_VALUE)
    begin, owner = _line_bounds(data, offsets)
    # of lines that begin together only the last has bytes
    line = np.searchsorted(begin, at, side="right") - 1
    n = np.bincount(line, minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    s = np.concatenate(([0], np.cumsum(n)))[:-1] if len(n) else n
    total = _prefix_sums(w)
    return begin, owner, mix(_span(total, s, s + n) ^ n.astype(U64)), n


def _read(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = binary_rows(batch.column(0))
                for a, b in row_chunks(offsets, CHUNK_BYTES):
                    part, n = offsets[a : b + 1], b - a
                    body, at = data[part[0] : part[-1]], part - part[0]
                    w, row, _, _ = word_hashes(data, part, BYTE_VALUE)
                    texts = [[x for x in body[at[k] : at[k + 1]].tobytes().split(b"\n") if x.strip()] for k in range(n)]
                    repeats = [len(x) - len(set(x)) for x in texts]
                    _, owner, key, words = line_keys(data, part)
                    full = np.flatnonzero(words)
                    order = full[np.lexsort((key[full], owner[full]))]
                    o, h, x = owner[order], key[order], words[order]
                    new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])))) if len(o) else np.zeros(0, np.int64)
                    held = np.add.reduceat(x, new) if len(new) else x
                    ends = np.concatenate(([0], np.cumsum(np.bincount(o[new], minlength=n)))).astype(np.int32)
                    lines = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h[new].view(np.int64)), pa.array(held.astype(np.int64))], ["line", "words"]))
                    stats = [np.bincount(row, minlength=n), _per_row(~IS_SPACE[body] & ((body & 0xC0) != 0x80), at), _per_row(IS_SYMBOL[body], at), np.array(repeats, np.int64), repeated_words(w, row, n)]
                    rest = [batch.column(c).slice(a, n) for c in range(0 if keep_text else 1, batch.num_columns)]
                    names = batch.schema.names[0 if keep_text else 1 :]
                    yield pa.record_batch([*rest, *(pa.array(s.astype(np.int64)) for s in stats), lines], [*names, *STATS, "lines"])

    return run


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose hashes are given."""
    with np.errstate(over="ignore"):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                raw, hashes = text.as_py(), gone.as_py()
                if raw and hashes:
                    data = np.frombuffer(raw, np.uint8)
                    begin, _, key, n = line_keys(data, np.array([0, len(data)]))
                    ends = np.concatenate((begin[1:] - 1, [len(data)]))
                    keep = ~((n > 0) & np.isin(key.view(np.int64), np.array(hashes, np.int64)))
                    raw = b"\n".join(raw[s:e] for s, e in zip(begin[keep], ends[keep], strict=True))
                out.append(raw)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["row_key", "text"])


def _judged(docs: DataFrame, host: Column, most_docs: int, most_per_mille: int, least_left: int, least_words: int, most_repeat: int, scratch: Scratch, carried: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Every row with its figures (and ``carried`` columns), and (row_key, line) of the lines that go."""
    keep_text = bool(carried)
    own = [F.col(c).alias(k) for c, k in carried.items() if c != "text"]
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(host).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), *own)
    extra = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[(0 if keep_text else 1) :])
    schema = extra + ", ".join(f"{s} long" for s in STATS) + ", lines array<struct<line: long, words: long>>"
    # written, so that each row has one key for good
    base = scratch.cut(rows.mapInArrow(tidy(_read(keep_text)), schema).withColumn("row_key", F.monotonically_increasing_id()))
    held = base.select("host", "print", F.explode("lines").alias("x")).select("host", "print", "x.line")
    counts = held.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > most_docs)
    hosts = base.select("host", "print").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    common = scratch.cut(counts.join(hosts, "host").filter(F.col("docs") * 1000 > F.col("of") * most_per_mille).select("host", "line"))
    lines = scratch.cut(base.select("row_key", "host", F.explode("lines").alias("x")).select("row_key", "host", "x.line", "x.words").join(common, ["host", "line"]).select("row_key", "line", "words"))
    lost = lines.groupBy("row_key").agg(F.sum("words").alias("lost"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    n_lost = F.coalesce("lost", F.lit(0).cast("long"))
    judged = base.drop("lines").join(lost, "row_key", "left").withColumn("n_lost_words", n_lost).withColumn("base_failed", failed).withColumn("kept", ~failed & (100 * (F.col("n_words") - n_lost) >= least_left * F.col("n_words")))
    return judged.drop("lost", "host", "print"), lines


def quality(docs: DataFrame, host: Column, most_docs: int = 10, most_per_mille: int = 1, least_left: int = 50, least_words: int = 20, most_repeat: int = 30, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_words) of every row."""
    judged, _ = _judged(docs, host, most_docs, most_per_mille, least_left, least_words, most_repeat, scratch or Scratch(docs.sparkSession), {})
    return judged.select("doc_id", *STATS, "base_failed", "kept", "n_lost_words")


def strip_lines(docs: DataFrame, host: Column, most_docs: int = 10, most_per_mille: int = 1, least_left: int = 50, least_words: int = 20, most_repeat: int = 30, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the common lines."""
    scratch = scratch or Scratch(docs.sparkSession)
    carried = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    judged, lines = _judged(docs, host, most_docs, most_per_mille, least_left, least_words, most_repeat, scratch, carried)
    gone = lines.groupBy("row_key").agg(F.collect_set("line").alias("gone"))
    kept = judged.filter("kept")
    new = kept.join(gone, "row_key").select("row_key", "text", "gone").mapInArrow(tidy(_strip), "row_key long, text binary").withColumnRenamed("text", "stripped")
    text = F.coalesce("stripped", "text").cast("string").alias("text")
    return kept.join(new, "row_key", "left").select(*(text if c == "text" else F.col(k).alias(c) for c, k in carried.items()))
