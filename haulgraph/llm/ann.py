"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of several full-dimensional codebooks. Codebooks are fitted in turn on
what the ones before leave of a bounded sample; every row is encoded by beam search over them, and its code and the norm
of its reconstruction are stored. A query's inner products with all code words fill a lookup table; a candidate's score is
the sum of its words' entries over the stored norm. The best ``rerank`` of each block are ranked exactly, by cosine in
double precision on the original vectors, and after them every other row that can still be among the best ``k``: its
cosine is at most its score and the stored distance between its direction and that of its reconstruction.

Rows are stored in blocks of ``BLOCK`` by the hash of their id, queries in blocks of ``QUERIES``; each pair of blocks is a
task's work, so neither side is broadcast or gathered whole.

Defined results: vectors that are null, zero, of another length than most rows, or hold null or non-finite components
take no part, nor do null ids; of rows with one id the least vector counts; equal scores rank by the smaller id; with fewer
candidates than ``k`` all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tidy, tidy_group

BLOCK = 8192
QUERIES = 1024


class Codebooks:
    def __init__(self, words: np.ndarray):
        self.words = words  # books x words x dimensions
        flat = words.reshape(-1, words.shape[2])
        self.cross = (flat @ flat.T).astype(np.float32)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = 16, words: int = 64, rounds: int = 10, seed: int = 7) -> Codebooks:
        random, left, out = np.random.default_rng(seed), x.astype(np.float64), []
        for _ in range(books):
            centre = left[random.choice(len(left), words, replace=len(left) < words)].copy()
            for _ in range(rounds):
                near = ((centre**2).sum(1) - 2 * left @ centre.T).argmin(1)
                count = np.bincount(near, minlength=words)
                total = np.zeros_like(centre)
                np.add.at(total, near, left)
                centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], left[random.integers(0, len(left), words)])
            near = ((centre**2).sum(1) - 2 * left @ centre.T).argmin(1)
            left -= centre[near]
            out.append(centre)
        return cls(np.stack(out))

    def encode(self, x: np.ndarray, beam: int = 6) -> np.ndarray:
        """Beam search: of all partial sums, the ``beam`` nearest to each vector go on to the next codebook."""
        books, words, _ = self.words.shape
        n = len(x)
        dots = np.einsum("nd,mkd->nmk", x, self.words, optimize=True)
        square = (self.words**2).sum(2)
        error, codes = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64)
        for m in range(books):
            grow = error[:, :, None] + square[m] - 2 * dots[:, m][:, None, :]
            for j in range(m):
                grow += 2 * self.cross[(j * words + codes[:, :, j])[:, :, None], m * words + np.arange(words)]
            flat = grow.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            error = np.take_along_axis(flat, best, 1)
            codes = np.concatenate((np.take_along_axis(codes, (best // words)[:, :, None], 1), (best % words)[:, :, None]), 2)
        return codes[np.arange(n), error.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def _vectors(blob: bytes, dim: int, kind: str) -> np.ndarray:
    """Vectors in double precision, each times a power of two, which no cosine feels and no square overflows."""
    x = np.frombuffer(blob, kind).reshape(-1, dim).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _index(books: Codebooks, dim: int, kind: str):
    """A block of rows with their codes and norms."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        x = np.array(table.column("embedding").to_pylist(), kind)[order]
        unit = _vectors(x.tobytes(), dim, kind)
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        codes = np.concatenate([books.encode(unit[k : k + 2048]) for k in range(0, len(x), 2048)])
        near = books.decode(codes)
        norm = np.linalg.norm(near, axis=1)
        error = np.linalg.norm(unit - near / np.maximum(norm, 1e-12)[:, None], axis=1)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "ids": [ids[order].astype(np.int64).tobytes()], "codes": [codes.astype(np.uint16).tobytes()], "norms": [norm.astype(np.float32).tobytes()], "errors": [error.astype(np.float32).tobytes()], "vectors": [x.tobytes()]})

    return run


def _pack_queries(kind: str):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        x = np.array(table.column("embedding").to_pylist(), kind)[order]
        return pa.table({"q_block": pa.array([table.column("q_block")[0].as_py()], pa.int64()), "q_ids": [ids[order].astype(np.int64).tobytes()], "q_vectors": [x.tobytes()]})

    return run


def _search(books: Codebooks, dim: int, kind: str, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, _ = books.words.shape
        for batch in batches:
            for row in batch.to_pylist():
                ids, norm = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["norms"], np.float32)
                codes = np.frombuffer(row["codes"], np.uint16).reshape(-1, m).astype(np.int64) + np.arange(m) * words
                # what single precision can lose is added
                error = np.frombuffer(row["errors"], np.float32) + np.float32(1e-4)
                x = _vectors(row["vectors"], dim, kind)
                x_norm = np.sqrt((x * x).sum(1))
                q_ids, queries = np.frombuffer(row["q_ids"], np.int64), _vectors(row["q_vectors"], dim, kind)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for a in range(0, len(q_ids), 128):
                    part = queries[a : a + 128]
                    size = np.sqrt((part * part).sum(1))
                    lookup = (part / size[:, None] @ books.words.reshape(-1, dim).T).astype(np.float32)
                    score = np.zeros((len(part), len(ids)), np.float32)
                    for j in range(m):
                        score += lookup[:, codes[:, j]]
                    score /= np.maximum(norm, 1e-12)
                    keep = min(rerank, len(ids))
                    least = np.partition(score, len(ids) - keep, axis=1)[:, len(ids) - keep]
                    for i, q in enumerate(part):
                        above = np.flatnonzero(score[i] > least[i])
                        at = np.concatenate((above, np.flatnonzero(score[i] == least[i])[: keep - len(above)]))
                        at = at[ids[at] != q_ids[a + i]]
                        exact = (x[at] * q).sum(1) / (x_norm[at] * size[i])
                        worst = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -2.0
                        more = score[i] + error >= worst
                        more[at] = False
                        more = np.flatnonzero(more & (ids != q_ids[a + i]))
                        at, exact = np.concatenate((at, more)), np.concatenate((exact, (x[more] * q).sum(1) / (x_norm[more] * size[i])))
                        best = np.lexsort((ids[at], -exact))[:k]
                        found.append((np.full(len(best), q_ids[a + i]), ids[at[best]], exact[best]))
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, rerank: int = 400, sample: int = 10_000, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query among all other rows of (vec_id, embedding).

    ``is_query``: a boolean column over vec_id. ``sample``: rows the codebooks are fitted on, those of least hash.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    # single precision stays as it is, all else is held in double
    kind, cast = ("<f4", "float") if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else ("<f8", "double")
    whole = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{cast}>").alias("embedding"))
    fine = whole.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    lengths = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim = lengths["dim"]
    rows = scratch.cut(fine.filter(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    n, n_queries = rows.count(), rows.filter(is_query).count()
    if not n_queries:
        return empty
    learned = np.array([r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()], np.float64)
    learned = _vectors(learned.tobytes(), dim, "<f8")
    books = Codebooks.fit(learned / np.linalg.norm(learned, axis=1)[:, None])
    blocks, q_blocks = -(-n // BLOCK), -(-n_queries // QUERIES)
    by = lambda count, name: F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias(name)
    indexed = scratch.cut(rows.select("*", by(blocks, "block")).groupBy("block").applyInArrow(tidy_group(_index(books, dim, kind)), "block long, ids binary, codes binary, norms binary, errors binary, vectors binary"))
    asked = rows.filter(is_query).select("*", by(q_blocks, "q_block")).groupBy("q_block").applyInArrow(tidy_group(_pack_queries(kind)), "q_block long, q_ids binary, q_vectors binary")
    paired = indexed.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long")))).repartition(max(1, blocks * q_blocks), "block", "q_block").join(scratch.cut(asked), "q_block")
    found = paired.mapInArrow(tidy(_search(books, dim, kind, k, rerank)), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
