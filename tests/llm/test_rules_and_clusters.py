"""The filter audit, the centroid clustering and the quality rules against brute force, and their edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgraph.llm import elkan, filter_audit, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, mask int, n long, edge string, print long, row_key long, line string, host string, lost int"


def docs(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, g, s, 9, 9, "e", 1, 1, "l", "h", 3) for i, t, g, s in rows], DOCS).repartition(parts)


def texts(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "THE", "a#b", "x|y", " ", "naïve", "7", "42"]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = ["\n".join(sentence(rng.randint(1, 60)) for _ in range(rng.randint(1, 8))) for _ in range(n)]
    common = ["Read MORE at page 7", "all rights reserved by us", "  All  rights reserved\tby us"]
    out = [t + "\n" + rng.choice(common) if rng.random() < 0.6 else t for t in out]
    out += ["read more at page 3\n" + sentence(2), "same words here " * 12, "UPPER CASE " * 60, "", "", None, " \n\t\n", "\n\nx\n\nx\n", "word", "é" * 4000, "long " * 3000 + "\n" + "long " * 3000]
    return out + rng.choices(out[:10], k=60) + [out[0]] * 150


def rows(seed=1):
    rng = random.Random(seed)
    made = [(None if k % 41 == 0 else k, t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", None])) for k, t in enumerate(texts(seed))]
    return made + made[20:24] + [(made[30][0], "other text of a used doc_id", "en", "a")]


# --- 11: filter audit ------------------------------------------------------------------------------------------------


def brute_audit(given, labels):
    least, good, bad = {}, collections.Counter(), collections.Counter()
    for i, t, _, _ in given:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        good[i] |= q == 1
        bad[i] |= x == 1
    parts = collections.defaultdict(list)
    for i, t, g, _ in given:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[g or ""].append((fails, i is not None and good[i], i is not None and bad[i]))
    out, totals = {}, collections.Counter()
    for part, held in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(held)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                failing = [x for x in held if x[0][f]]
                left = [x for x in left if not x[0][f]]
                only = sum(sum(x[0].values()) == 1 for x in failing)
                out[part, order, step] = (len(left), len(gone), len(failing) - len(gone), only, sum(bool(x[1]) for x in gone), sum(bool(x[2]) for x in gone))
                totals[part, f] += len(gone)
    return {k: (*v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, given, labels, parts=5):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(filter_audit.failure_masks(docs(spark, given, parts), F.col("lang")), known, 5).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_equals_brute_force(spark, seed):
    given, rng = rows(seed), random.Random(seed)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, *_ in given if i is None or i % 3] + [(5, 1, 0), (5, 0, 1)]
    assert audited(spark, given, [(*x, "z") for x in labels]) == brute_audit(given, labels)


def test_copies_over_many_parts_of_the_sort(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        given = [(k, "one text", "en", "a") for k in range(500)] + [(k, f"text {k}", "en", "a") for k in range(500, 520)] + [(7, "one text", "de", "a"), (0, "one text", "en", "a")]
        masks = filter_audit.failure_masks(docs(spark, given, 9), F.col("lang"))
        twice = {(r.doc_id, r.part): r.n for r in masks.filter("mask >= 16").collect()}
        assert len(twice) == 500 and (0, "en") not in twice and twice[7, "de"] == 1
        assert audited(spark, given, [(1, 1, 1, "")]) == brute_audit(given, [(1, 1, 1)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_fingerprints_of_different_texts():
    """The task's function, on a sorted part whose fingerprints collide."""
    import pyarrow as pa

    part = [(1, b"a", 3, "p"), (1, b"a", 5, "p"), (1, b"b", 4, "p"), (2, b"c", 1, "p"), (2, b"c", 1, "p"), (2, b"c", None, "p"), (9, b"d", 8, "p"), (9, b"e", 2, "p"), (9, b"e", 6, "p")]
    run = filter_audit._masks(filter_audit.CONDITIONS, filter_audit.SYMBOLS)
    names = ["print", "text", "doc_id", "part"]
    for cut in range(len(part)):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in x], pa.schema([("print", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string())])) for x in (part[:cut], part[cut:]) if x]
        got = [(r["doc_id"], r["mask"] >> 4, r["n"], r["edge"]) for b in run(iter(batches)) for r in b.to_pylist()]
        assert sorted(got, key=str) == sorted([(3, 0, 1, b"a"), (5, 1, 1, None), (4, 0, 1, b"b"), (1, 0, 2, None), (None, 0, 1, None), (8, 0, 1, b"d"), (2, 0, 1, b"e"), (6, 1, 1, None)], key=str)


def test_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1, "")]) == {}
    one = audited(spark, [(1, None, None, None)], [])
    assert len(one) == 600 and one["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


# --- 12: centroid clustering -----------------------------------------------------------------------------------------


def brute_clusters(given, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in given if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda x: (name(x[0]), x[1]))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        best = [min((square(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centres)):
                own = [v for (_, v), b in zip(kept, best, strict=True) if b[1] == n]
                if own:
                    centres[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    sums = collections.Counter()
    for d, n in best if kept else []:
        sums[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i if i is not None else -1, n, d, sums[n], sum(sums.values()), digest[n]) for (i, _), (d, n) in zip(kept, best, strict=True)) if kept else [])


def clustered(spark, given, **how):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in given], "vec_id long, embedding array<float>, cluster int, n int").repartition(4)
    got = elkan.cluster(df, F.col("embedding"), F.col("vec_id"), **how).collect()
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    given = [(k, (centres[k % 6] + rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for k in range(300)]
    grid = [(1000 + k, [float(x) for x in np.array([k % 3, k // 3 % 3, 0, 0, 0, 0, 0, 0]) / 256]) for k in range(60)]  # many ties and copies
    odd = [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [1.0] * 7 + [None]), (2004, [float("nan")] + [0.0] * 7), (2005, [float("inf")] + [0.0] * 7), (None, [0.5] * 8), (3, given[7][1]), (3, given[7][1]), (2006, [-0.0] * 8), (2007, [2e5] * 8)]
    every = given + grid + odd
    assert clustered(spark, every, k=12, rounds=4, dims=8) == brute_clusters(every, 12, 4, 8)


def test_few_or_no_vectors(spark):
    given = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [-5.0, 2.0])]
    assert clustered(spark, given, k=40, rounds=5, dims=2) == brute_clusters(given, 40, 5, 2)
    assert clustered(spark, [], dims=2) == [] and clustered(spark, [(1, [1.0])], dims=2) == []
    huge = [(4, [1e30, 0.0]), (5, [3e38, -3e38])]
    assert clustered(spark, given + huge, k=40, rounds=5, dims=2) == brute_clusters(given, 40, 5, 2)


def test_bounds_skip_most_distances_and_change_nothing():
    rng = np.random.default_rng(4)
    middle = rng.integers(-3000, 3000, (20, 16))
    x = (middle[rng.integers(0, 20, 4000)] + rng.integers(-200, 200, (4000, 16))).astype(np.int64)
    centres = x[:20].copy()
    cluster, upper, lower, shift = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, 20), np.float32), np.zeros(20)
    worked = []
    for _ in range(6):
        cluster, upper, lower, exact, n = elkan.assign(x, cluster, upper, lower, centres, shift)
        worked.append(n)
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        own = d[np.arange(4000), cluster]
        assert (exact[exact >= 0] == own[exact >= 0]).all()
        assert (upper >= np.sqrt(own)).all() and (lower <= np.sqrt(d)).all()
        new = np.stack([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centres[c] for c in range(20)])
        shift, centres = np.sqrt(((new - centres) ** 2).sum(1)) * (1 + 1e-12), new
    assert worked[-1] < 0.25 * 4000 * 20 and sum(worked) < 0.6 * 6 * 4000 * 20


# --- 13: quality rules -----------------------------------------------------------------------------------------------


def plain(line):
    return " ".join(re.sub("[0-9]", "0", w.translate({c: c + 32 for c in range(65, 91)})) for w in WORD.findall(line))


def brute_quality(given, most_docs, most_per_mille, least_left):
    held, whole = collections.defaultdict(set), collections.defaultdict(set)
    for _, t, _, s in given:
        whole[s].add(t or "")
        for line in (t or "").split("\n"):
            if plain(line):
                held[s, plain(line)].add(t or "")
    common = {k for k, v in held.items() if len(v) > most_docs and 1000 * len(v) > most_per_mille * len(whole[k[0]])}
    out = []
    for i, t, _, s in given:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lost = sum(len(WORD.findall(x)) for x in lines if (s, plain(x)) in common)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        kept = not failed and 100 * (len(w) - lost) >= least_left * len(w)
        left = "\n".join(x for x in t.split("\n") if (s, plain(x)) not in common)
        out.append((i if i is not None else -1, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, kept, lost, left))
    return sorted(out)


@pytest.mark.parametrize(("seed", "most_docs", "most_per_mille"), [(1, 10, 1), (2, 3, 1), (2, 3, 300)])
def test_quality_equals_brute_force(spark, seed, most_docs, most_per_mille):
    given = rows(seed)
    want = brute_quality(given, most_docs, most_per_mille, 80)
    assert {x[7] for x in want} == {True, False} and (most_per_mille == 300 or any(x[8] and x[7] for x in want))
    got = quality_rules.quality(docs(spark, given), F.col("source"), most_docs, most_per_mille, 80).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.n_lost_words) for r in got) == [x[:9] for x in want]


def test_stripped_texts(spark):
    given = rows(3)
    df = docs(spark, given)
    got = quality_rules.strip_lines(df, F.col("source"), 5, 1, 50)
    assert got.columns == df.columns
    kept = [(x[0], x[9]) for x in brute_quality(given, 5, 1, 50) if x[7]]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in got.collect()) == sorted(kept)


def test_copies_alone_make_no_line_common(spark):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in "abcdef") for k in range(6))
    given = [(k, text, "en", "a") for k in range(60)]
    assert all(r.kept and not r.n_lost_words for r in quality_rules.quality(docs(spark, given), F.col("source"), 3).collect())


def test_quality_of_nothing(spark):
    assert quality_rules.quality(docs(spark, []), F.col("source")).collect() == []
    got = quality_rules.quality(docs(spark, [(None, None, None, None)]), F.col("source")).collect()
    assert [(r.doc_id, r.n_words, r.word_chars, r.base_failed, r.kept) for r in got] == [(None, 0, 0, True, False)]


def test_runs_over_slices_and_chunks():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 3000).astype(np.uint64)
    row = np.sort(rng.integers(0, 40, 3000))
    with np.errstate(over="ignore"):
        got = quality_rules.repeated_words(quality_rules.mix(words), row, 41)
    for r in range(41):
        w = words[row == r].tolist()
        runs = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        assert got[r] == len({k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)})
