"""Training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgraph.llm import ann, decontam, license_scan, lm_score, shard_map, toxicity, url_filter
from haulgraph.llm.line_dedup import drop_lines
from haulgraph.llm.ngram_join import Answers, drop_near_copies, jaccard_components, jaccard_links
from haulgraph.llm.queries import URL_RULES

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket int, line string, score double"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, repeated lines and awkward ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["été", "The", "the,"]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = sentence(55)
    texts = ["\n".join(sentence(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    texts += texts[:5] + [t + " " + passage for t in texts[5:15]]
    base = sentence(120).split(" ")
    for _ in range(25):
        edited = list(base)
        for _ in range(rng.randint(0, 6)):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        texts.append(" ".join(edited))
    texts += [None, "", " \n\t ", "one", "one", "a b c d", "A b C d", "x" * 5000, "long " * 4000, passage, passage.upper()]
    return list(enumerate(texts))


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", 0.5) for i, t in rows], DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 2: n-gram Jaccard join ------------------------------------------------------------------------------------------


def brute_components(rows, n=5, percent=75):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_nothing_and_of_repeats(spark):
    assert jaccard_components(empty(spark)).count() == 0
    got = jaccard_components(frame(spark, [(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f"), (None, "z")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (4, 4), (4, 4), (9, 4)]


def brute_links(texts, n=5, percent=75):
    sets = [frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) for w in map(words, texts) if w]
    sets = list(dict.fromkeys(sets))
    return sum(100 * len(a & b) >= percent * len(a | b) for i, a in enumerate(sets) for b in sets[:i])


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_brute_force(spark, seed):
    rows = corpus(seed)
    links, sets = jaccard_links(frame(spark, rows))
    assert links.count() == brute_links([t for _, t in rows])
    assert sets.count() == len(rows)


def test_a_large_group_that_shares_a_passage_but_does_not_link(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(20)) + " " + passage) for i in range(2000)]
    rows += [(5000 + i, passage + f" e{i}") for i in range(300)]  # near copies of one another
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: i if i < 5000 else 5000 for i, _ in rows}


def test_answers_are_derived_from_a_similar_set():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate(([0], rng.choice(np.arange(1, 220), 150, replace=False)))) for _ in range(12)]
    base = np.arange(200)
    sets += [np.unique(np.concatenate((base[:1], np.delete(base, rng.choice(np.arange(1, 200), 8, replace=False))))) for _ in range(12)]
    answers, asked = Answers(75), 0
    for a in sets:
        others = [(k, len(b), lambda b=b: b) for k, b in enumerate(sets)]
        want = [100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets]
        assert answers.of(a, len(a), others) == want
        asked += len(others)
    assert answers.counted < 0.8 * asked


def test_near_copies_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "q r s t u v"), (3, "a b c d e f"), (3, "z z z z y"), (7, "z z z z y"), (7, "m n o p q"), (None, None), (2, "")]
    got = drop_near_copies(frame(spark, rows))
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert kept == sorted([(None, "q r s t u v"), (3, "a b c d e f"), (3, "z z z z y"), (7, "m n o p q"), (None, None), (2, "")], key=str)
    assert got.columns == empty(spark).columns


# --- 10: line dedup --------------------------------------------------------------------------------------------------


def near(a, b, most=1):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1] <= most


def brute_lines(rows, least=8, most=1):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            w = words(line)
            if not w or not any(w == v or len(w) >= least and len(v) >= least and abs(len(v) - len(w)) <= most and near(w, v, most) for v in seen):
                kept.append(line)
            seen.append(w)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    rows = corpus(4, 25)
    lines = [line for _, t in rows if t and len(t) < 3000 for line in t.split("\n")]
    for _ in range(30):  # lines one edit away from others
        w = rng.choice(lines).split(" ")
        k, new = rng.randrange(len(w)), f"n{rng.random()}"
        w[k : k + rng.randint(0, 1)] = [new] if rng.random() < 0.6 else []
        rows.append((len(rows), "\n".join([" ".join(w), rng.choice(lines)])))
    out = drop_lines(frame(spark, rows))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == brute_lines(rows)
    assert out.columns == [*DOCS.replace(",", "").split()[::2], "n_lines", "n_dropped"]
    assert drop_lines(empty(spark)).count() == 0


def test_line_dedup_of_null_and_repeated_ids_and_clashing_names(spark):
    rows = [(1, "beta two"), (4, "new first\nbeta two"), (4, "other first\nunique line kept"), (None, "same line here\nmore"), (None, "same line here\nelse"), (4, "new first\nbeta two"), (5, None)]
    names = "doc_id long, gone string, n_lines int, text string, gone_doc long, `at` int, line long, n_dropped string, dropped int, c0 int"
    out = drop_lines(spark.createDataFrame([(i, "g", 7, t, 8, 9, 10, "x", 11, 12) for i, t in rows], names))
    assert out.columns == ["doc_id", "gone", "text", "gone_doc", "at", "line", "dropped", "c0", "n_lines", "n_dropped"]
    got = out.collect()
    assert {(r.gone, r.gone_doc, r.at, r.line, r.dropped, r.c0) for r in got} == {("g", 8, 9, 10, 11, 12)}
    kept = collections.Counter((r.doc_id, r.text) for r in got)
    null = sorted(t for (i, t) in kept if i is None)
    assert null in (["more", "same line here\nelse"], ["else", "same line here\nmore"])
    assert {k: n for k, n in kept.items() if k[0] is not None} == {(1, "beta two"): 1, (4, "new first"): 2, (4, "other first\nunique line kept"): 1, (5, None): 1}


@pytest.mark.parametrize("edits", [2, 3])
def test_line_dedup_with_a_larger_bound(spark, edits):
    rng = random.Random(edits)
    base = [[f"w{rng.randrange(6)}" for _ in range(rng.randint(3, 7))] for _ in range(25)]
    rows = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = [f"w{rng.randrange(6)}"] if rng.random() < 0.6 else []
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.text for r in drop_lines(frame(spark, rows), max_edits=edits, min_words=3).collect()}
    assert got == brute_lines(rows, 3, edits)


# --- 4: SentencePiece ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_codec_equals_the_library(spark, model):
    import sentencepiece

    from haulgraph.llm.piece_codec import encode_documents

    rng = random.Random(1)
    odd = ["  a  b", "ﬁ Å \u3000x\xa0y", "a\tb\r\n", "▁x ▁▁", "<s>hi</s><unk>", "\x00z", "😀é̀", "A ", "\ufeffq", " " * 40, "\n\n", "<0x41>"]
    odd += ["".join(rng.choice("ab \n\t▁é梦😀x  the") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = corpus(6) + [(1000 + i, t) for i, t in enumerate(odd)]
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    whole = {r.doc_id: r for r in encode_documents(frame(spark, rows), model).collect()}
    short = {r.doc_id: r for r in encode_documents(frame(spark, rows), model, digests=True, ship=True).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (list(whole[i].ids), whole[i].decoded, whole[i].n_tokens) == (ids, library.decode(ids), len(ids))
        assert short[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_documents(empty(spark), model).count() == 0


# --- 6: LM scoring ---------------------------------------------------------------------------------------------------


def test_language_model_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_TOKENS", 700)
    rows = corpus(7)
    learned = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows}
    tokens = {i: words(t) + [None] for i, t in rows}
    c, pairs, begins = collections.Counter(), collections.Counter(), 0
    for i, w in tokens.items():
        if learned[i]:
            c.update(w)
            pairs.update(zip(["begin", *w[:-1]], w, strict=True))
            begins += 1
    n, v, m = sum(c.values()), len(c), 48.0
    p = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in lm_score.score(frame(spark, rows), learn).collect()}
    for i, w in tokens.items():
        base = sum(math.log10(p(x)) for x in w)
        score = sum(math.log10((pairs[a, x] + m * p(x)) / ((begins if a == "begin" else c[a]) + m)) for a, x in zip(["begin", *w[:-1]], w, strict=True))
        g = got[i]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(base) and g.score == pytest.approx(score)
    assert lm_score.score(empty(spark), learn).count() == 0
    nothing = lm_score.score(frame(spark, rows[:3]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)


# --- 7: toxicity -----------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("ba", "lo", "mi", "ter", "qua") for b in ("na", "ri", "sto", "vel", "um", "ex")]
    bad = ["scoundrel", "wretch", "villain"]
    rows, labels = [], {}
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if toxic := i % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels[i] = int(toxic)
    rows += [(1000, None), (1001, ""), (1002, "Villain, villain!")]
    known = spark.createDataFrame([(i, y) for i, y in labels.items() if i % 4], "doc_id long, toxic int")
    field = toxicity.fit(frame(spark, rows), known)
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows), field).collect()}
    assert all((got[i].score >= 0.3) == bool(labels[i]) for i in range(0, 600, 4))
    assert got[1002].score > 0.5 and [(s.start, s.stop) for s in got[1002].spans] == [(0, 7), (9, 16)]
    assert got[1000].score == got[1001].score < 0.3
    assert toxicity.score(empty(spark), field).count() == 0
    unlabelled = toxicity.fit(frame(spark, rows), known.limit(0))
    assert {round(r.score, 3) for r in toxicity.score(frame(spark, rows[:4]), unlabelled).collect()} == {0.0}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    field = toxicity.Field(np.zeros(4), rng.normal(size=(2, 2)), 0.0)
    e, sequence = rng.normal(size=7), np.array([0, 0, 0, 0, 1, 1, 2])
    p, _ = field.marginals(e, sequence)
    for s in range(3):
        own = e[sequence == s]
        total, one = 0.0, np.zeros(len(own))
        for k in range(2 ** len(own)):
            y = [(k >> j) & 1 for j in range(len(own))]
            w = math.exp(sum(a * b for a, b in zip(own, y, strict=True)) + sum(field.transition[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
            total += w
            one += w * np.array(y)
        assert p[sequence == s] == pytest.approx(one / total)


def chain(field, e):
    """Plain forward-backward of one line: probabilities of the toxic label, expected transitions, log of the sum."""
    t, x = np.exp(field.transition), np.stack([np.ones(len(e)), np.exp(e)], 1)
    a, b, logs = [x[0]], [np.ones(2)], 0.0
    for k in range(1, len(e)):
        a.append(x[k] * (a[-1] @ t))
        logs += math.log(a[-1].sum())
        a[-1] = a[-1] / a[-1].sum()
    for k in range(len(e) - 1, 0, -1):
        b.append(t @ (x[k] * b[-1]))
        b[-1] = b[-1] / b[-1].sum()
    b = b[::-1]
    p = np.array([(u * v)[1] / (u * v).sum() for u, v in zip(a, b, strict=True)])
    pairs = sum((c / c.sum() for c in (a[k - 1][:, None] * t * (x[k] * b[k]) for k in range(1, len(e)))), np.zeros((2, 2)))
    return p, pairs, logs + math.log(a[-1].sum())


def test_long_lines_are_one_chain():
    rng = np.random.default_rng(4)
    field = toxicity.Field(np.zeros(4), rng.normal(size=(2, 2)) * 2, 0.0)
    lengths = [1, 200, 64, 65, 3, 128, 700]
    line, e = np.repeat(np.arange(len(lengths)), lengths), rng.normal(size=sum(lengths)) * 3
    p, parts = field.marginals(e, line)
    want = [chain(field, e[line == k]) for k in range(len(lengths))]
    assert p == pytest.approx(np.concatenate([x[0] for x in want]), abs=1e-9)
    assert field.pairs(parts) == pytest.approx(sum(x[1] for x in want), abs=1e-6)
    step = 1e-5  # the expected transitions are the gradient of the log of the sum
    for i, j in ((0, 1), (1, 1)):
        near = []
        for sign in (1, -1):
            field.transition[i, j] += sign * step
            near.append(sum(chain(field, e[line == k])[2] for k in range(len(lengths))))
            field.transition[i, j] -= sign * step
        assert field.pairs(parts)[i, j] == pytest.approx((near[0] - near[1]) / (2 * step), rel=1e-4)


def test_document_scores_equal_a_plain_chain(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.choice(["ok", "fine", "wretch", "villain", f"w{rng.randrange(50)}"][: 3 + 2 * (i % 2)]) for _ in range(rng.randint(1, 150))) for _ in range(3))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, rows[3][1]), (70, None), (71, " \n "), (72, "wretch " * 30_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    field = toxicity.fit(frame(spark, rows), labels)
    got = collections.defaultdict(set)
    for r in toxicity.score(frame(spark, rows), field, spans=False).collect():
        got[r.doc_id].add(round(r.score, 9))
    for i, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, _, _, line, own, near = toxicity._tokens(raw, np.array([0, len(raw)]))
        e = field.emission(toxicity._columns(own, near))
        p = np.concatenate([chain(field, e[line == k])[0] for k in range(int(line.max()) + 1)]) if len(line) else np.zeros(0)
        inputs = np.array([1, p.max() if len(p) and p.max() > 0.01 else 0, math.log1p(p.sum()), p.sum() / max(1, len(p))])
        assert got[i] == {round(1 / (1 + math.exp(-min(30, max(-30, inputs @ field.regression)))), 9)}
    assert got[None] == got[3]


# --- 9: decontamination ----------------------------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(2000)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(30) + ". " + text(6)) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    rows = [(i, text(rng.randint(20, 300))) for i in range(80)]
    want = set()
    for i in range(0, 40, 2):
        k = i % 12
        w = items[k][1].split(" ")
        if i % 4:  # a paraphrase: every ninth word differs
            w = [x if j % 9 else f"other{j}" for j, x in enumerate(w)]
        rows[i] = (i, rows[i][1] + " " + " ".join(w).upper() + "\n" + text(40))
        want.add((i, k))
    rows += [(500, None), (501, ""), (502, items[0][1])]
    want.add((502, 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(frame(spark, rows), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert decontam.leaks(empty(spark), benchmark).count() == 0
    assert decontam.leaks(frame(spark, rows), benchmark.limit(0)).count() == 0


def test_leaks_equal_an_exhaustive_search(spark):
    """Every window of every document against every item by a plain longest common subsequence."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]  # few words, so much is shared by chance
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.randint(8, 90)) + ". " + text(5)) for i in range(10)] + [(20, "v1 v2"), (21, "V3, v4 v5"), (22, text(20) + ". " + text(3)), (10, None)]
    items += [(30, items[0][1]), (30, items[1][1])]
    rows = []
    for i in range(60):
        w = text(rng.randint(0, 250)).split(" ")
        if i % 2:
            part = rng.choice(items[:10])[1].replace(".", "").split(" ")
            for _ in range(rng.randint(0, len(part) // 2)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            w[rng.randrange(len(w) + 1) : 0] = part
        rows.append((i, " ".join(w)))
    rows += [(None, items[3][1]), (5, rows[5][1]), (70, ""), (71, None), (72, text(3000))]
    split = lambda t: re.findall("[^\\s!-/:-@\\[-`{-~]+", (t or "").lower())

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    want = set()
    for i, t in rows:
        w = split(t)
        for item, x in items:
            if not (q := split(x)):
                continue
            answer = split(x.split(".")[-1])
            answer = answer if 3 <= len(answer) < len(q) else q[-6:]
            reach = max(0, len(q) - 32)
            for at in range(-32, len(w), 32):
                if at < 0 and at + 32 < 0 or not w:
                    continue
                near = w[max(0, at - reach) : at + 64 + reach]
                if len(q) < 5 and not any(near[k : k + len(q)] == q for k in range(len(near))):
                    continue
                share = lcs(q, near) / len(q)
                if share >= 0.6 or share >= 0.55 and lcs(answer, near) >= 0.8 * len(answer):
                    want.add((i, item))
                    break
    got = decontam.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert {i for _, i in want} >= {20, 30} and len(want) < 0.8 * len(rows) * len(items)


def test_right_vectors_equal_an_exact_decomposition():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(400, 8)) @ np.diag([9, 7, 5, 4, 3, 2, 1.5, 1]) @ rng.normal(size=(8, 90))
    r = decontam.sketch(90, 24)
    s, v = decontam.right_vectors(a.T @ (a @ r), r, 6)
    _, want, vt = np.linalg.svd(a, full_matrices=False)
    assert s == pytest.approx(want[:6], rel=1e-6)
    assert np.abs((v * vt[:6].T).sum(0)) == pytest.approx(np.ones(6), abs=1e-6)


def test_long_items_count_as_a_whole(spark):
    """Half of an item is not the item, however long it is; its parts add up wherever they stand."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(40_000)}"
    items = {n: [word() for _ in range(n)] for n in (2000, 3000, 9000)}
    noise = [word() for _ in range(12_000)]
    rows = []
    for n, w in items.items():
        spread = [x for k, x in enumerate(w) if k % 10 < 7]
        rows += [(n, w[: n // 2]), (n + 1, noise[:3000] + w + noise[3000:6000]), (n + 2, noise[:500] + spread + noise[:40]), (n + 3, [x for k, x in enumerate(w) if k % 10 < 5])]
    rows.append((7, noise))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, round(r.share, 2)) for r in decontam.leaks(frame(spark, [(i, " ".join(w)) for i, w in rows]), benchmark).collect()}
    assert got == {(n + k, n): ("copy", share) for n in items for k, share in ((1, 1.0), (2, 0.7))}


@pytest.mark.parametrize("cosine", [0.2, 2.0])
def test_leaks_do_not_depend_on_the_rank_or_the_cosine(spark, cosine):
    """Against every window of every document, with far fewer directions than words."""
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(k - 6) + ". " + text(6)) for i, k in enumerate([12, 30, 37, 59, 64, 150] * 10)]
    rows = [(i, text(rng.randint(20, 300))) for i in range(40)]
    for i in range(60):
        w = [x for x in items[i][1].split(" ") if rng.random() < (1, 0.9, 0.65, 0.58)[i % 4]]
        rows.append((100 + i, text(rng.randint(0, 100)) + " " + " ".join(w) + " " + text(rng.randint(0, 90))))
    want = set()
    parsed = [decontam._item(*x) for x in items]
    for i, t in rows:
        h = decontam._item(0, t)[1]
        for k, w, answer in parsed:
            for at in range(0, len(h), decontam.HALF):
                reach = max(0, len(w) - decontam.HALF)
                near = h[max(0, at - reach) : at + decontam.WINDOW + reach]
                share = decontam.lcs(w, near) / len(w)
                if share >= 0.6 or share >= 0.55 and decontam.lcs(answer, near) >= 0.8 * len(answer):
                    want.add((i, k))
    got = decontam.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), rank=4, cosine=cosine)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) >= 40


def test_lcs():
    assert decontam.lcs([1, 2, 3, 4, 2], [2, 9, 4, 2, 3]) == 3
    assert decontam.lcs([], [1]) == 0


# --- 1: nearest neighbours -------------------------------------------------------------------------------------------


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 400)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors: ties to the lesser id
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [0.0] * 16, 1), (2100, [1.0] * 15 + [float("nan")], 1), (2150, [1.0] * 3, 1), (None, [1.0] * 16, 1), (2200, [None] + [1.0] * 15, 1), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, rerank=30).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = 0
    assert set(got) == set(range(0, 900, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(c - s[v]) < 1e-9 for _, v, c in found)
        hit += len(set(best) & {v for _, v, _ in found})
    assert hit >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert len(ann.nearest(df.filter("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()) == 2


def test_neighbours_of_very_small_and_very_large_doubles(spark):
    x = [[1e-50, 2e-50], [1e39, 1.0], [1e200, 2e200], [3.0, 1e-300], [0.0, 5e-324], [1e308, -1e308]]
    df = spark.createDataFrame([(50 * i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    unit = [[a / max(map(abs, v)) for a in v] for v in x]
    cosine = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    assert got == {(50 * i, 50 * j): pytest.approx(cosine(unit[i], unit[j]), abs=1e-12) for i in range(6) for j in range(6) if i != j}


def test_neighbours_among_near_copies(spark):
    """A third of the rows are near copies of one vector, more than are ranked exactly at first."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1800, 32))
    x[:600] = x[0] + 0.02 * rng.normal(size=(600, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, rerank=50).collect():
        got[r.query_id].add(r.vec_id)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for q in range(0, 1800, 50):
        s = unit @ unit[q]
        s[q] = -9
        assert got[q] == set(np.argsort(-s)[:5].tolist())


# --- 3, 5, 8 ---------------------------------------------------------------------------------------------------------


def test_licenses_are_inherited_from_the_nearest_directory(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x.txt", "words only"), ("a/b/c/d.txt", "words"),
        ("a/b/own.txt", "intro words here and more of them so this is no licence file at all\nLicensed under CC BY-NC 4.0.\nmore"), ("z/y.txt", None), (None, ""), ("top.txt", "x"),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.origin) for r in license_scan.licenses(df).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own"), "a/b/LICENSE": ("Apache-2.0", "own"), "a/x.txt": ("MIT", "a"), "a/b/c/d.txt": ("Apache-2.0", "a/b"), "a/b/own.txt": ("CC-BY-NC-4.0", "own"),
        "z/y.txt": (None, None), None: (None, None), "top.txt": (None, None),
    }
    assert license_scan.licenses(df.limit(0)).count() == 0


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licences_of_real_files(spark):
    forms = license_scan.TEMPLATES
    long = {k: max(v, key=len) for k, v in forms.items()}
    gpl = next(t for t in forms["GPL-3.0"] if t.startswith("This program"))
    apache = next(t for t in forms["Apache-2.0"] if "obtain a copy" in t)
    code = "\n".join(f"int f{i}(int a{i}) {{ return a{i} * {i} + g{i}(a{i}); }}" for i in range(200))
    rows = [
        ("m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped(long["MIT"], 72)), ("m/src/a.c", code),
        ("b/LICENSE.txt", "Copyright (c) 2001, The Authors\nAll rights reserved.\n\n" + wrapped(long["BSD-3-Clause"], 66)), ("b/x/y/z.c", code),
        ("a/COPYING", "\n      Apache License\n   Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.\n\n" + code),
        ("a/deep/er/file.py", "import os"), ("g/four.c", wrapped("Copyright (C) 2011 Some One. " + gpl, 70, " * ") + "\n" + code), ("g/lone.c", code),
        ("p/header.py", "#!/usr/bin/env python\n# Copyright 2015 Some One\n#\n" + wrapped(apache, 60, "# ") + "\n" + code), ("p/mpl.js", "/* " + wrapped(long["MPL-2.0"], 50, " * ") + " */\n" + code),
        ("s/spdx.h", "// SPDX-License-Identifier: BSD-3-Clause\n" + code), ("s/inside.md", "Our code is good. It is released under the MIT License. See the docs for more of this and that."),
        ("s/prose.txt", "The use of this software in any form is the work of the people who use it, and the terms of the work are not the terms of the law."),
    ]
    df = spark.createDataFrame([(i, p, t, "x", 3) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, own string, score int")
    got = {r.path: (r.license, r.licence_file, r.origin) for r in license_scan.licenses(df).collect()}
    assert got == {
        "m/LICENSE": ("MIT", True, "own"), "m/src/a.c": ("MIT", False, "m"), "b/LICENSE.txt": ("BSD-3-Clause", True, "own"), "b/x/y/z.c": ("BSD-3-Clause", False, "b"),
        "a/COPYING": ("Apache-2.0", True, "own"), "a/deep/er/file.py": ("Apache-2.0", False, "a"), "g/four.c": ("GPL-3.0", False, "own"), "g/lone.c": (None, False, None),
        "p/header.py": ("Apache-2.0", False, "own"), "p/mpl.js": ("MPL-2.0", False, "own"), "s/spdx.h": ("BSD-3-Clause", False, "own"), "s/inside.md": ("MIT", False, "own"), "s/prose.txt": (None, False, None),
    }


def test_near_licences_are_told_apart(spark):
    """Texts as projects write them, not the module's own."""
    grant = " * This {0} is free software; you can redistribute it and/or\n * modify it under the terms of the GNU {1}\n * License as published by the Free Software Foundation; either\n * version {2} of the License, or (at your option) any later version.\n *\n * This {0} is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n * {1} License for more details.\n *\n * You should have received a copy of the GNU {1}\n * License along with this {0}; if not, write to the Free Software\n * Foundation, Inc., 51 Franklin Street, Boston, MA 02110-1301, USA.\n"
    header = lambda *xs: "/*\n * frob.c - frobnicates\n * Copyright (C) 1999 A. Hacker\n *\n" + grant.format(*xs) + " */\nint main(void) { return 0; }\n"
    two = "Copyright (c) 2014, Some Body\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer.\n\n* Redistributions in binary form must reproduce the above copyright notice,\n  this list of conditions and the following disclaimer in the documentation\n  and/or other materials provided with the distribution.\n\n"
    third = "* Neither the name of Some Body nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n\n"
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE\nDISCLAIMED.\n'
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License.\n"
    rows = [
        ("2/x.c", header("program", "General Public", "2"), "GPL-2.0"), ("3/x.c", header("program", "General Public", "3"), "GPL-3.0"), ("1/x.c", header("program", "General Public", "1"), None),
        ("a/x.c", header("program", "Affero General Public", "3"), "AGPL-3.0"), ("l/x.c", header("library", "Lesser General Public", "2.1"), "LGPL-2.1"), ("m/x.c", header("library", "Lesser General Public", "3"), "LGPL-3.0"),
        ("k/x.c", header("library", "Library General Public", "2"), "LGPL-2.0"), ("2/none.c", "int x;", None), ("b/readme", two + end, "BSD-2-Clause"), ("b/none.c", "int x;", "BSD-2-Clause"),
        ("c/readme", two + third + end, "BSD-3-Clause"), ("s/1.c", "// SPDX-License-Identifier: BSD-2-Clause\nint x;", "BSD-2-Clause"), ("s/2.c", "/* SPDX-License-Identifier: (gpl-2.0-or-later) */ int x;", "GPL-2.0"),
        ("s/3.c", "# SPDX-License-Identifier: LicenseRef-Ours\nreleased under the MIT License", "MIT"), ("s/4.c", "# SPDX-License-Identifier:\n", None), ("d/1", cc.format(""), "CC-BY-4.0"), ("d/2", cc.format("-ShareAlike"), "CC-BY-SA-4.0"),
        ("d/3", cc.format("-NonCommercial-NoDerivatives"), "CC-BY-NC-ND-4.0"), ("d/4", "All of it: CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("n/1", "This code is not released under the MIT License.", None), ("n/2", "It is no longer, and never was, released under the MIT License.", None),
        ("n/3", "We do not care much for it. Released under the MIT License.", "MIT"), ("n/4/", "Released under the MIT License.", "MIT"), ("///", "", None),
    ]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r.path: (r.license, r.licence_file) for r in license_scan.licenses(df).collect()}
    assert {p: x for p, (x, _) in got.items()} == {p: x for p, _, x in rows}
    assert {p for p, (_, x) in got.items() if x} == {"b/readme", "c/readme"}


def test_licences_of_repeated_tied_and_long_texts(spark):
    forms = {"B": ["one two three four"], "A": ["one two three four"], "C": ["five six seven eight"]}
    text = "zzz yyy xxx one two three four"
    df = spark.createDataFrame([(1, "d/a", text), (1, "d/a", text), (None, "d/LICENSE", "five six seven eight"), (2, "d/e/x", "w " * 100_000 + text), (3, "d/y", "one two")], "doc_id long, path string, text string")
    got = collections.Counter((r.doc_id, r.license, r.origin) for r in license_scan.licenses(df, forms).collect())
    assert got == {(1, "A", "own"): 2, (None, "C", "own"): 1, (2, "A", "own"): 1, (3, "C", "d"): 1}


def brute_templates(shapes, many=20, varied=0.5, similar=1.96):
    """{(host, shape): template} of shapes {(host, shape): (pages, labelled, bad)}, by recursion from the root."""
    out = {}

    def grow(members, template, level):
        for key in [k for k in members if len(k[1]) <= level]:
            out[key] = template
        deeper = [k for k in members if len(k[1]) > level]
        child = collections.defaultdict(lambda: np.zeros(3))
        for k in deeper:
            child[k[1][level]] += shapes[k]
        total, following = sum(child.values()), collections.defaultdict(list)
        for k in deeper:
            pages, labelled, bad = child[k[1][level]]
            share = total[2] / max(1, total[1])
            z = (bad - share * labelled) / math.sqrt(max(share * (1 - share) * labelled, 1e-9))
            star = len(child) >= many and len(child) >= varied * total[0] or len(child) > 1 and abs(z) < similar and total[1] > 0
            following[template + "/" + ("*" if star else k[1][level])].append(k)
        for name, some in following.items():
            grow(some, name, level + 1)

    for h in {k[0] for k in shapes}:
        grow([k for k in shapes if k[0] == h], "", 0)
    return out


def test_templates_equal_brute_force(spark):
    rng = random.Random(9)
    urls = [f"http://h{rng.randrange(3)}.test/" + "/".join(rng.choice(["a", "b", "c", f"v{rng.randrange(40)}", str(rng.randrange(9))]) for _ in range(rng.randint(0, 5))) for _ in range(400)]
    urls += ["http://h0.test/" + "deep/" * 60 + x for x in ("a", "b")] + ["http://h1.test/bad/" + "x/" * 8 + f"spam/{i}" for i in range(12)] + ["http://h1.test/bad/" + "x/" * 8 + f"fine/{i}" for i in range(12)]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(None, urls[0], "x", 1), (3, urls[3], "x", 1)]
    labels = [(i, int("spam" in u or "/a/" in u and rng.random() < 0.8 or rng.random() < 0.1)) for i, u in enumerate(urls) if i % 2] + [(1, 1), (None, 1), (5, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, shape string, purity int")
    got = url_filter.judge(pages, spark.createDataFrame(labels, "page_id long, bad int"), []).collect()
    known = {}
    for i, y in labels:
        if i is not None and y is not None:
            known[i] = max(y, known.get(i, 0))
    shape = lambda u: tuple("<n>" if x.isdigit() else x for x in u.split("/", 3)[3].split("/"))
    shapes = collections.defaultdict(lambda: np.zeros(3))
    for i, u, *_ in rows:
        shapes[u.split("/")[2], shape(u)] += (1, i in known, known.get(i, 0))
    template = brute_templates(shapes)
    sums, hosts = collections.defaultdict(lambda: np.zeros(3)), collections.defaultdict(lambda: np.zeros(3))
    for k, x in shapes.items():
        sums[k[0], template[k]] += x
        hosts[k[0]] += x
    every = sum(hosts.values())
    purity = lambda h, t: (sums[h, t][2] + 4 * (hosts[h][2] + 4 * every[2] / every[1]) / (hosts[h][1] + 4)) / (sums[h, t][1] + 4)
    want = collections.Counter()
    for i, u, *_ in rows:
        h, t = u.split("/")[2], template[u.split("/")[2], shape(u)]
        want[i, "block" if purity(h, t) >= 0.5 and sums[h, t][1] > 0 else "allow"] += 1
    assert collections.Counter((r.page_id, r.verdict) for r in got) == want
    assert {r.verdict for r in got if r.path.endswith("spam/1")} == {"block"} and {r.verdict for r in got if r.path.endswith("fine/1")} == {"allow"}


def test_url_rules_and_templates(spark):
    urls = ["http://A.example.COM/en/7?x", "https://b.com/en/1#t", "http://c.example.net/de/85", "http://c.example.net/de/7", "x://org/es/", "no scheme", None, "http://h.test/bad/1", "http://com/en", "s://xcom/en/1"]
    urls += [f"http://h.test/bad/{i}" for i in range(2, 40)] + [f"http://h.test/good/{i}" for i in range(40)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int("/bad/" in u)) for i, u in enumerate(urls) if u and i >= 10 and i % 2], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels, URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("b.com", "/en/1", "com/en/", "block")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("org/es/", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[8][2] is None and got[9][2] is None
    assert {got[i][3] for i, u in enumerate(urls) if u and "/bad/" in u} == {"block"}
    assert {got[i][3] for i, u in enumerate(urls) if u and "/good/" in u} == {"allow"}
    assert url_filter.judge(pages.limit(0), labels, URL_RULES).count() == 0


def test_shards_take_turns(spark):
    names = [f"s{i}" for i in range(5)]
    own = [r.shard for r in shard_map.lookup_table(spark, names, 101).orderBy("slot").collect()]
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:12], 16)
    owner, at = [None] * 101, 0
    while None in owner:
        n = names[at % 5]
        slot = next(s for k in range(101) if owner[s := (h(n + "#offset") + k * (h(n + "#skip") % 100 + 1)) % 101] is None)
        owner[slot], at = n, at + 1
    assert own == owner
    df = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    got = shard_map.place(df, "doc_id", names, 101).collect()
    assert len(got) == 3 and all(r.shard == owner[h("" if r.doc_id is None else str(r.doc_id)) % 101] for r in got)
    with pytest.raises(ValueError):
        shard_map.lookup_table(spark, names, 100)


def test_shards_of_clashing_columns_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 7, "old", 1), ("a", 7, "old", 1), (None, 8, "new", 2)], "key string, slot int, shard string, owner int")
    out = shard_map.place(df, "key", ["x", "y"], 7)
    assert out.columns == ["key", "owner", "slot", "shard"] and out.count() == 3 and {r.shard for r in out.collect()} <= {"x", "y"}
    by_shard = shard_map.place(df, "shard", ["x", "y"], 7).collect()
    assert len(by_shard) == 3 and by_shard[0] == by_shard[1]
    assert shard_map.place(df.limit(0), "key", ["x", "y"], 7).count() == 0
