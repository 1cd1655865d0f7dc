"""The pipeline's stages against brute force, each on its own input."""

import random

import pytest
from test_operators import brute_components, brute_lines, words

import corpus_pipeline as P
from haulgraph.llm.common import Scratch


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(40)) for i in range(5)]
    docs = [(i, text(rng.randint(30, 200)) + "\n" + text(20)) for i in range(120)]
    for i in range(0, 60, 4):
        docs[i] = (i, docs[i][1] + " scoundrel wretch scoundrel")
    docs[61] = (61, docs[1][1])  # an exact copy
    docs[63] = (63, docs[3][1].replace("\n", " ") + " one more")  # a near copy that shares no line
    docs[65] = (65, docs[65][1] + "\n" + items[2][1])  # a leak
    docs += [(200, None), (201, ""), (202, "short")]
    labels = [(i, 1, int(i < 60 and i % 4 == 0)) for i in range(120)]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    scratch, kept = Scratch(spark), []
    for _, stage in P.STAGES:
        out = scratch.cut(stage(spark, docs, folder))
        kept.append({r.doc_id: r for r in out.collect()})
        assert out.columns == names or stage is P.encode
        docs = out
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    toxic, lines, groups, clean, encoded = kept
    assert set(toxic) == {i for i in start if not (i < 60 and i % 4 == 0)}
    want = brute_lines([(i, r.text) for i, r in toxic.items()])
    assert {i: r.text for i, r in lines.items()} == {i: t for i, t in want.items() if t is None or words(t) or t == toxic[i].text}
    assert all(r.n_chars == len(r.text or "") for r in lines.values())
    component = brute_components([(i, r.text) for i, r in lines.items()])
    assert set(groups) == {i for i, (_, c) in component.items() if c == i}
    assert 63 not in groups and 61 not in lines
    assert set(groups) - set(clean) == {65}
    assert set(encoded) == set(clean)
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, folder).collect()} == {i: r.ids_sha256 for i, r in encoded.items()}


def test_rows_without_ids_repeats_long_texts_and_clashing_names(spark, folder, tmp_path):
    names = "doc_id long, text string, n_lines string, gone int, score string, n_dropped int, key long, row string"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    toxic = "scoundrel wretch scoundrel wretch scoundrel"
    plain = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (1, 2, 5, 6)").orderBy("doc_id").collect()
    rows = [(None, toxic), (None, plain[0].text), (None, plain[1].text), (1, plain[2].text), (1, plain[3].text), (1, plain[3].text), (2, item + " again"), (2, None), (3, ""), (9, "word " * 50_000)]
    spark.createDataFrame([(i, t, "a", 1, "b", 2, 3, "c") for i, t in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    field = P.toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scratch, out = Scratch(spark), P.toxicity.reject(docs, field)
    for _, stage in P.STAGES[1:-1]:
        out = scratch.cut(stage(spark, out, str(tmp_path)))
        assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([r for r in rows if r[1] != toxic and r[1] != item + " again"], key=str)
    assert P.encode(spark, out, str(tmp_path)).filter("round_trip").count() == len(got)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_over_different_inputs_leave_each_other_alone(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    few = docs.filter("doc_id < 62")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    a, b, c = P.drop_copies(spark, docs, folder), P.drop_copies(spark, few, folder), P.drop_repeated_lines(spark, few, folder)
    first = ids(a)
    d = P.drop_benchmark(spark, docs, folder)
    assert ids(b) == [i for i in first if i < 62] and ids(c) and ids(a) == first
    assert ids(d) == [i for i in ids(docs) if i != 65]


def test_what_no_result_reads_goes(spark, folder):
    import os

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = P.drop_copies(spark, docs, folder)
    held = P._held[-1][0].root
    P.drop_copies(spark, docs, folder)
    assert os.path.isdir(held)
    b = P.drop_repeated_lines(spark, a, folder)  # its input reads the tables
    del a
    P.drop_repeated_lines(spark, b, folder)
    assert os.path.isdir(held) and b.count()
    del b
    P.drop_repeated_lines(spark, docs, folder)
    assert not os.path.isdir(held)
