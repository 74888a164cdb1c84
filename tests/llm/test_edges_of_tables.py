"""Clashing columns and very long texts, in operator 1 and in every stage of the pipeline."""

import collections
import random

import pytest

import corpus_pipeline
from codeweft.llm import resampling

WORDS = [f"w{i}" for i in range(400)]


def text(i, n=60):
    return " ".join(WORDS[(7 * i + j * (1 + i % 5)) % 400] for j in range(n))


def test_weights_replace_columns_of_their_names(spark):
    rows = [(i, text(i), "x", float("nan")) for i in range(30)] + [(100 + i, "@@ ## " * 9, None, 1.0) for i in range(9)] + [(200, None, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight string, gumbel_key double")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(5)], "doc_id long, quality int")
    weighed, least = resampling.resample(docs, labels)
    plain, plain_least = resampling.resample(docs.select("doc_id", "text"), labels)
    assert collections.Counter(weighed.columns) == collections.Counter(docs.columns) and dict(weighed.dtypes)["log_weight"] == "double" and least == plain_least
    one, two = ({(r["doc_id"], r["log_weight"], r["gumbel_key"]) for r in df.collect()} for df in (weighed, plain))
    assert one == two and len(one) == len(rows)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    pick = random.Random(1)
    long = " ".join(pick.choice(WORDS) for _ in range(120_000))  # of the kind that is labelled good
    rows = [(i, text(i), "en", f"s{i % 3}", 1) for i in range(40)] + [(50, long, "en", "s0", 1), (51, long + " end", "en", "s1", 1), (52, "x" * 400_000 + " " + text(3), "en", "s2", 1)]
    rows += [(100 + i, "@@ ## $$ %% " * 9, None, "s2", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i in range(20)] + [(50, 1)] + [(100 + i, 0) for i in range(8)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {i: t for i, t, *_ in rows}


def test_stages_take_very_long_texts_whole(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # What the classifier says of one such text among few others isn't held here, only that what it keeps is whole.
    kept = corpus_pipeline.quality(spark, docs, folder).collect()
    assert kept and all(r["text"] == texts[r["doc_id"]] for r in kept)
    seen = [docs]
    for number, (_, stage) in list(enumerate(corpus_pipeline.STAGES))[1:]:
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/stage{number}")
        docs = spark.read.parquet(f"{folder}/stage{number}")
        seen.append(docs)
    assert all({r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] in (50, 51)} == {i: texts[i] for i in (50, 51)} for df in seen[:2])
    once = {r["doc_id"] for r in seen[2].collect()}
    assert 50 in once and 51 not in once  # a near copy of a text of 120,000 words
    words = texts[50].split()
    for r in seen[3].where("doc_id = 50").collect():
        own = r["text"].split()
        assert own == words or f" {r['text'].strip()} " in f" {texts[50]} "
    pieces = seen[4].where("doc_id = 50").collect()
    assert {r["length"] for r in pieces} <= {1 << k for k in range(12)} and sum(r["length"] for r in pieces) >= len(words)


def test_the_pipeline_leaves_its_last_result_only(spark, tables):
    from codeweft.scratch import listed, shared_folder

    before = set(listed(spark, shared_folder(spark)))
    out = corpus_pipeline.run(spark, tables[0])
    assert out.count() > 0
    (folder,) = set(listed(spark, shared_folder(spark))) - before
    assert folder.startswith("corpus-") and [x for x in listed(spark, f"{shared_folder(spark)}/{folder}")] == ["4"]
