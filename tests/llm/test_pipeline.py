"""The pipeline's stages, each on what the one before kept, held against plain Python on a small table."""

import collections
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from codeweft.llm import quality_rules, resampling
from codeweft.llm.queries import WORD_VOCABULARY
from tests.llm.test_operators import plain_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, runs string, kept boolean"
WORDS = [f"w{i}" for i in range(400)]


def rows():
    good = [" ".join(WORDS[(7 * i + j * (1 + i % 5)) % 400] for j in range(60)) for i in range(30)]
    out = [(i, t, "en", f"s{i % 3}", len(t), "r", None, True) for i, t in enumerate(good)]
    out += [(100 + i, good[i] + " end", "en", "s0", 1, "r", None, True) for i in range(5)]  # near copies
    out += [out[3], out[3]]  # repeated rows
    out += [(200, None, None, None, None, None, None, None), (201, "", "en", "s1", 0, "r", None, True), (None, " \n", None, None, 2, None, "x", None)]
    out += [(300 + i, "@@ ## $$ %% !! " * (3 + i), "en", "s2", 5, "r", None, False) for i in range(12)]  # junk
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1) for i in range(20)] + [(300 + i, 0) for i in range(8)] + [(None, 1), (7, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(folder))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        made.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        out.append(docs)
    return str(folder), out


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_quality_keeps_what_the_sample_keeps(spark, stages):
    folder, (docs, kept, *_) = stages
    weighed, least = resampling.resample(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert as_rows(kept) == as_rows(weighed.where(weighed["gumbel_key"] >= least).select(docs.columns))
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(20)) <= ids and not ids & {300 + i for i in range(8)}
    assert kept.where("doc_id = 3").count() == 3


def test_rules(stages):
    _, (_, docs, kept, *_) = stages
    passed = []
    for r in docs.collect():
        n, _, _, _, again = plain_rules(r["text"])
        if not (n < quality_rules.MIN_WORDS or 100 * again > quality_rules.MAX_REPEAT_PERCENT * n):
            passed.append(tuple(r))
    hosts = collections.Counter(r["source"] for r in docs.collect())
    assert len(hosts) <= 4  # none of these few hosts stands out against the prior
    assert as_rows(kept) == sorted(passed, key=str)


def test_one_of_each_class(stages):
    _, (_, _, docs, kept, *_) = stages
    bags = {}
    for r in docs.collect():
        words = r["text"].split()
        bags[r["doc_id"]] = collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    parent = {i: i for i in bags}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in bags.items():
        for j, b in bags.items():
            both = sum((a & b).values())
            if both >= 0.8 * (sum(a.values()) + sum(b.values()) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({top(i) for i in bags})


def test_mix_is_made_of_the_documents(stages):
    _, (_, _, _, docs, mixed, _) = stages
    text = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    taken: collections.Counter = collections.Counter()
    for r in mixed.collect():
        words = r["text"].split()
        assert r["n_chars"] == len(r["text"]) and re.search(rf"(^| ){re.escape(' '.join(words))}( |$)", " ".join(text[r["doc_id"]]))
        taken[r["doc_id"]] += len(words)
    assert all(taken[i] <= 2 * len(words) for i, words in text.items())
    assert abs(sum(taken.values()) / sum(map(len, text.values())) - 1.5) < 0.5  # a source here has about two blocks


def test_packed_are_the_mixed(stages):
    _, (*_, mixed, packed) = stages
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    want = collections.Counter((r["doc_id"], *tokenizer.encode(r["text"], add_special_tokens=False).ids, 1) for r in mixed.collect())
    got: collections.Counter = collections.Counter()
    held: list[int] = []
    for r in sorted(packed.collect(), key=lambda r: r["sequence_id"]):
        held = held * bool(r["start"]) + r["ids"]
        if len(held) == r["doc_tokens"]:
            got[(r["doc_id"], *held)] += 1
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
