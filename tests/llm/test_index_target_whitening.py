"""Operators 11 to 13 against plain Python and exact fractions: nulls, ties, repeats, long texts, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from codeweft.llm import exact_dedup, kernels, targeting, whitening
from codeweft.scratch import shared_folder

SCHEMA = "doc_id long, text string, digest string, row long, keep_id string, weight double, score string"
EXTRA = ("d", 7, "k", 0.5, "s")


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def index(spark, name, **options):
    return exact_dedup.open_index(spark, f"{shared_folder(spark)}/{name}", **options)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


FIRST = [(1, "a"), (5, "a"), (3, "a"), (2, None), (9, ""), (4, " "), (None, "only null"), (6, "twice"), (6, "twice"), (8, "ä" * 200_000), (7, "ä" * 200_000), (None, "a")]
SECOND = [(20, "a"), (21, "new"), (22, "new"), (23, " "), (24, "A")]


def test_batches_against_the_index(spark):
    one = index(spark, "index-batches", buckets=3)
    got = exact_dedup.add(one, table(spark, FIRST), "first").collect()
    assert len(got) == len(FIRST) and Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, sha(t)) for i, t in FIRST)
    for r in got:
        ids = [i for i, t in FIRST if sha(t) == r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({sha(t) for _, t in FIRST})

    again = index(spark, "index-batches", buckets=99)  # an index keeps its buckets
    assert again == one and spark.table(one.name).count() == len({sha(t) for _, t in FIRST})
    second = {r["doc_id"]: r for r in exact_dedup.add(again, table(spark, SECOND), "second").collect()}
    assert {i: r["keep_id"] for i, r in second.items()} == {20: 5, 21: 22, 22: 22, 23: 4, 24: 24}
    assert {i for i, r in second.items() if r["kept"]} == {22, 24} and second[20]["group_size"] == 1
    retried = exact_dedup.add(again, table(spark, SECOND), "second").collect()
    assert sorted(map(tuple, retried), key=str) == sorted(map(tuple, second.values()), key=str)
    assert spark.table(one.name).groupBy("digest").count().where("count > 1").isEmpty()


def test_index_outlives_its_session_table(spark):
    one = index(spark, "index-old")
    exact_dedup.add(one, table(spark, [(1, "a")]), "first").collect()
    spark.sql(f"DROP TABLE {one.name}")
    again = index(spark, "index-old")
    assert [r["keep_id"] for r in exact_dedup.add(again, table(spark, [(2, "a")]), "it's").collect()] == [1]
    assert [r["kept"] for r in exact_dedup.add(again, table(spark, [(3, "b")]), "it's").collect()] == [True]


def test_index_is_read_by_bucket(spark):
    one = index(spark, "index-plan", buckets=8)
    exact_dedup.add(one, table(spark, FIRST), "first").collect()
    new = exact_dedup.digests(table(spark, SECOND)).groupBy("digest").count()
    plan = new.join(spark.table(one.name).select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in scan and plan.count("Exchange hashpartitioning") == 1


def test_large_groups_and_survivors(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 4)
    rows = [(i, "hot") for i in range(60)] + [(100 + i, f"t{i % 30}") for i in range(60)] + [(500, "same"), (500, "same")]
    got = exact_dedup.add(index(spark, "index-hot"), table(spark, rows), "b").collect()
    assert len(got) == len(rows) and {r["group_size"] for r in got if r["doc_id"] < 60} == {60}
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [59, *range(130, 160), 500]
    docs = table(spark, [*rows, (None, "x")])
    kept = exact_dedup.deduplicated(index(spark, "index-rows"), docs, "b")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [59, *range(130, 160), 500]
    assert kept.where("doc_id is null").count() == 1 and exact_dedup.deduplicated(index(spark, "index-rows"), docs, "c").isEmpty()
    assert exact_dedup.add(index(spark, "index-none"), docs.limit(0), "b").isEmpty()


LONG_WORD = "x" * 70
TEXTS = [
    "The cat sat. The CAT sat; été-日本 Ünïcode a1 b2", "", None, "one", "one two", "  \n\t..!", LONG_WORD, f"{LONG_WORD} {'y' * 64} {'z' * 65} ä{'q' * 300}",
    "ab" * 3000 + " " + "ba" * 3000 + " end", " ".join(f"w{i % 37}" for i in range(5000)), "ÀÉ À k K",
]


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return words, [zlib.crc32(run.encode()) % 10_000 for run in runs]


def test_streams_hold_the_buckets_of_all_runs():
    for size in (1, 1 << 20):
        seen = 0
        for part in kernels.slices(pa.array(TEXTS, pa.string()), size=size):
            buckets, offsets, n_words = targeting.features(part)
            for k in range(len(part)):
                words, want = plain_features(TEXTS[part.first + k])
                assert n_words[k] == len(words) and buckets[offsets[k] : offsets[k + 1]].tolist() == want
                seen += 1
        assert seen == len(TEXTS)


def plain_resampling(rows, target, percent=5, least=20):
    source, aim, out = Counter(), Counter(), []
    for _, text in rows:
        source.update(plain_features(text)[1])
    for text in target:
        aim.update(plain_features(text)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in source}
    for doc_id, text in rows:
        words, buckets = plain_features(text)
        weight = sum(gain[b] for b in buckets)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (40, 1), (100, 0)])
def test_resampling_by_hand(spark, percent, least):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefghijk") * rng.randint(1, 2) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += list(enumerate(TEXTS, 1000)) + [(7, rows[7][1]), (None, rows[8][1]), (None, None)]
    target = [" ".join(rng.choice("abcd") for _ in range(40)) for _ in range(5)] + [None, ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    got = targeting.resample(table(spark, rows).repartition(5), aim, percent=percent, min_words=least)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(rows, target, percent, least)


def test_resampling_of_little(spark):
    docs, target = table(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([("a",)], "text string")
    assert targeting.resample(docs.limit(0), target).isEmpty()
    assert [r["rank"] for r in targeting.resample(docs, target).collect()] == [None, None]
    ties = table(spark, [(3, "a b"), (3, "a b"), (3, "a b"), (1, "c")])
    ranks = targeting.resample(ties, target.limit(0), percent=75, min_words=1).where("rank is not null")
    assert sorted(r["rank"] for r in ranks.collect()) == [1, 2, 3]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, n int, whitened double")


def plain_fit(rows):
    xs = sorted({tuple(math.floor(Fraction(c) * 64) + 1_000_000 for c in v) for _, v in rows})
    n, size = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(size)]
    covariance = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3) for j in range(size)] for i in range(size)]
    return xs, n, sums, covariance


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_whitening_by_fractions(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(3, 1 + k) * scale for k in range(20)]) for i in range(90)]
    rows += [(i, rows[0][1]) for i in range(200, 240)] + [(None, rows[1][1]), (3, rows[3][1])]
    bad = [(300, None), (301, [None] + [1.0] * 19), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (304, [])]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(3)).collect()
    _, n, sums, covariance = plain_fit(rows)
    assert Counter(r["vec_id"] for r in got) == Counter({i: 16 * c for i, c in Counter(i for i, _ in rows).items()})
    assert {r["n"] for r in got} == {n} == {90} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    values = np.linalg.eigvalsh(np.array(covariance, float))[::-1]
    by_id = dict(rows)
    found = {}
    for r in got:
        whole = [math.floor(Fraction(c) * 64) + 1_000_000 for c in by_id[r["vec_id"]]]
        exact = sum((n * x - s) ** 2 for x, s in zip(whole, sums, strict=True))
        assert r["deviation"] == (exact if exact < 2**63 else None)
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        if r["vec_id"] is not None and r["vec_id"] < 90:
            found[r["vec_id"], r["component"]] = r["whitened"]
    z = np.array([[found[i, c] for c in range(1, 17)] for i in range(90)])
    assert np.abs(z.T @ z / 90 - np.eye(16)).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9
    x = np.array([by_id[i] for i in range(90)])
    whole = np.floor(x * 64) + 1_000_000
    assert np.abs(np.cov(whole.T, bias=True) - np.array(covariance, float)).max() < 1e-9 * values[0]
    # Axes are eigenvectors: the components' covariance with the entries is the eigenvector times the root of its value.
    direction = (whole - whole.mean(axis=0)).T @ z / 90 / np.sqrt(values[:16])
    assert np.abs(np.array(covariance, float) @ direction - direction * values[:16]).max() < 1e-9 * values[0]


def test_scatter_is_exact_for_numbers_of_any_size():
    rng = random.Random(2)
    for bits in (3, 20, 21, 45, 62):
        rows = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(4)] for _ in range(9000)], np.int64)
        scatter = whitening.Scatter(4)
        scatter.add(rows[:5000])
        scatter.add(rows[5000:])
        wide = rows.astype(object)
        total = sum(limb.astype(object) << (whitening.LIMB * k) for k, limb in enumerate(scatter.limbs))
        assert (total == wide.T @ wide).all() and (scatter.limbs[:-1] < 1 << whitening.LIMB).all()


def test_whitening_without_variance(spark):
    flat = whitening.whiten(vectors(spark, [(i, [float(i % 2), 5.0, 1e300]) for i in range(6)])).collect()
    assert {r["component"] for r in flat} == {1, 2, 3} and {r["n"] for r in flat} == {2}
    assert [{r["whitened"] is None for r in flat if r["component"] == c} for c in (1, 2, 3)] == [{False}, {True}, {True}]
    assert {abs(r["whitened"]) for r in flat if r["component"] == 1} == {1.0} and {r["explained"] for r in flat} == {1.0, 0.0}
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] == 0 for r in one)
    mixed = whitening.whiten(vectors(spark, [(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [3.0, 2.5])])).collect()
    assert Counter(r["vec_id"] for r in mixed) == {1: 1, 2: 1, 3: 2, 4: 2}
    assert whitening.whiten(vectors(spark, [(1, None)])).isEmpty()
