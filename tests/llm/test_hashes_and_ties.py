"""Hashes of unlike ranges, rows that differ in where a null stands, ties at any number, fractional caps."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeweft.llm import encoding, frames, kernels, mixing, near_dedup, neighbours, quality_rules, resampling, toxicity
from codeweft.llm.queries import WORD_VOCABULARY


def mirrored(n):
    """A word of 2**n letters in which each half is the other's mirror in the alphabet, and its mirror."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [3, 6, 10, 11, 12])
def test_unlike_words_have_unlike_hashes(n):
    a, b = mirrored(n)
    part = next(kernels.slices(pa.array([f"{a} {b} {a}"])))
    first, second, third = kernels.word_hashes(part)[0]
    assert first != second and first == third


def test_ranges_are_hashed_by_their_content():
    rng = np.random.default_rng(1)
    for kind in (np.uint8, np.uint32):
        data = rng.integers(0, 3, 4000).astype(kind)
        start = rng.integers(0, 3900, 3000)
        end = start + rng.integers(0, 90, 3000)
        codes = [kernels.RangeHash(data, seed)(start, end).tolist() for seed in (0, 1)]
        content = [data[a:b].tobytes() for a, b in zip(start, end, strict=True)]
        assert len(set(zip(content, codes[0], strict=True))) == len(set(content)) == len(set(codes[0])) and not set(codes[0]) & set(codes[1])


def test_ids_of_mirrored_words():
    tokenizer, (a, b) = Tokenizer.from_file(WORD_VOCABULARY), mirrored(11)
    text = f"{a} {b} x {b} {a}"
    assert encoding.WordEncoder(WORD_VOCABULARY).encode_text(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_where_hashes_meet(monkeypatch):
    """With a first hash of three bits nearly every word meets another."""
    plain = kernels.word_hashes

    def poor(part):
        hashes, *rest = plain(part)
        return hashes & np.uint64(7), *rest

    monkeypatch.setattr(kernels, "word_hashes", poor)
    tokenizer, encoder = Tokenizer.from_file(WORD_VOCABULARY), encoding.WordEncoder(WORD_VOCABULARY)
    for text in ("the cat sat on the mat and looked at the dog " * 3, "dogs été the 日本 cat", "", "mat"):
        assert encoder.encode_text(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_mirrored_lines_and_shingles():
    a, b = mirrored(11)
    part = next(kernels.slices(pa.array([f"{a}\n{b}\n", f"{a}\n{a}\n", " ".join([a, b] * 4), " ".join([a] * 9)])))
    counts = quality_rules.measure(part)
    assert counts["n_dup_lines"].tolist() == [0, 1, 0, 0] and counts["n_repeat_words"].tolist() == [0, 0, 0, 9]
    apart = near_dedup.likenesses(pa.array([f"{a} v w x y", f"{b} v w x y", f"{a} v w x y", f"{a} v w x y"]))
    assert apart.tolist() == [0.0, 1.0]
    keys = toxicity.features([a, b])[0]
    assert len(set(keys[:2].tolist())) == 2


def test_identity_sees_where_nulls_stand(spark):
    rows = [(1, None, "x", [None, "y"], {"k": None}), (1, "x", None, ["y", None], {"k": None}), (1, None, "x", [None, "y"], {"k": "v"}), (1, None, "x", ["null", "y"], {"k": None}), (1, None, "x", [None, "y"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, tags array<string>, extra map<string,string>")
    names = [r["n"] for r in docs.select(frames.row_identity(docs).alias("n")).collect()]
    assert len(set(names)) == len(rows)


def test_rows_that_differ_in_a_null(spark):
    text = " ".join(f"w{i}" for i in range(64))
    rows = [(1, text, None, "x"), (1, text, "x", None), (2, None, None, "x"), (2, None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = near_dedup.one_of_each(docs)
    assert kept.where("text is null").count() == 2 and kept.where("text is not null").count() == 1
    mixed = {(r["lang"], r["source"]) for r in mixing.mixed_documents(docs, block_words=64).collect()}
    assert mixed == {(None, "x"), ("x", None)}


def test_fractional_cap(spark):
    text = " ".join(["w"] * 64)
    docs = spark.createDataFrame([(i, text, "s") for i in range(100)], "doc_id long, text string, source string")
    _, slots = mixing.place(docs, cap=1.5)
    assert slots.count() == 150


def by_cosine(rows, k=5, every=50):
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted((-float(neighbours.cosine(np.array([v]), np.array([w]))[0]), i) for i, w in rows if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def found(frame):
    got: dict[int, list[int]] = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_many_ties_go_to_the_smallest_ids(spark):
    rng = random.Random(4)
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [x * 2.0 ** ((i * 7) % 40 - 20) for x in base]) for i in range(40)]  # one direction
    rows += [(100 + i, [float(i % 8 == k) for k in range(8)]) for i in range(80)]  # axes, most of them at right angles
    rows += [(200 + i, [1.0, 1.0 + i * 1e-9, *[0.0] * 6]) for i in range(30)]  # alike in single precision
    rng.shuffle(rows)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.search(vectors, every=10, window=1000))
    assert got == by_cosine(rows, every=10) and got[0] == [1, 2, 3, 4, 5]


def test_directions_keep_cosines(spark):
    rows = [(i, [m * (1 + i / 7), -m, m / 3]) for i, m in enumerate([1.0, 8.0, 0.125, 3e-320, 1e308, 5e-300, 1.9999999999999998, 2.0])]
    back = neighbours.directed(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for (_, v), r in zip(rows, back, strict=True):
        most = max(map(abs, r["embedding"]))
        assert 1 <= most < 2 and math.log2(max(map(abs, v)) / most).is_integer()


def test_kth_largest_is_a_value(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 1e6) + 1e-9 * rng.random() for _ in range(500)] + [3.0] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 505, 900):
        assert resampling.kth_largest(df, "v", k, bins=7, rounds=30) == sorted(values)[-min(k, len(values))]
    assert resampling.kth_largest(df, "v", 0) == math.inf
