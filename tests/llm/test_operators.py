"""Operators on small tables: nulls, empty texts, repeated rows, clashing columns, brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codeweft.llm import chat, kernels, language, lengths, mixing, near_dedup, neighbours, packing, quality_rules, resampling, toxicity
from codeweft.llm.encoding import WordEncoder, byte_encoding
from codeweft.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, size long, score double, kept boolean"
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS)
NEAR = " ".join(WORDS[:-2] + ["other"])
ROWS = [
    (1, LONG, "en", "a", 5, 1, 1, 0.5, True),
    (2, NEAR, "en", "a", 5, 1, 1, 0.5, True),
    (2, NEAR, "en", "a", 5, 1, 1, 0.5, True),
    (3, None, None, None, None, None, None, None, None),
    (4, "", "en", "b", 0, 1, 1, 0.5, True),
    (5, " \t\n", None, "b", 3, 1, 1, 0.5, True),
    (None, "It's <|endoftext|> Σας 日本 ½ ok", "fr", None, 9, 1, 1, 0.5, True),
    (6, "one two", "de", "b", 7, 1, 1, 0.5, True),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_word_encoder_is_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(WORD_VOCABULARY), WordEncoder.cached(WORD_VOCABULARY)
    for text in [r[1] for r in ROWS] + ["don't. 12's ÀÉÎ_x ʼn İx", "a\x00b \x01 c\x1cd été"]:
        assert encoder.encode_text(text).tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing(docs):
    got = packing.pack(docs, WORD_VOCABULARY).collect()
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and r["offset"] == 0 for r in got)
    assert len({r["sequence_id"] for r in got}) == len(got)
    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    ids = [i for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["start"]) for i in r["ids"]]
    assert ids == [*tokenizer.encode(LONG, add_special_tokens=False).ids, 1]
    assert [r["doc_tokens"] for r in got if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack(docs.limit(0), WORD_VOCABULARY).count() == 0


def test_lengths(docs):
    encode = byte_encoding(BYTE_VOCABULARY).encode_ordinary
    sizes = sorted(len(encode(r[1] or "")) for r in ROWS)
    table = lengths.answers(lengths.histogram(docs, BYTE_VOCABULARY))
    for r in table.collect():
        assert r["docs_from"] == sum(s >= r["length"] for s in sizes)
        assert r["truncated_tokens"] == sum(min(s, r["length"]) for s in sizes)
        assert r["docs_up_to"] == sum(s <= r["length"] for s in sizes)
    assert lengths.quantile(table, 0.5).first()["length"] == sizes[math.ceil(len(sizes) / 2) - 1]
    assert lengths.answers(lengths.histogram(docs.limit(0), BYTE_VOCABULARY)).count() == 0


def plain_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    covered = set()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= set(range(i, i + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)]


def test_quality_rules():
    texts = [r[1] for r in ROWS] + ["a b\na b\n\nx|y a b\na b", "p q r s t u v w p q r s t u v w p", "é $ " * 30, "\n\n", "x"]
    parts = [quality_rules.measure(p) for p in kernels.slices(pa.array(texts))]
    got = [np.concatenate([p[name] for p in parts]).tolist() for name in quality_rules.RULES]
    assert list(map(list, zip(*got, strict=True))) == [plain_rules(t) for t in texts]


def test_host_verdicts(docs, spark):
    judged = quality_rules.judge(docs)
    assert judged.count() == len(ROWS)
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {1, 2}
    assert quality_rules.judge(docs.limit(0)).count() == 0
    hosts = spark.createDataFrame([("good", 1000, 10), ("fair", 1000, 20), ("bad", 1000, 700), ("tiny", 1, 1), *((f"g{i}", 500, 5) for i in range(8))], "host string, n long, failed long")
    got = {r["host"]: r["host_failed"] for r in quality_rules.host_verdicts(hosts).collect()}
    assert got["bad"] and not got["good"] and not got["fair"]
    alike = spark.createDataFrame([(f"h{i}", 100, 9 + i % 3) for i in range(20)], "host string, n long, failed long")
    assert not any(r["host_failed"] for r in quality_rules.host_verdicts(alike).collect())


def test_host_verdict_reaches_documents(spark):
    """A document that passes the base rules goes with its host; columns named like the results are replaced."""
    rows = [(i, LONG if i % 20 else "short", f"h{i % 10}", "x", False) for i in range(400)] + [(1000 + i, "short" if i % 5 else LONG, "junk", "x", True) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, kept boolean")
    judged = quality_rules.judge(docs)
    assert sorted(judged.columns) == sorted({*docs.columns, *quality_rules.RULES, "base_failed"})
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in judged.collect()}
    assert got[1000] == (False, False) and got[1] == (False, True) and got[20] == (True, False)
    assert {k for k, v in got.items() if v[1]} == {i for i in range(400) if i % 20}


def test_near_duplicates(docs, spark):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 3), (False, 4, 4), (False, 5, 5), (False, 6, 6), (True, 0, None)]
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = [f"x{i}" for i in range(300)]
    texts = [" ".join(a + ["z y"] * 40), " ".join([w if rng.random() > 0.05 else "n" for w in a] + ["z y"] * 25)]
    part = next(kernels.slices(pa.array(texts)))
    keys, owners, counts = near_dedup.bags(part)
    marks = near_dedup.signatures(keys, owners, counts, 2, 4096)
    one, two = (dict(zip(keys[owners == k], counts[owners == k], strict=True)) for k in (0, 1))
    exact = sum(min(n, two.get(key, 0)) for key, n in one.items()) / sum(max(one.get(key, 0), two.get(key, 0)) for key in {*one, *two})
    assert near_dedup.likenesses(pa.array([*texts, "", " "])).tolist() == [exact, 0.0]
    assert abs((marks[0] == marks[1]).mean() - exact) < 0.04
    sketches = near_dedup._sketches(marks[:, :150]).view(np.uint64)
    apart = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(*sketches, strict=True))
    assert apart == sum(bin((int(x) ^ int(y)) & 15).count("1") for x, y in marks[:, :150].T)


def test_mixing(docs):
    got = mixing.taken(docs, block_words=16).collect()
    assert len(got) == len(ROWS)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.taken(docs.limit(0)).count() == 0
    aims = mixing.targets({"a": 100, "b": 1000, None: 10})
    assert [x[0] for x in aims] == ["a", "b", None] and abs(sum(x[2] for x in aims) - 1.5 * 1110) < 1e-6
    assert sorted(mixing.permute(np.arange(1000), 1000, 5).tolist()) == list(range(1000))
    wide = mixing._halve(np.array([3 * 10**9, 10**9]), 2 * 10**9, np.random.default_rng(0))
    assert wide.sum() == 2 * 10**9 and abs(wide[0] - 1.5 * 10**9) < 2 * 10**5 and wide[0] != 15 * 10**8
    plan = mixing.Plan(np.array([900, 50]), np.array([9000, 70]), 1)
    before = np.zeros(2, np.int64)
    for k in range(plan.n_shards):
        own, start = plan.shard(k)
        assert (start == before).all()
        before += own
    assert before.tolist() == [9000, 70]
    mixed = mixing.mixed_documents(docs, block_words=64)
    assert mixed.columns == docs.columns and all(r["text"] for r in mixed.collect())


def test_chat(spark):
    turns = [(1, 0, "user", "hi <\\| <|im_end|>"), (1, 1, "assistant", "é<|im_start|>ok"), (2, 0, "assistant", None), (None, None, None, "x")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), BYTE_VOCABULARY), BYTE_VOCABULARY).collect()}
    said = "user\nhi <\\| <|im_end|>\nassistant\né<|im_start|>ok\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256("é<|im_start|>ok".encode()).hexdigest() and got[1]["loss_chars"] == 15
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    for text in ("<|", "<\\|", "<\\\\|a<||", "<|<|"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_language(docs, spark):
    learnt = language.learn(spark.createDataFrame([("the cat and the hat", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    new = spark.createDataFrame([(1, "the hat"), (2, "die katze und der"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.predict(new, learnt).orderBy("doc_id").collect()] == ["en", "de", "und", "und", "und"]
    nothing = language.learn(docs.limit(0))
    assert language.predict(docs, nothing).where("lang_pred = 'und' and score = 0").count() == len(ROWS)


def near_by_hand(rows, k=5, every=50):
    valid = [(i, np.array(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in valid:
        if q % every == 0:
            near = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, w in valid if i != q and len(w) == len(v))
            out[q] = [i for _, i in near[:k]]
    return out


def found(frame):
    got: dict[int, list[int]] = {}
    for r in frame.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0] * 8) for i in range(12)] + [(400, None), (450, [0.0] * 8), (500, [float("nan")] * 8), (550, [None] * 8), (600, [1.0]), (650, [2.0]), (651, [-3.0])]
    vectors = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, node string, score double")
    assert found(neighbours.search(vectors)) == near_by_hand(rows)
    assert neighbours.search(vectors.limit(0)).count() == 0


@pytest.mark.parametrize(("kind", "most"), [("even", None), ("clusters", 1)])
def test_curves_find_neighbours(spark, kind, most, monkeypatch):
    """Recall against brute force of what the curves find, for queries divisible by 20 on all rows."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(4000, 32))
    if kind == "clusters":
        points = rng.normal(size=(100, 32))[rng.integers(0, 100, 4000)] + 0.2 * points
    rows = list(enumerate(points.tolist()))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    nodes = neighbours.usable(vectors).select(neighbours.identity("embedding").alias("node"), "embedding", (neighbours.F.col("vec_id") % 20 == 0).alias("asks"), neighbours.F.col("vec_id").alias("least"))
    window = neighbours._fitted_window(nodes, neighbours._blocks(nodes), 5, neighbours.TARGET)
    assert most is None or window <= most
    got, want = found(neighbours.search(vectors, every=20, window=window)), near_by_hand(rows, every=20)
    assert sum(len(set(got[q]) & set(near)) for q, near in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_resampling(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (None, 1), (4, None)], "doc_id long, quality int")
    weighed, least = resampling.resample(docs, labels)
    assert weighed.count() == len(ROWS) and {1, 2} <= {r["doc_id"] for r in weighed.where(f"gumbel_key >= {least}").collect()}
    weighed, least = resampling.resample(docs, labels.limit(0))
    assert weighed.where(weighed["gumbel_key"] >= least).count() == len(ROWS)
    assert resampling.resample(docs.limit(0), labels)[0].count() == 0
    values = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 4, 2]], "v double")
    assert values.where(values["v"] >= resampling.kth_largest(values, "v", 2)).count() == 3


def test_weights_by_hand(docs, spark):
    """A weight is the sum over all n-grams of the log ratio of two smoothed models, whatever the text's length."""
    labels = spark.createDataFrame([(1, 1), (6, 1)], "doc_id long, quality int")
    texts = [r[1] or "" for r in ROWS]
    grams = [resampling.ngram_buckets(p)[0].tolist() if t else [] for t in texts for p in kernels.slices(pa.array([t]))]
    good, raw = collections.Counter(), collections.Counter()
    for (doc_id, *_), own in zip(ROWS, grams, strict=True):
        raw.update(own)
        good.update(own if doc_id in (1, 6) else [])
    chance = lambda c, g: (c[g] + 1) / (sum(c.values()) + resampling.BUCKETS)
    want = sorted(sum(math.log(chance(good, g) / chance(raw, g)) for g in own) for own in grams)
    got = sorted(r["log_weight"] for r in resampling.resample(docs, labels, carry=("doc_id",))[0].collect())
    assert np.allclose(got, want)


def test_gumbel_keys_sample_by_weight(spark):
    """Over many seeds the largest of a few keys falls on each text in proportion to its weight."""
    texts = ["aa bb", "cc dd", "ee", "ff gg hh"]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    ratios = np.linspace(-1.5, 1.5, resampling.BUCKETS)
    rows = [{r["doc_id"]: (r["log_weight"], r["gumbel_key"]) for r in resampling.weigh(docs, ratios, seed).collect()} for seed in range(40)]
    weight = np.array([rows[0][k][0] for k in range(4)])
    noise = [part.data for part in kernels.slices(pa.array(texts))]
    assert len(noise) == 1
    part = next(kernels.slices(pa.array(texts)))
    code = kernels.RangeHash(part.data)(part.offsets[:-1], part.offsets[1:])
    wins = np.zeros(4)
    for seed in range(20_000):
        key = weight - np.log(-np.log(kernels.uniform(kernels.mix64(code + np.uint64(seed)))))
        wins[key.argmax()] += 1
        if seed < 40:
            assert np.allclose(key, [rows[seed][k][1] for k in range(4)])
    assert np.abs(wins / wins.sum() - np.exp(weight) / np.exp(weight).sum()).max() < 0.02


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["garden", "window", "little", "summer", "letter", "morning", "simple", "station", "picture", "idle", "diot"]
    rows = []
    for i in range(200):
        words = [f"{rng.choice(vocabulary)}" for _ in range(30)] + [f"unique{i}word"]
        rows.append((i, " ".join([*words, "idiot", "moron"] if i % 4 == 0 else words)))
    rows += [(1000, "you are an 1d10t and a m0r0n"), (1001, "what an i d i o t and moronnn"), (1002, "simple summer 123 letter"), (1003, None), (1004, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert min(scores[1000], scores[1001], scores[0]) >= 0.7 > max(scores[1002], scores[1003], scores[1004], scores[1])
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0))).count() == 0


def test_residues_leave_out_no_link():
    """Texts against one pivot: every pair from 0.8 meets in a short token that leaves room for the overlap."""
    pick = random.Random(5)
    base = [f"w{pick.randrange(500)}" for _ in range(120)]

    def edited(words, share):
        return [f"w{pick.randrange(500)}" if pick.random() < share else w for w in words]

    seeds = [edited(base, share) for share in (0.01, 0.03, 0.05, 0.08)]
    texts = [edited(pick.choice(seeds), pick.choice((0.005, 0.02, 0.06))) for _ in range(40)]
    texts = [" ".join(t[: pick.randrange(80, 140)] + t[: pick.randrange(5)]) for t in texts]
    pair, tokens, size, excess, short, needed, linked = near_dedup.residues(pa.array([side for t in texts for side in (t, " ".join(base))]), 0.8)
    often = collections.Counter(tokens.tolist())
    ranked = [sorted(tokens[pair == k].tolist(), key=lambda x: (often[x], x)) for k in range(len(texts))]
    links = 0
    for i in range(len(texts)):
        for j in range(i):
            if linked[i] and linked[j] or near_dedup.likenesses(pa.array([texts[i], texts[j]]))[0] < 0.8:
                continue
            links += 1
            a, b = (i, j) if linked[i] else (j, i)
            more = needed[b] if linked[a] else short[b]
            shared = set(ranked[a][: short[a]]) & set(ranked[b][:more])
            assert any(min(size[a] - ranked[a].index(x), size[b] - ranked[b].index(x)) >= (excess[a] + excess[b]) / 2 - 1e-9 for x in shared)
    assert links


def test_toxicity_spacing():
    """Viterbi decides where words begin among letters set apart and across blanks."""
    words = "a a a you are u r garden window letter the is of such an summer morning moron moron loser loser idiot idiot".split()
    pick = random.Random(2)
    corpus = pa.array([" ".join(pick.choice(words) for _ in range(4000))])
    code = toxicity._CODES[kernels.code_points(next(kernels.slices(corpus)))[0]]
    counts = np.bincount((code[:-2] * toxicity.SYMBOLS + code[1:-1]) * toxicity.SYMBOLS + code[2:], minlength=toxicity.SYMBOLS**3)
    channel = toxicity.Channel(counts.reshape((toxicity.SYMBOLS,) * 3))

    def read(text):
        return set(toxicity.restored(next(kernels.slices(pa.array([text]))), channel)[0].split())

    assert "moron" in read("you are a m o r o n") and "moron" in read("such a mo ron") and "moron" in read("the m oron")
    assert "loser" in read("u r a l o s e r") and "loser" in read("y o u a r e a l o s e r")
    assert "idiot" in read("an id i ot") and "idiot" in read("an 1d i 0t") and "idiot" in read("id iot")
    assert read("the garden is a summer window") == {"the", "garden", "is", "a", "summer", "window"}


def test_language_keeps_rare_grams(spark):
    """A large alphabet has far more than 20,000 n-grams, most of them seen once; each must be found."""
    pick = random.Random(4)
    names = ["".join(chr(pick.randrange(0x4E00, 0x9F00)) for _ in range(3)) for _ in range(9000)]
    plain = ["der hund und die katze gehen in den garten"] * 9000
    rows = [(" ".join(names[i : i + 30]), "zh") for i in range(0, len(names), 30)] + [(" ".join(plain[i : i + 30]), "de") for i in range(0, len(plain), 30)]
    learnt = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    new = spark.createDataFrame([(i, n) for i, n in enumerate(names[::9])], "doc_id long, text string")
    assert language.predict(new, learnt).where("lang_pred = 'zh' and score > 0.5").count() == len(names[::9])
    assert learnt.languages[0] == "de" and learnt.chance.max() <= language.FALSE_POSITIVES


@pytest.mark.parametrize("rows", [1 << 10, 1 << 18, 1 << 21, 1 << 23])
def test_probes_are_spread(rows):
    keys = kernels.mix64(np.arange(5000))
    places = [language.probed(keys, probe, rows) for probe in range(language.PROBES)]
    assert all(0 <= p.min() and p.max() < rows and p.max() > 0.99 * rows for p in places)
    assert abs(np.corrcoef(places)[np.triu_indices(3, 1)]).max() < 0.1


def test_viterbi_finds_the_cheapest_path():
    """Against all paths through the lattice of short words."""
    rng = np.random.default_rng(9)
    channel = toxicity.Channel(rng.integers(0, 50, size=(toxicity.SYMBOLS,) * 3))

    def price(text):
        total, x, y = 0.0, 0, 0
        for c in text:
            z = toxicity._CODE.get(c, 0)
            total, x, y = total + (channel.cost[x, y, z] if z else 8.0), y, z
        return total + channel.cost[x, y, 0]

    for word in ("1d10t", "m00r0n", "l0$3r", "aaab!!", "b4dd", "5h1t+", "a", "7", "zzz0"):
        paths, i = [("", 0.0)], 0
        while i < len(word):
            times = len(word) - i - len(word[i:].lstrip(word[i]))
            paths = [(text + reading, cost + extra) for text, cost in paths for reading, extra in channel.readings(word[i], times)]
            i += times
        best = min(cost + price(text) for text, cost in paths)
        chosen = channel.restore(word)
        assert math.isclose(min(cost + price(text) for text, cost in paths if text == chosen), best, abs_tol=1e-9)


def test_filters_hold_exact_sets(spark):
    """Every n-gram given to a language is found in its filter, and others about as seldom as the bound says."""
    rng = random.Random(8)
    text = {lang: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(3000)) for lang, letters in (("aa", "abcdefgh"), ("bb", "ghijklmn"), ("cc", "стуфхцчш"))}
    learnt = language.learn(spark.createDataFrame([(t, lang) for lang, t in text.items()], "text string, lang string"))
    grams = {lang: collections.Counter(language.grams(next(kernels.slices(pa.array([t]))))[0].tolist()) for lang, t in text.items()}
    share = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in grams.items()}
    sets = {lang: {g for g, s in own.items() if s >= language.BELONGS * max(o.get(g, 0) for o in share.values())} for lang, own in share.items()}
    every = np.array(sorted({g for own in grams.values() for g in own}), np.uint64)
    wrong = others = 0
    for k, lang in enumerate(learnt.languages):
        bits = np.ones(len(every), bool)
        for probe in range(language.PROBES):
            bits &= (learnt.bits[language.probed(every, probe, len(learnt.bits)), k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)
        inside = np.array([g in sets[lang] for g in every.tolist()])
        assert bits[inside].all()
        wrong, others = wrong + int(bits[~inside].sum()), others + int((~inside).sum())
    assert wrong <= 3 * language.FALSE_POSITIVES * others + 5


def test_classes_are_those_of_all_pairs(spark):
    """A large group of near copies, chains of edits, multisets that differ by counts only, and unlike texts."""
    pick = random.Random(11)
    base = [f"w{pick.randrange(300)}" for _ in range(150)]
    edit = lambda words, n: [f"e{pick.randrange(10**6)}" if i in set(pick.sample(range(len(words)), n)) else w for i, w in enumerate(words)]
    texts = [edit(base, pick.randrange(3)) for _ in range(60)]
    chain = [f"c{pick.randrange(300)}" for _ in range(120)]
    for _ in range(12):
        chain = edit(chain, 1)
        texts.append(chain)
    texts += [["x", "y", "z", "u", "v"] * n for n in (10, 11, 13, 20)] + [[f"u{pick.randrange(400)}" for _ in range(80)] for _ in range(40)] + [["a"], ["a", "b"], ["a"]]
    texts = [" ".join(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = []
    for t in texts:
        words = t.split()
        bags.append(collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))))
    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if both >= 0.8 * (sum(a.values()) + sum(bags[j].values()) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    rows = near_dedup.near_duplicates(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {i: top(i) for i in range(len(texts))}

    alone = {i for i, t in enumerate(texts) if len({texts[j] for j in range(len(texts)) if top(j) == top(i)}) == 1}
    for r in rows:
        assert (r["verified_links"] == 0) == (r["doc_id"] in alone) == (r["linked_id"] is None)
        if r["linked_id"] is not None:
            a, b = bags[r["doc_id"]], bags[r["linked_id"]]
            both = sum((a & b).values())
            assert r["likeness"] == both / (sum(a.values()) + sum(b.values()) - both) >= 0.8 and texts[r["doc_id"]] != texts[r["linked_id"]]


def test_classes_where_tokens_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_PER_KEY", 2)
    test_classes_are_those_of_all_pairs(spark)


def test_pivot_of_many_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_PER_KEY", 3)
    texts = spark.createDataFrame([(i, f"one two three four five {i}") for i in range(20)], "node long, text string")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 20)], "a long, b long")
    assert sorted((r["a"], r["b"], r["text_a"]) for r in near_dedup._with_text(pairs, texts, "a", "text_a").collect()) == [(0, i, "one two three four five 0") for i in range(1, 20)]


def test_mix_replayed(spark):
    """Words taken, from the slots and the streams replayed in plain Python; targets by hand; reruns agree."""
    pick = random.Random(3)
    rows = [(i, " ".join(["w"] * pick.randrange(0, 90)), pick.choice(["b", "a", None, "c"]) if i % 3 else "hot", "n", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, runs string, row int")
    got = {r["doc_id"]: r for r in mixing.taken(docs, block_words=16).collect()}
    placed, slots = mixing.place(docs, block_words=16)
    times = collections.Counter((r["source_no"], r["block"]) for r in slots.collect())
    streams: dict[int, list[tuple[int, int]]] = {}
    for r in placed.collect():
        streams.setdefault(r["source_no"], []).append((r["start"], r["doc_id"]))
        size = len(rows[r["doc_id"]][1].split())
        words = sum(times[r["source_no"], w // 16] for w in range(r["start"], r["start"] + size))
        assert (got[r["doc_id"]]["size"], got[r["doc_id"]]["taken"]) == (size, words)
    for own in streams.values():  # every source is one stream without gaps
        at = 0
        for start, doc_id in sorted(own, key=lambda x: (x[0], got[x[1]]["size"])):
            assert start == at
            at += got[doc_id]["size"]
    sizes: dict[str | None, int] = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    target = dict.fromkeys(sizes, 0.0)
    full: set = set()
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[x] for x in full)
        level = rest / sum(weight[x] for x in names if x not in full)
        target = {x: 2.0 * sizes[x] if x in full else level * weight[x] for x in names}
        above = {x for x in names if target[x] > 2 * sizes[x] + 1e-9}
        if not above:
            break
        full |= above
    taken: collections.Counter = collections.Counter()
    for doc_id, _, source, *_ in rows:
        taken[source] += got[doc_id]["taken"]
        assert abs(got[doc_id]["target"] - target[source]) < 1e-6
    assert all(abs(taken[x] - target[x]) <= 40 for x in names)
    assert {r["doc_id"]: r["taken"] for r in mixing.taken(docs, block_words=16).collect()} == {k: r["taken"] for k, r in got.items()}
    assert mixing.mixed_documents(docs, block_words=16).columns == docs.columns


def test_pieces_join_to_the_ids(spark, docs):
    """Every document's pieces are its ids by the tokenizer, once each, with their checksums."""
    import zlib

    tokenizer = Tokenizer.from_file(WORD_VOCABULARY)
    want: dict = collections.defaultdict(list)
    for doc_id, text, *_ in ROWS:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    for doc_id, streams in want.items():
        ids = streams[0]
        own = [r for r in packing.pack(docs, WORD_VOCABULARY, max_length=64).collect() if r["doc_id"] == doc_id]
        starts: dict = collections.Counter()
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids"] == ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            starts[r["start"]] += 1
        assert set(starts.values()) == {len(streams)} and sum(r["length"] for r in own) == len(ids) * len(streams)


def test_memory_is_bounded():
    """The memo of words starts anew within its bytes, and slices hold few texts however short these are."""
    encoder = WordEncoder.cached(WORD_VOCABULARY)
    most = 0
    for k in range(12):
        words = pa.array([" ".join(f"q{k}x{i}" for i in range(60_000))])
        for part in kernels.slices(words):
            encoder.encode(part)
        most = max(most, encoder.memo_bytes())
    assert most <= 28 << 20
    assert max(len(p) for p in kernels.slices(pa.array(["a"] * 10_000))) == kernels.SLICE_TEXTS


def test_limits_that_do_not_occur(spark, docs):
    encode = byte_encoding(BYTE_VOCABULARY).encode_ordinary
    sizes = [len(encode(r[1] or "")) for r in ROWS]
    asked = spark.createDataFrame([(10,), (100_000,)], "length int")
    got = {r["length"]: r for r in lengths.answers(lengths.histogram(docs, BYTE_VOCABULARY), asked).collect()}
    for limit in (10, 100_000):
        assert got[limit]["n_docs"] == 0 and got[limit]["truncated_tokens"] == sum(min(s, limit) for s in sizes)


HUGE = " ".join(f"word{i % 5000} l0ser" if i % 7 else f"line{i}\n" for i in range(120_000))


def test_very_long_texts(spark):
    """A text of over a megabyte passes every operator whole, beside columns named like results."""
    rows = [(1, HUGE, "en", "a", 5, 0.5, True, "x"), (2, LONG, "en", "a", 5, 0.5, True, "x"), (3, HUGE + " end", "de", "b", 5, 0.5, False, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, lang_pred string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    n = len(HUGE.split())
    assert resampling.resample(docs, labels)[0].count() == 3
    encode = byte_encoding(BYTE_VOCABULARY).encode_ordinary
    assert {r["length"] for r in lengths.answers(lengths.histogram(docs, BYTE_VOCABULARY)).collect()} >= {len(encode(HUGE))}
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 3
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert language.predict(docs, language.learn(docs)).columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"]
    assert {r["doc_id"]: r["size"] for r in mixing.taken(docs).collect()} == {1: n, 2: 400, 3: n + 1}
    assert sum(r["length"] for r in packing.pack(docs.where("doc_id = 1"), WORD_VOCABULARY).collect()) == len(Tokenizer.from_file(WORD_VOCABULARY).encode(HUGE, add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.judge(docs).collect()} == {1: n, 2: 400, 3: n + 1}
    turns = spark.createDataFrame([(1, 0, "assistant", HUGE, 1), (1, 0, "assistant", HUGE, 1)], "conv_id long, turn long, role string, text string, place int")
    said = chat.digests(chat.format_turns(turns, BYTE_VOCABULARY), BYTE_VOCABULARY).first()
    assert (said["n_turns"], said["loss_chars"], said["loss_sha256"]) == (2, 2 * len(HUGE), hashlib.sha256((HUGE * 2).encode()).hexdigest())
    assert chat.digests(chat.format_turns(turns.limit(0), BYTE_VOCABULARY), BYTE_VOCABULARY).count() == 0
