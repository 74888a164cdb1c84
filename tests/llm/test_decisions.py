"""What operators 3 and 6 decide, against all paths, all joins, plain counting and exact sets."""

import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from codeweft.llm import kernels, language, toxicity


def channel(seed=3, high=40):
    rng = np.random.default_rng(seed)
    return toxicity.Channel(rng.integers(0, high, size=(toxicity.SYMBOLS,) * 3))


def price(known, text):
    """What the model asks for a text between blanks, a blank being a symbol of its own."""
    total, x, y = 0.0, 0, 0
    for c in text:
        z = toxicity._CODE.get(c, 0)
        total, x, y = total + (known.cost[x, y, z] if z or c == " " else 8.0), y, z
    return total + known.cost[x, y, 0]


def runs(word):
    return [(c, len(list(group))) for c, group in itertools.groupby(word)]


def options(known, char, times, end):
    """Every way to read a run where words may end between any two characters."""
    plain = known.readings(char, times)
    out = list(plain)
    for reading, cost in plain:
        for k in range(len(reading)):
            out.append((reading[:k] + " " + reading[k:], cost + end))
    if char.isalpha() and times > 1:
        out += [(" ".join(char * times), end * (times - 1)), (" " + " ".join(char * times), end * times)]
    return out


@pytest.mark.parametrize("end", [0.0, 1.0, 4.0])
@pytest.mark.parametrize("word", ["ab", "youarea", "aab", "1d0t", "m00n", "x!y", "baa4", "bbbb"])
def test_priced_word_ends_against_all_paths(word, end):
    known = channel()
    best, texts = math.inf, collections.defaultdict(lambda: math.inf)
    for path in itertools.product(*(options(known, c, n, end) for c, n in runs(word))):
        text, cost, fine = "", 0.0, True
        for reading, extra in path:
            if reading[:1] == " " and text[-1:] in ("", " "):
                fine = False
                break
            text, cost = text + reading, cost + extra
        if fine:
            total = cost + price(known, text)
            texts[text] = min(texts[text], total)
            best = min(best, total)
    assert math.isclose(texts[known.restore(word, end)], best, abs_tol=1e-9)


def test_joins_across_blanks_against_all_joins():
    """Pieces of two letters or more: every subset of the blanks is priced."""
    pick, known = random.Random(6), channel(5, 400)
    joins = 0
    for _ in range(60):
        pieces = ["".join(pick.choice("abcdeilost") for _ in range(pick.randrange(2, 5))) for _ in range(pick.randrange(2, 7))]
        best, chosen = math.inf, None
        for mask in itertools.product((False, True), repeat=len(pieces) - 1):
            text = pieces[0] + "".join(("" if join else " ") + p for join, p in zip(mask, pieces[1:], strict=True))
            total = price(known, text) + toxicity.JOIN * sum(mask)
            if total < best - 1e-12:
                best, chosen = total, text
        want = {w for w in chosen.split() if w not in pieces}
        got = toxicity.across(["".join(pieces[0]) + "".join(" " + p for p in pieces[1:])], known)
        assert {w for _, w in got} >= want and {w for _, w in got} - want <= set(pieces) and {i for i, _ in got} <= {0}
        joins += len(want)
    assert joins > 20


def test_a_single_letter_joins_where_it_costs_least():
    pick, known = random.Random(9), channel(7, 400)
    for _ in range(40):
        a, b, c = ("".join(pick.choice("abcdeilost") for _ in range(n)) for n in (3, 1, 3))
        costs = {join: price(known, a + ("" if join[0] else " ") + b + ("" if join[1] else " ") + c) + toxicity.JOIN * sum(join) for join in itertools.product((False, True), repeat=2)}
        best = min(costs, key=costs.get)
        got = {w for _, w in toxicity.across([f"{a} {b} {c}"], known)}
        if sorted(costs.values())[1] - costs[best] > 1e-9 and best == (True, True):
            assert got == {a + b + c}
        elif best == (False, False):
            assert not got
        elif got:
            assert got <= {a + b, b + c, a + b + c}


def plain_features(word):
    return [word, *(("prefix", word[:n]) for n in toxicity.PREFIXES if len(word) > n)]


def test_score_by_hand():
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefgé") for _ in range(pick.randrange(2, 9))) for _ in range(120)]
    lexicon = {}
    for word in pick.sample(words, 60):
        lexicon[pick.choice(plain_features(word))] = round(pick.uniform(2.5, 5), 3)
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(0, 40))) for _ in range(60)] + ["", "12 ?", words[0]]
    table = {}
    for word in words:
        keys, _, _ = toxicity.features([word])
        for key, feature in zip(keys.tolist(), plain_features(word), strict=True):
            if feature in lexicon:
                table[key] = lexicon[feature]
    keys = np.array(sorted(table), np.uint64)
    model = toxicity.Model(np.zeros(1), keys, np.array([table[k] for k in keys.tolist()]), -3.0)
    for text, got in zip(texts, model.score(texts).tolist(), strict=True):
        seen = collections.defaultdict(set)
        for word in text.split():
            found = [(lexicon[f], f) for f in plain_features(word) if f in lexicon]
            if found:
                top = max(weight for weight, _ in found)
                seen[next(f for weight, f in found if weight == top)].add(word)
        total = -3.0 + sum(lexicon[f] * min(0.5 + 0.5 * len(own), 2) for f, own in seen.items())
        assert math.isclose(got, 1 / (1 + math.exp(-max(-50, min(50, total)))), rel_tol=1e-9), text


def test_features_do_not_depend_on_what_stands_beside_them():
    alone = [toxicity.features([w])[0].tolist() for w in ("straße", "naïveté", "日本語語語語", "plainly", "x𝒳yzwvu")]
    keys, owner, _ = toxicity.features(["straße", "naïveté", "日本語語語語", "plainly", "x𝒳yzwvu"])
    assert [sorted(keys[owner == k].tolist()) for k in range(5)] == [sorted(a) for a in alone]


def test_null_labels_and_very_long_words(spark):
    rows = [(i, ("moron idiot " if i % 3 == 0 else "garden letter ") + f"word{i} " + "summer " * 5) for i in range(90)] + [(500, "x1" * 3000), (501, "a" * 5000 + " 1d10t"), (502, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(1, None), (None, 1), (2, 7), (3, 1), (3, 0)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert len(scores) == len(rows) and scores[0] >= 0.7 > max(scores[1], scores[500], scores[502])


def plain_grams(text):
    """N-grams of letters, a blank standing for whatever else, at an n-gram's ends only."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    out = collections.Counter()
    for width in language.WIDTHS:
        out.update(line[i : i + width] for i in range(len(line) - width + 1) if " " not in line[i + 1 : i + width - 1])
    return out


def test_predictions_of_exact_sets(spark):
    """Against sets in place of filters: the same language wherever the exact counts are apart by more than false
    positives can make up, and nearly the same score."""
    pick = random.Random(12)
    words = {lang: ["".join(pick.choice(letters) for _ in range(pick.randrange(2, 8))) for _ in range(300)] for lang, letters in (("aa", "abcdefghij"), ("bb", "efghijklmn"), ("cc", "jklmnopqrs"), ("dd", "абвгдежзиј"))}
    rows = [(" ".join(pick.choice(words[lang]) for _ in range(40)), lang) for lang in words for _ in range(30 if lang != "cc" else 60)]
    learnt = language.learn(spark.createDataFrame(rows * 2 + [(None, "aa"), ("zz", None)], "text string, lang string"))  # repeats change no share
    counts = {lang: collections.Counter() for lang in words}
    for text, lang in rows:
        counts[lang].update(plain_grams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = {lang: {g: n / total[lang] for g, n in c.items()} for lang, c in counts.items()}
    most = collections.defaultdict(float)
    for own in share.values():
        for g, s in own.items():
            most[g] = max(most[g], s)
    sets = {lang: {g for g, s in own.items() if s >= language.BELONGS * most[g]} for lang, own in share.items()}
    texts = [" ".join(pick.choice(words[pick.choice(list(words) if k % 2 else [lang])]) for _ in range(pick.randrange(1, 25))) for k in range(100) for lang in words] + [None, "", "123 !", "ЖЗИ 5 gh"]
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learnt).collect()}
    sure = 0
    for i, text in enumerate(texts):
        grams = plain_grams(text)
        exact = {lang: sum(n for g, n in grams.items() if g in sets[lang]) for lang in words}
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        first, second = sorted(exact.values(), reverse=True)[:2]
        slack = 2 + 0.05 * sum(grams.values())
        if first - second > slack:
            sure += 1
            assert got[i]["lang_pred"] == max(exact, key=exact.get)
        assert abs(got[i]["score"] - first / max(1, sum(exact.values()))) < 0.1 + slack / max(1, sum(exact.values()))
    assert sure > 200


def test_slices_do_not_change_grams():
    texts = ["Der Hund, die Katze", "", None, "ä1b", "x" * 3000]
    whole = [sorted(language.grams(part)[0].tolist()) for part in kernels.slices(pa.array(texts, pa.string()))]
    apart = [key for part in kernels.slices(pa.array(texts, pa.string()), size=1) for key in language.grams(part)[0].tolist()]
    assert sorted(apart) == whole[0]
