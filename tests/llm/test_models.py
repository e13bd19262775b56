import datetime
import hashlib
import hmac
import itertools
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from scriptorium.llm import langid, pii, quality_classifier, quality_rules, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABETS = {"aa": "abcde", "bb": "uvwxyzö"}


def sentence(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 7))) for _ in range(n))


# --- quality rules ---


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {x for x in wins if wins.count(x) > 1}
    covered = {p for i, x in enumerate(wins) if x in often for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a b c d e a b c d e a b c d e", "x\n\nx\n y\nx", "#a *b c %|<>", "\x0b\x0ca\x85b"]
    texts += [" ".join(rng.choice("ab#") for _ in range(rng.randrange(0, 60))) + rng.choice(["", "\nz\nz"]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality_rules.statistics(F.col("t")).alias("s"))
    got = {r.i: (r.s.n_words, r.s.word_chars, r.s.n_symbols, r.s.n_dup_lines, r.s.n_repeat_words) for r in df.collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def corpus(spark, n=700):
    rng = random.Random(9)
    rows = [(i, " ".join(sentence(rng, "abcdefgh", 9).capitalize() + "." for _ in range(rng.randrange(2, 30))), "en", f"s{i % 2}", 0) for i in range(n)]
    bad = [(n + i, " ".join(f"{w}{rng.choice(['###', '$$$', '&&&'])}" for w in sentence(rng, "abcdefgh", 120).split()), "en", "s0", 0) for i in range(30)]
    return spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long"), n


def test_outliers_are_rejected_and_clean_documents_kept(spark, odd, none):
    docs, n = corpus(spark)
    out = quality_rules.quality_rules(docs).toPandas()
    assert out[out.doc_id < n].kept.all() and not out[out.doc_id >= n].kept.any()
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(out[out.kept].doc_id)
    out = quality_rules.quality_rules(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept)
    assert quality_rules.quality_rules(none).count() == 0 and quality_rules.keep_good(none).count() == 0
    clash = odd.withColumns({"g": F.lit(1), "s": F.lit(2), "x": F.lit(3), "distance": F.lit(4)})
    assert quality_rules.keep_good(clash).columns == clash.columns


def test_estimates_are_the_least_determinant_of_all_subsets(spark, monkeypatch):
    """Brute force over all subsets of small groups, with outliers planted in each."""
    monkeypatch.setattr(quality_rules, "PRIOR", 0)
    rng = np.random.default_rng(3)
    floor = np.array(quality_rules.FLOOR)
    rows, sets = [], {}
    for g in range(3):
        x = rng.normal(size=(9, quality_rules.P)) * 0.4 + g
        x[:2] += rng.choice([-4, 4], (2, quality_rules.P))
        sets[f"s{g}"] = x
        rows += [(("en", f"s{g}"), [float(v) for v in r]) for r in x]
    rows = spark.createDataFrame(rows, "g struct<lang:string,source:string>, x array<double>")
    got = {r.k.source: r for r in quality_rules.estimates(rows).collect()}
    factor = quality_rules._consistency(quality_rules.P, quality_rules.H)
    for name, x in sets.items():
        found = []
        for subset in itertools.combinations(range(9), 7):  # 7 = ceil(0.75 * 9)
            cov = np.cov(x[list(subset)].T, bias=True) * factor + np.diag(floor**2)
            found.append((np.linalg.slogdet(cov)[1], subset))
        least, subset = min(found)
        assert np.allclose(got[name].mu, x[list(subset)].mean(0))
        assert np.isclose(2 * sum(np.log(got[name].chol[i * (i + 3) // 2]) for i in range(quality_rules.P)), least)
        assert set(subset) == set(range(2, 9))


def test_a_small_group_leans_on_the_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(("en", "big"), [float(v) for v in r]) for r in rng.normal(size=(400, quality_rules.P))] + [(("en", "one"), [3.0] * quality_rules.P)]
    got = {r.k.source: r for r in quality_rules.estimates(spark.createDataFrame(rows, "g struct<lang:string,source:string>, x array<double>")).collect()}
    assert max(abs(np.array(got["one"].mu))) < 0.6 and max(abs(np.array(got["big"].mu))) < 0.3
    assert abs(quality_rules.CUTOFF - 22.4577) < 1e-3  # 0.999 of six degrees, as printed in tables


# --- language ---


def test_language_by_held_out_accuracy(spark, none):
    rng = random.Random(1)
    rows = [(i, sentence(rng, ALPHABETS[lang], rng.randrange(4, 60)), lang) for i in range(300) for lang in [("aa", "bb")[i % 2]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !!", None), (902, "", "bb")], "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    network = langid.train(docs.where(~held))
    out = langid.identify(docs, network).toPandas().set_index("doc_id")
    test = [(d, lang) for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([out.lang_pred[d] == lang for d, lang in test]) > 0.95
    assert (out.lang_pred[[900, 901, 902]] == "und").all() and out.score.between(0, 1).all()
    assert langid.identify(none, network).count() == 0
    assert langid.train(none).langs == []
    assert {r.lang_pred for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], state=3)
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, lang = rng.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])

    def loss():
        states = []
        for way, order in ((0, range(5)), (1, range(4, -1, -1))):
            h, kept = np.zeros((3, 4)), {}
            for t in order:
                kept[t] = h = net._cell(way, h, x[t])[0]
            states.append(kept)
        total = 0.0
        for t in range(5):
            z = net.read[0] @ states[0][t] + net.read[1] @ states[1][t]
            total -= (z[lang, np.arange(4)] - np.log(np.exp(z).sum(0))).sum()
        return total / 20

    g = net._gradients(x, lang)
    for k, at in (("inputs", (0, 4, x[1, 0])), ("recurrent", (1, 7, 2)), ("bias", (1, 1, 0)), ("read", (0, 1, 2)), ("recurrent", (0, 1, 0))):
        v = getattr(net, k)
        v[at] += 1e-5
        hi = loss()
        v[at] -= 2e-5
        lo = loss()
        v[at] += 1e-5
        assert abs((hi - lo) / 2e-5 - g[k][at]) < 1e-4


# --- toxicity ---


def brute_kernel(s, t):
    def features(w):
        out = {}
        for c in combinations(range(len(w)), toxicity.ORDER):
            key = "".join(w[i] for i in c)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (c[-1] - c[0] + 1)
        return out

    a, b = features(s), features(t)
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_subsequence_kernel_equals_brute_force():
    words = ["idiot", "i-d-i-o-t", "idxiot", "ab", "", "banana", "ananas"]
    got = toxicity.kernel(words, ["idiot", "banana"])
    # The kernel weighs by decay over the span in both strings.
    want = np.array([[brute_kernel(a, b) for b in ("idiot", "banana")] for a in words])
    assert np.allclose(got, want, rtol=1e-4)
    assert np.allclose(toxicity._own(words) ** 2, [max(brute_kernel(w, w), 1e-12) for w in words], rtol=1e-4)


def test_subsequence_weights_equal_the_sum_of_kernels():
    landmarks, weights = ["\x02idiot", "banana", "ab", "añadir", "", "\x00a\x00b\x00c"], np.array([1.0, -2.0, 3.0, 0.5, 1.0, 1.0])
    words = ["idiot", "\x02i-d-i-o-t", "bandana", "ana", "", "ab", "zzz", "ñañaña", "\x00a\x00b\x00c", "a" * 25]
    got = toxicity.Expansion(landmarks, weights).normalised(words)
    plain = [w.replace("\x00", "") for w in landmarks]
    for word, value in zip(words, got, strict=True):
        if "\x00" not in word:
            want = sum(w * brute_kernel(word, v) for w, v in zip(weights[:5], plain[:5], strict=True))
            assert np.isclose(value, want / np.sqrt(max(brute_kernel(word, word), 1e-12)))
    assert np.isfinite(got).all()
    assert (toxicity.Expansion([], np.zeros(0)).normalised(words) == 0).all()


def test_toxicity_by_held_out_accuracy(spark, none):
    rng = random.Random(2)
    insults, rows, labels = ["scumbag", "nitwit", "dimwit"], [], []
    for i in range(600):
        words, toxic = sentence(rng, "abehotrl", 60).split(), int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "d.i.m.w.i.t s c u m b a g niXtwit so bad")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    out = toxicity.score(docs, model).toPandas().set_index("doc_id")
    test = [(d, t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([out.predicted[d] == t for d, t in test]) > 0.95
    assert out.score.between(0, 1).all() and out.predicted[900] == 0 and out.predicted[901] == 0 and out.predicted[902] == 1
    assert toxicity.score(none, model).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, marks.where("false"))).collect()} == {0.0}


def test_sentence_machine_equals_plain_rounds():
    """Strongest units, positives and costs, written out sentence by sentence."""
    rng = np.random.default_rng(8)
    for _ in range(5):
        x = rng.normal(size=(14, 4))
        toxic = np.array([1, 0, 0, 1, 0, 1, 0])
        sentences = [(int(rng.integers(7)), rng.integers(0, 14, rng.integers(1, 5)).tolist()) for _ in range(25)]
        first = rng.normal(size=14)
        unit = np.array([u for _, us in sentences for u in us])
        sentence_of = np.array([k for k, (_, us) in enumerate(sentences) for _ in us])
        w, b = toxicity._sentence_machine(x, unit, sentence_of, np.array([t for t, _ in sentences]), toxic, first)
        strength = first
        for n in range(toxicity.ROUNDS):
            tops = [(t, max(us, key=lambda u: (strength[u], -u))) for t, us in sentences]
            cost: dict = {}
            for t, u in tops:
                if not toxic[t]:
                    cost[u, -1.0] = cost.get((u, -1.0), 0) + 1
                    continue
                strongest = strength[u] >= max(strength[v] for s, v in tops if s == t)
                if strongest if n == 0 else (strongest and strength[u] > toxicity.WITNESS) or strength[u] > 1:
                    cost[u, 1.0] = cost.get((u, 1.0), 0) + 1
            rows = sorted(cost, key=lambda k: (k[0], k[1]))
            y, c = np.array([r[1] for r in rows]), np.array([min(cost[r], toxicity.MOST_EQUAL) for r in rows], float)
            if not (y > 0).any():
                break
            c[y > 0] *= max(1.0, c[y < 0].sum() / c[y > 0].sum())
            plain, bias = toxicity._svm(x[[r[0] for r in rows]], y, c, toxicity.RIDGE)
            strength = x @ plain + bias
        assert np.allclose(w, plain) and np.isclose(b, bias)


def test_long_units_are_learned_whole():
    """A long unit that is toxic by its end teaches as it is scored."""
    rng = random.Random(6)
    texts, toxic = [], []
    for i in range(300):
        words, bad = sentence(rng, "abehotrl", 30).split(), i % 3 == 0
        words.insert(5, "abehotrl" * 4 + ("zqkwvzqkwv" if bad else "xyjuxxyjux"))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    assert [len(toxicity.parts_of("x" * n)) for n in (1, 24, 25, 40, 41)] == [1, 1, 2, 2, 3]
    model = toxicity.fit(texts[:200], np.array(toxic[:200]))
    found = model.score(pa.array(texts[200:])) >= 0.5
    assert np.mean(found == np.array(toxic[200:])) > 0.95


def test_languages_and_toxicity_of_odd_documents(spark, odd):
    names = ("lang_pred", "score", "predicted", "held_out", "labels", "at", "doc")
    docs = odd.withColumns({c: F.lit("x") for c in names})
    network = langid.train(docs.where("doc_id is not null and lang is not null"))
    marks = spark.createDataFrame([(1, 1, 1), (5, 1, 0), (6, 1, 0), (8, 1, 1), *[(10 + i, 1, i % 2) for i in range(12)]], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    for out, columns in ((langid.identify(docs, network), ["doc_id", "lang_pred", "score"]), (toxicity.score(docs, model), ["doc_id", "score", "predicted"])):
        rows = out.collect()
        assert set(columns) <= set(out.columns) and len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        by_id = {}
        for r in rows:
            by_id.setdefault(r.doc_id, set()).add(tuple(r))
        assert all(len(v) == 1 for v in by_id.values())  # repeated rows agree
        same = {tuple(r)[1:] for r in rows if r.doc_id in (5, 6)}  # a very long text, twice
        assert len(same) == 1


# --- quality classifier ---


def test_classifier_by_held_out_accuracy(spark, odd, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        low = i % 4 == 0
        rows.append((i, " ".join(w + ("$$$" if low else "") for w in sentence(rng, "abehotrl", 50).split())))
        labels.append((i, int(not low), int(i % 7 == 0)))
    docs = spark.createDataFrame([*rows, (900, None)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (900, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, marks.where("doc_id % 5 <> 0 or doc_id is null"))
    assert (np.diff(model.thresholds) > 0).all()
    out = quality_classifier.score(docs, model).toPandas().set_index("doc_id")
    assert np.mean([out.kept[d] == (q == 1) for d, q, _ in labels if d % 5 == 0]) > 0.97
    assert out.expected_grade.between(0, 2).all() and out.kept[900]
    good = quality_classifier.keep_good(docs.withColumns({"kept": F.lit("x"), "at": F.lit(1)}), model)
    assert sorted(r.doc_id for r in good.collect()) == sorted(out.index[out.kept]) and good.columns == ["doc_id", "text", "kept", "at"]
    assert quality_classifier.score(odd, model).count() == odd.count() and quality_classifier.score(none, model).count() == 0
    free = quality_classifier.train(docs, marks.where("false"))
    assert all(r.kept for r in quality_classifier.score(odd, free).collect())


def test_first_step_goes_down_the_numerical_gradient(monkeypatch):
    """One step of Adam moves each weight against the sign of its gradient; at the end those of the thresholds vanish."""
    rng = np.random.default_rng(5)
    x, grade = rng.normal(size=(60, 6)).astype(np.float32), rng.integers(0, 3, 60)
    monkeypatch.setattr(quality_classifier, "STEPS", 0)
    start = quality_classifier.fit(x, grade)
    monkeypatch.setattr(quality_classifier, "STEPS", 1)
    moved = quality_classifier.fit(x, grade)

    def loss(w, thresholds):
        th = np.concatenate([[-np.inf], thresholds, [np.inf]])
        f = x @ w
        return -np.log(1 / (1 + np.exp(-(th[grade + 1] - f))) - 1 / (1 + np.exp(-(th[grade] - f)))).mean() + quality_classifier.DECAY / 200 * (w * w).sum()

    def numerical(at, shift):
        return (loss(*at(shift)) - loss(*at(-shift))) / (2 * shift)

    for k in range(6):
        g = numerical(lambda e, k=k: (start.weights + e * np.eye(6)[k], start.thresholds), 1e-5)
        assert np.sign(moved.weights[k] - start.weights[k]) == -np.sign(g)
    monkeypatch.setattr(quality_classifier, "STEPS", 1000)
    end = quality_classifier.fit(x, grade)
    at_end = [numerical(lambda e, k=k: (end.weights, end.thresholds + e * np.eye(2)[k]), 1e-4) for k in range(2)]
    assert np.abs(at_end).max() < 0.02 and loss(end.weights, end.thresholds) < loss(start.weights, start.thresholds)


def test_line_is_the_same_in_any_batch():
    texts = ["abc def", "", "and and and", "é" * 50, "x", "the quick brown"]
    model = quality_classifier.Model(np.random.default_rng(0).normal(size=quality_classifier.BUCKETS), np.zeros(2))
    whole = model.line(pa.array(texts))
    assert np.allclose(whole, np.concatenate([model.line(pa.array([t])) for t in texts]))
    assert np.allclose(whole, quality_classifier.features(pa.array(texts)) @ model.weights, atol=1e-5)


# --- personal data ---


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def test_pseudonyms(spark, odd, none):
    texts = [
        "Of und.34@mail7.example.com x und.34@mail7.example.com",
        "+1 (017) 555-7713, 97.51.17.173 and 9807915762804490 4845168114407329.",
        'token = "abe29cfcdae4f03e1e339fcaa4c5bb00" TOKEN = "ECF7C5B09FE5949719B6B82BC439E9329B"!!',
        "on 2024-02-29, 31/12/1999 and 31.02.2000",
        "4845-1681-1440-7329 256.1.1.1 1.2.3.4.5 no 12 or 1234567890123456",
        "", None, "nothing here",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = under(df, "k", another="another key", back=True).collect()
    assert [r.back for r in out] == texts
    p = [r.p for r in out]
    assert re.fullmatch(r"Of (\S+@\S+\.example\.com) x \1", p[0]) and "und.34" not in p[0]
    phone, ip, same, card = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}), ([\d.]+) and (\d{16}) (\d{16})\.", p[1]).groups()
    assert phone != "+1 (017) 555-7713" and ip != "97.51.17.173" and all(int(o) < 256 for o in ip.split("."))
    assert same == "9807915762804490" and card != "4845168114407329" and luhn(card)
    assert re.fullmatch(r'token = "[0-9a-f]{32}" TOKEN = "[0-9A-F]{34}"!!', p[2]) and p[2] != texts[2]
    assert re.fullmatch(r"on \d{4}-\d\d-\d\d, \d\d/\d\d/\d{4} and 31\.02\.2000", p[3]) and p[3] != texts[3]
    assert p[4].endswith(" 256.1.1.1 1.2.3.4.5 no 12 or 1234567890123456") and luhn(p[4][:19].replace("-", ""))
    assert p[5:] == ["", None, "nothing here"] and out[0].other != p[0]
    keys = pii.key_table(spark, "k")
    kept = pii.pseudonymize(odd, keys)
    assert kept.columns == odd.columns and kept.count() == odd.count() and pii.pseudonymize(none, keys).count() == 0
    clashing = odd.withColumns({"keys": F.lit("x"), "key": F.lit(1)})
    assert sorted(map(str, pii.restore(pii.pseudonymize(clashing, keys), keys).collect())) == sorted(map(str, clashing.collect()))


def under(df, key, another=None, back=False):
    """Adds p, the pseudonymized text; with `back` what it is restored to, with `another` key `other`."""
    spark = df.sparkSession
    out = df.withColumn("k", pii.key_table(spark, key).scalar()).withColumn("p", pii.pseudonymized(F.col("text"), F.col("k")))
    if back:
        out = out.withColumn("back", pii.restored(F.col("p"), F.col("k")))
    if another:
        out = out.withColumn("k2", pii.key_table(spark, another).scalar()).withColumn("other", pii.pseudonymized(F.col("text"), F.col("k2")))
    return out


class PlainFeistel:
    """The same permutation, written in plain Python."""

    def __init__(self, key):
        self.keys = [hmac.new(key.encode(), f"round {r}".encode(), hashlib.sha256).hexdigest() for r in range(8)]

    def permute(self, xs, ms):
        xs = list(xs)
        half = len(xs) // 2
        for r in range(8):
            other = xs[half:] if r % 2 == 0 else xs[:half]
            digest = "|".join([self.keys[r], str(len(xs)), ",".join(map(str, other))])
            for i in range(len(xs)):
                if (i < half) == (r % 2 == 0) and ms[i] > 1:
                    hashed = hashlib.sha256(f"{digest}|{i // 16}".encode()).hexdigest()
                    xs[i] = (xs[i] + int(hashed[i % 16 * 4 : i % 16 * 4 + 4], 16)) % ms[i]
        return xs

    def string(self, text, low, high, alphabets):
        own = [next((a for a in alphabets if c in a), "") if low <= i < high else "" for i, c in enumerate(text)]
        xs = self.permute([a.index(c) if a else 0 for a, c in zip(own, text, strict=True)], [max(1, len(a)) for a in own])
        return "".join(a[x] if a else c for a, x, c in zip(own, xs, text, strict=True))

    def layout(self, text, digits):
        """The last digits of a text replaced by others."""
        skip = sum(c in pii.DIGITS for c in text) - len(digits)
        out, k = [], 0
        for c in text:
            if c in pii.DIGITS:
                out.append(digits[k - skip] if k >= skip else c)
                k += 1
            else:
                out.append(c)
        return "".join(out)

    def match(self, x):
        digits = re.sub(r"[^0-9]", "", x)
        if "@" in x:
            return self.string(x, 0, len(x) - len(re.search(r"[^.@]+\.[^.@]+$", x)[0]), pii.ALPHABETS)
        if x.endswith('"'):
            inner = re.search('"(.*)"', x)[1]
            letters = "abcdef" if re.search("[a-f]", inner) else "ABCDEF"
            return self.string(x, x.index('"') + 1, len(x) - 1, (pii.DIGITS + letters, "ABCDEF"))
        if regex.fullmatch(pii.PHONE, x):
            return self.layout(x, self.string(digits[-10:], 0, 10, [pii.DIGITS]))
        if regex.fullmatch(pii.IP, x):
            return ".".join(map(str, self.permute(map(int, x.split(".")), [256] * 4)))
        for form in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"):
            try:
                nth = (datetime.datetime.strptime(x, form).date() - datetime.date(1900, 1, 1)).days
            except ValueError:
                continue
            if 0 <= nth < 400 * 183:
                a, b = self.permute([nth // 183, nth % 183], [400, 183])
                return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 183 + b)).strftime(form)
        if regex.fullmatch(pii.CARD, x) and luhn(digits):
            body = self.string(digits[:-1], 0, 99, [pii.DIGITS])
            return self.layout(x, body + next(c for c in pii.DIGITS if luhn(body + c)))
        return x

    def text(self, text):
        return regex.sub(pii.PATTERN, lambda m: self.match(m[0]), text)


def test_pseudonyms_equal_a_plain_feistel_network(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    def card():
        body = digits(15)
        return next(body + c for c in "0123456789" if luhn(body + c))
    kinds = [
        lambda: f"{rng.choice(['jo', 'Ann-Marie', 'müller', 'x_y'])}.{digits(2)}@mail{digits(1)}.{rng.choice(['a-b.', ''])}example.org", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"+1 {digits(3)}.{digits(3)}.{digits(4)}", card, lambda: "-".join(re.findall("....", card())), lambda: ".".join(str(rng.randrange(300)) for _ in range(4)),
        lambda: f"{rng.randrange(1850, 2120)}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 32):02d}", lambda: f"{rng.randrange(1, 32):02d}/{rng.randrange(1, 13):02d}/{rng.randrange(1890, 2110)}",
        lambda: f"{rng.randrange(1, 32):02d}.{rng.randrange(1, 13):02d}.2001", lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(20))}"', lambda: f'API_KEY: "{digits(9)}"',
        lambda: "plain words", lambda: digits(16),
    ]
    texts = [" ".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 7))) + rng.choice([".", "", " x"]) for _ in range(250)]
    plain = PlainFeistel("a key")
    got = {r.i: r.p for r in under(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "a key").collect()}
    assert got == {i: plain.text(t) for i, t in enumerate(texts)}
    assert sum(plain.text(t) != t for t in texts) > 150


def test_keys_are_in_no_plan_and_needed(spark, capsys):
    docs = spark.createDataFrame([(1, "a.b@c.example.com", 17)], "doc_id long, text string, n_chars long")
    out = pii.pseudonymize(docs, pii.key_table(spark, "very-secret"))
    rounds = pii.key_table(spark, "very-secret").first()["keys"]
    out.explain(True)
    out.count()
    shown = capsys.readouterr().out + out._jdf.queryExecution().toString()
    assert "scalar-subquery" in shown and not any(k in shown for k in ["very-secret", *rounds])
    for bad in (lambda: pii.session_key(spark), lambda: pii.key_table(spark, "")):
        with pytest.raises(ValueError, match="key"):
            bad()
    assert pii.stored_keys(spark).collect() == pii.stored_keys(spark).collect() != pii.key_table(spark, "very-secret").collect()


def test_pseudonyms_are_a_permutation(spark):
    texts = [f"{a}.{b}.7.9" for a in range(1, 12) for b in range(30)] + [f"a.{n:02d}@b.example.com" for n in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df = under(df, "k").select("p")
    assert df.distinct().count() == len(texts)


def test_numbers_stay_linked_across_layouts(spark):
    texts = ["555-123-4567", "(555) 123-4567", "+1 555.123.4567", "4111 1111 1111 1111", "4111111111111111"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = {r.text: r.p for r in under(df, "k", back=True).where("back = text").collect()}
    digits = lambda t: re.sub(r"\D", "", out[t])
    assert set(out) == set(texts) and all(out[t] != t and len(out[t]) == len(t) for t in texts)
    assert digits(texts[0]) == digits(texts[1]) == digits(texts[2])[1:] and digits(texts[3]) == digits(texts[4])
    assert re.sub(r"\d", "#", out[texts[3]]) == "#### #### #### ####"


def test_folds_of_the_queries(spark):
    d = "/root/testdata/sf0.001"
    for query, of, left in ((queries.op2_langid, 5, 0), (queries.op3_toxicity, 4, 2)):
        out = query(spark, d).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == left) and 0 <= r.score <= 1 for r in out)
        assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()


def test_a_filter_by_distance_holds_each_step_once(spark):
    rng, p = np.random.default_rng(5), quality_rules.P
    chol = [float(v) for i in range(p) for v in [*rng.normal(size=i), 1 + rng.random()]]
    rows = spark.createDataFrame([(("a" if i % 2 else None, "s"), rng.normal(size=p).tolist(), i) for i in range(40)], "g struct<lang:string,source:string>, x array<double>, i int")
    params = spark.createDataFrame([((None, "s"), rng.normal(size=p).tolist(), chol)], "k struct<lang:string,source:string>, mu array<double>, chol array<double>")
    wanted = {r.i: r.distance for r in quality_rules._verdict(rows, params).collect()}
    distance = quality_rules._distance(F.col("x"), F.col("own.mu"), F.col("own.chol"))
    found = quality_rules._owned(rows, params).select("i", distance.alias("d"))
    assert {r.i: r.d for r in found.collect()} == wanted and {i for i, d in wanted.items() if d is None} == set(range(1, 40, 2))
    kept = quality_rules._owned(rows, params).where(F.coalesce(distance, F.lit(0.0)) <= 9.0).select("i")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("chol") < 100
    assert {r.i for r in kept.collect()} == {i for i, d in wanted.items() if d is None or d <= 9.0}
