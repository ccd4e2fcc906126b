import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexigauge.llm import common, language_id, quality, toxicity
from lexigauge.llm.queries import op2_toxicity, op7_language_id, op9_quality

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def area(score, label):
    score, label = np.array(score), np.array(label)
    a, b = score[label == 1], score[label == 0]
    return ((a[:, None] > b[None, :]).mean() + (a[:, None] == b[None, :]).mean() / 2)


def held_out(spark, rows, column):
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    return area(*zip(*own, strict=True))


def test_toxicity_on_held_out_rows(spark):
    rows = op2_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert held_out(spark, rows, "toxic") > 0.9


def test_quality_on_held_out_rows(spark):
    rows = op9_quality(spark, SF).collect()
    assert len(rows) == 1000 and held_out(spark, rows, "quality") > 0.95


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in op7_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows]) > 0.98 and len(rows) > 200


def test_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, None), (None, 1), (4, 7)], "doc_id long, toxic int")
    n = docs.count()
    where = common.fold("doc_id", 4) != 2
    assert toxicity.score_toxicity(docs, labels, where).count() == n
    assert toxicity.score_toxicity(no_docs, labels, where).count() == 0
    empty = labels.where("false")
    assert {r.score for r in toxicity.score_toxicity(docs, empty, where).collect()} == {0.5}
    got = language_id.identify(docs, common.fold("id", 4) != 2, PATH).collect()
    texts = [d.text for d in docs.collect()]
    assert len(got) == n
    no_letters = sum(not any(c.isalpha() for c in t or "") for t in texts)
    assert sum(r.lang_pred == "und" for r in got) == no_letters
    assert language_id.identify(no_docs, common.fold("id", 4) != 2, PATH).count() == 0


def test_toxicity_sample_is_bounded_in_bytes(spark):
    texts = {i: ("word " * (20 if i % 7 else 4000)).strip() for i in range(60)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    every = toxicity.train(docs, labels, "toxic", F.lit(True), 1000)
    assert sorted(every[0]) == sorted(texts.values())
    some = toxicity.train(docs, labels, "toxic", F.lit(True), 1000, most_bytes=30_000)
    assert sum(map(len, some[0])) <= 30_000 and len(some[0]) > 45 and set(some[0]) <= set(texts.values())
    assert some == toxicity.train(docs.repartition(5), labels, "toxic", F.lit(True), 1000, most_bytes=30_000)


def segmentations(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * segmentations(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_segmentations():
    rng = random.Random(1)
    pieces = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 3))) for _ in range(20)} | {b"a", b"b", b"c"}, key=lambda x: (len(x), x))
    chances = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    model = language_id.Model(["x", "y"], pieces, chances, np.array([0.5, 0.5]))
    for k in (0, 1):
        p = dict(zip(pieces, chances[:, k], strict=True))
        assert np.allclose(np.exp(model.word_scores(words)[:, k]), [segmentations(w, p) for w in words])


def whole(word, p):
    """The log chance of a word by a plain loop over positions."""
    out = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in p:
                out[end] = np.logaddexp(out[end], out[start] + np.log(p[word[start:end]]))
    return out[-1]


def test_words_of_any_length_are_summed_whole():
    rng = random.Random(7)
    pieces = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(200)} | {b"a", b"b", b"c", b"abc" * 20}, key=lambda x: (len(x), x))
    chances = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    chances[pieces.index(b"a"), 1] = 1e-9  # chances far below those of a double
    words = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 15, 16, 47, 48, 49, 100, 255, 256, 300, 700)] + [b"a" * 300, b"abc" * 100]
    model = language_id.Model(["x", "y"], pieces, chances, np.array([0.5, 0.5]))
    for k in (0, 1):
        p = dict(zip(pieces, chances[:, k], strict=True))
        assert np.allclose(model.word_scores(words)[:, k], [whole(w, p) for w in words], rtol=1e-9)


def test_fit_counts_uses_in_words_of_any_length():
    """One round's chances against a plain sum over pairs of positions."""
    rng = random.Random(8)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"abab"]
    words = {bytes(rng.choice(b"ab") for _ in range(n)): n % 3 + 1 for n in (2, 9, 40, 70, 260, 300)}
    p = dict.fromkeys(pieces, 1 / len(pieces))
    uses = dict.fromkeys(pieces, 0.1)
    for w, n in words.items():
        total = whole(w, p)
        for a in range(len(w)):
            for x in pieces:
                if w.startswith(x, a):
                    uses[x] += n * np.exp(whole(w[:a], p) + np.log(p[x]) + whole(w[a + len(x) :], p) - total)
    got = language_id.fit({"x": words}, pieces, rounds=1).p[:, 0]
    assert np.allclose(got, np.array([uses[x] for x in pieces]) / sum(uses.values()))


def test_language_query_against_a_plain_scorer(spark, tmp_path):
    """Predictions and scores of the operator, over whole texts with long words, by a loop over words."""
    rng = random.Random(9)
    make = {"x": lambda: "".join(rng.choice("abc") for _ in range(rng.choice((3, 5, 60, 300)))), "y": lambda: "".join(rng.choice("bcd") for _ in range(rng.choice((3, 5, 60, 300))))}
    rows = [(i, " ".join(make[lang]() for _ in range(rng.randint(1, 12))), lang) for i, lang in enumerate("xy" * 20)] + [(90, None, "x"), (91, "12 34", "y"), (92, "bc", None)]
    path = str(tmp_path / "v.tiktoken")
    import base64

    vocab = [bytes([b]) for b in range(97, 101)] + [b"ab", b"abc", b"bcd", b"cd", b" bc", b"x1", b"ab" * 8]
    with open(path, "wb") as f:
        f.writelines(base64.b64encode(v) + b" %d\n" % i for i, v in enumerate(vocab))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.id: r for r in language_id.identify(frame, common.fold("id", 4) != 2, path).collect()}
    import zlib

    train = [r for r in rows if r[1] and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {lang: {} for lang in "xy"}
    for _, t, lang in train:
        for w in "".join(c if c.isalpha() else " " for c in t).encode().split():
            counts[lang][w] = counts[lang].get(w, 0) + 1
    pieces = language_id.vocabulary(path)
    assert b"x1" not in pieces and b"bc" in pieces and b"ab" * 8 in pieces
    model = language_id.fit(counts, pieces)
    share = {lang: sum(c.values()) + 1 for lang, c in counts.items()}
    for i, t, _ in rows:
        words = "".join(c if c.isalpha() else " " for c in t or "").encode().split()
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        z = {lang: np.log(share[lang]) + sum(whole(w, dict(zip(pieces, model.p[:, k].astype(np.float32).astype(float), strict=True))) for w in words) for k, lang in enumerate("xy")}
        best = max(z, key=z.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(1 / sum(np.exp(v - z[best]) for v in z.values()), abs=1e-3)


def test_expectation_maximisation_raises_the_likelihood():
    rng = random.Random(2)
    words = {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 6))): rng.randint(1, 9) for _ in range(40)}
    pieces = [b"a", b"b", b"ab", b"ba", b"aab"]
    scores = []
    for rounds in (1, 2, 4, 8):
        m = language_id.fit({"x": words}, pieces, rounds, smooth=1e-9)
        scores.append(sum(n * s for n, s in zip(words.values(), m.word_scores(list(words))[:, 0], strict=True)))
    assert scores == sorted(scores)


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    p = rng.standard_normal((2000, 3)) + [1.5, 0, 0]
    n = rng.standard_normal((2000, 3)) - [1.5, 0, 0]
    for prior in (0.3, 0.6, 0.85):
        k = int(3000 * prior)
        more = rng.standard_normal((k, 3)) + [1.5, 0, 0]
        u = np.concatenate([more, rng.standard_normal((3000 - k, 3)) - [1.5, 0, 0]])
        m = quality.fit(p, u)
        assert m.prior == pytest.approx(prior, abs=0.1)
        scores = np.concatenate([m.score(p)[:500], m.score(n)[:500]])
        assert area(scores, np.arange(1000) < 500) > 0.95  # the two overlap; the best rule has 0.983
        assert abs(m.score(u).mean() - prior) < 0.1


def test_thresholds_by_language():
    s, y = np.array([0.9, 0.8, 0.7, 0.6, 0.55, 0.2, 0.15, 0.1, 0.05, 0.01]), np.array([1, 1, 1, 1, 1, 0, 0, 0, 0, 0])
    t = toxicity.thresholds(s, y, ["en"] * 10, 0.3)
    assert 0.2 < t["en"] < 0.55 and t[None] == 0.3
    assert "de" not in toxicity.thresholds(s, y, ["de"] * 4 + [None] * 6, 0.3)


def test_toxicity_learns_from_every_label(spark, monkeypatch):
    # an earlier form kept about 5000 rows, by this draw; the toxic ones are all among those it left out
    draw = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30))
    labels = spark.range(6000).select(F.col("id").alias("doc_id")).withColumn("toxic", (draw >= (1 << 30) * 5 // 6).cast("int")).cache()
    docs = labels.select("doc_id", F.concat(F.lit("word"), F.col("doc_id") % 50, F.when(F.col("toxic") == 1, " vile").otherwise(" kind")).alias("text"), F.lit("en").alias("lang"))
    score = lambda docs: {r.id: r.score for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect()}
    rows, toxic = score(docs), {r.doc_id: r.toxic for r in labels.collect()}
    assert area([rows[i] for i in toxic], list(toxic.values())) == 1
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert score(docs.repartition(5)) == rows  # however the table lies, and however labels are joined


def test_toxicity_counts_are_plain_ones(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["a", "bad", "goodness", "gooey"], int(n))) for n in rng.integers(0, 9, 40)]
    group = rng.integers(-1, 3, 40)
    (part,) = toxicity._slices(texts)
    features, rows = toxicity.word_features(*part)
    got, want = toxicity.presence(features, rows, group, 3), np.zeros((3, toxicity.SIZE), int)
    for t, g in enumerate(group.tolist()):
        for cell in {k * toxicity.BUCKETS + int(f) for own in features[rows == t] for k, f in enumerate(own) if f != toxicity.BUCKETS}:
            want[g, cell] += g >= 0
    assert (got == want).all()


def test_toxicity_limits_are_best_steps():
    counts = np.zeros((2, toxicity.STEPS), int)
    counts[1, [3000, 2800, 2500, 2400, 2253]], counts[0, [800, 600, 400, 200, 40]] = 1, 1
    assert 801 / toxicity.STEPS < toxicity.best_step(counts) <= 2253 / toxicity.STEPS
    counts[0, 800] = 0
    assert toxicity.best_step(counts) is None


def plain_toxicity(model, text):
    """A text's score by loops over its words, from the model's numbers."""
    import re

    import pyarrow as pa

    data, offsets = common.text_buffers(pa.array([text or ""]))
    features, _ = toxicity.word_features(data, offsets)
    n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower() if (text or "").isascii() else text or ""))
    assert not (text or "").isascii() or n == len(features)
    vectors = [sum((model.e[k * toxicity.BUCKETS + f] for k, f in enumerate(own) if f != toxicity.BUCKETS), np.zeros(toxicity.DIM)) for own in features.astype(int).tolist()]
    zero = np.zeros(toxicity.DIM)
    at = lambda i: vectors[i] if i < len(vectors) else zero
    pooled = []
    for first in range(0, max(1, len(vectors)), toxicity.STRETCH):
        last = max(first + 1, min(first + toxicity.STRETCH, len(vectors)))
        if first + toxicity.STRETCH >= len(vectors):
            last = len(vectors) + max(toxicity.WIDTHS) - 1  # the padding after a text counts too
        own = []
        for w, kernel, bias in zip(toxicity.WIDTHS, model.w, model.b, strict=True):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(at(i + j) @ kernel[j * toxicity.DIM : (j + 1) * toxicity.DIM, f]) for j in range(w)) for i in range(first, last))
                own.append(max(0.0, best + bias[f]))
        pooled.append(own)
    summary = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)])
    z = float((summary - model.mean) / model.scale @ model.head + model.bias)
    return 1 / (1 + np.exp(-z))


def some_model(rng):
    model = toxicity.Model()
    model.e[:-1] = rng.standard_normal((len(model.e) - 1, toxicity.DIM)) * 0.3
    model.w = [w + 0.3 * rng.standard_normal(w.shape).astype(np.float32) for w in model.w]
    model.head, model.bias = rng.standard_normal(len(model.head)) * 0.3, -0.2
    return model


def test_toxicity_scores_by_loops(spark):
    rng = np.random.default_rng(5)
    model = some_model(rng)
    words = ["bad", "good", "terrible", "fine", "über", "a", "the", "wonderfully"]
    texts = ["", "one", " ".join(rng.choice(words, 64)), " ".join(rng.choice(words, 200)), "?!", *[" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 150, 12)]]
    got = np.concatenate([model.score(*x) for x in toxicity._slices(texts)])
    assert np.allclose(got, [plain_toxicity(model, t) for t in texts], atol=1e-4)


def test_toxicity_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    model = some_model(rng)
    words = [f"w{i}" for i in range(400)]  # no word twice in a text: at ties the loss has no gradient
    texts = [" ".join(rng.choice(words, int(n), replace=False)) for n in (3, 70, 130, 12, 1)]
    y = np.array([1.0, 0, 1, 0, 1])
    parts = [toxicity.word_features(*x) for x in toxicity._slices(texts)]
    x = toxicity.layout(parts[0][0], parts[0][1], len(texts))
    # double precision, and one embedding for each position, so that numbers can be moved one by one
    model.w, model.b = [w.astype(float) for w in model.w], [b.astype(float) + 0.05 for b in model.b]
    every = model.embed(x.words).astype(float)
    x.words = np.arange(len(every), dtype=np.int32)[:, None]
    model.e = every

    def loss():
        z = (model.summary(model.pooled(x)[0], x) - model.mean) / model.scale @ model.head + model.bias
        return np.mean(np.logaddexp(0, z) - y * z) + 5e-4 * (model.head**2).sum()

    grads, de = toxicity.gradients(model, x, y, model.head, model.bias)
    arrays = {"head": model.head} | {f"w{i}": w for i, w in enumerate(model.w)} | {f"b{i}": b for i, b in enumerate(model.b)} | {"e": model.e}
    grads["e"] = de[: len(every)]
    for name, a in arrays.items():
        flat = a.reshape(-1)
        for i in rng.choice(flat.size, min(25, flat.size), replace=False):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert grads[name].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=2e-5), name


def plain_quality(text):
    """The features of a text by plain Python."""
    import math
    import re
    import statistics

    raw = text.encode()
    words = [m for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)]
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), m[0]) for m in words]
    lines = [x for x in raw.split(b"\n")]
    lines = [x + b"\n" for x in lines[:-1]] + lines[-1:]
    lines = [x for x in lines if len(x) > 1]
    shares = [math.sqrt(sum(raw.count(bytes([b])) for b in set(own)) / max(len(raw), 1)) for own in quality.CLASSES.values()]
    sizes = [len(w) for w in low]
    n = max(len(low), 1)
    runs = [tuple(low[i : i + 3]) for i in range(len(low) - 2)]
    spread = lambda x: statistics.pstdev(x) if x else 0.0
    distinct = lambda x: len(set(x)) / len(x) if x else 1.0
    bodies = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), x.rstrip(b"\n") if x.endswith(b"\n") else x) for x in lines]
    return [*shares, math.log1p(len(raw)), math.log1p(len(low)), sum(sizes) / n, spread(sizes), sum(s > 20 for s in sizes) / n, distinct(low), distinct(runs), sum(a == b for a, b in zip(low, low[1:], strict=False)) / n, math.log1p(len(lines)), distinct(bodies), spread([math.log1p(len(x)) for x in lines]), sum(65 <= m[0][0] <= 90 for m in words) / n, float(not low)]


def test_quality_features_by_loops():
    rng = random.Random(11)
    from .conftest import prose

    texts = ["", "\n", "one", "a a a", "The The\nthe the\n\nx\n", "!!! ???", "über Ärger " * 30, "x" * 50 + " y"] + [prose(rng, rng.randint(1, 200)).title() for _ in range(20)]
    parts = [quality.features(*x) for x in toxicity._slices(texts)]
    assert np.allclose(np.concatenate(parts), [plain_quality(t) for t in texts], atol=1e-6)


def test_quality_gradients_are_those_of_the_risk():
    rng = np.random.default_rng(2)
    p, u = rng.standard_normal((40, 5)) + 0.5, rng.standard_normal((60, 5))
    for prior in (None, 0.4, 0.95):
        layers = [rng.standard_normal((5, 6)), rng.standard_normal(6), rng.standard_normal(6), np.zeros(1)]

        def parts(prior=prior, layers=layers):
            w, c, v, e = layers
            z = [np.tanh(x @ w + c) @ v + e[0] for x in (p, u)]
            decay = 5e-5 * ((w**2).sum() + (v**2).sum())
            positive, of_u, of_p = np.logaddexp(0, -z[0]).mean(), np.logaddexp(0, z[1]).mean(), np.logaddexp(0, z[0]).mean()
            return (positive + of_u, 0.0, decay) if prior is None else (prior * positive, of_u - prior * of_p, decay)

        def risk(parts=parts, prior=prior):
            a, negative, decay = parts()
            # below 0 the step goes up the negatives' risk alone
            return a + negative + decay if prior is None or negative >= 0 else -negative + decay

        grads = quality.risk_gradients(layers, p, u, prior)
        for a, g in zip(layers, grads, strict=True):
            flat = a.reshape(-1)
            for i in range(0, flat.size, 2):
                was = flat[i]
                flat[i] = was + 1e-6
                up = risk()
                flat[i] = was - 1e-6
                down = risk()
                flat[i] = was
                assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)
