"""The URL model and the mixture of languages against plain loops, and on held-out cases."""

import itertools
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docledger.llm import langid, urls


def spark_hash(parts):
    """Spark's xxhash64 of several texts: the hash of one is the seed of the next."""
    h = 42
    for x in parts:
        h = xxhash.xxh64_intdigest(x.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def features(host, path):
    out = []
    for kind, text in (("host", host), ("path", path)):
        chars = f"^{text}$"
        out += [spark_hash((kind, *chars[i : i + n])) % urls.FEATURES for n in urls.SIZES for i in range(len(chars) - n + 1)]
    return out


def split(url):
    rest = url.split("://", 1)[1]
    host = rest[: min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    return host, path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def score(w, f):
    x = sum(w[j] for j in f) / math.sqrt(max(1, len(f))) + w[urls.FEATURES]
    return 1 / (1 + math.exp(-x))


def plain_regression(rows):
    rows = [(features(*split(u)), y) for u, y in sorted(rows)]
    w = [0.0] * (urls.FEATURES + 1)
    for _ in range(urls.STEPS):
        errors = [(score(w, f) - y) / len(rows) for f, y in rows]
        new = [x * (1 - urls.RATE * urls.DECAY) for x in w[:-1]] + [w[-1] - urls.RATE * sum(errors)]
        for e, (f, _) in zip(errors, rows):
            for j in f:
                new[j] -= urls.RATE * e / math.sqrt(len(f))
        w = new
    return w


def test_training_against_plain_loops(spark):
    rows = random.Random(1).sample(urls.labelled(), 60)
    got = urls.train(spark.createDataFrame(rows, "url string, label int"))
    assert np.allclose(got, plain_regression(rows), atol=1e-9)
    pages = [(i, u) for i, (u, _) in enumerate(urls.labelled())]
    judged = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rows, "url string, label int"), rules=()).collect()
    for r in judged:
        assert (r.host, r.path) == split(pages[r.page_id][1]) and abs(r.score - score(got, features(r.host, r.path))) < 1e-9
        assert r.verdict == ("block" if r.score >= 0.5 else "allow")


def accuracy(spark, train, rest):
    got = urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rest)], "page_id long, url string"), spark.createDataFrame(train, "url string, label int"), rules=()).collect()
    return sum((r.verdict == "block") == bool(rest[r.page_id][1]) for r in got) / len(rest)


def test_url_model_on_held_out_urls(spark):
    """Half of the URLs, and the URLs of words that the training never saw (which leaves their forms)."""
    rows = urls.labelled()
    assert len(rows) == 2 * urls.EACH == len(set(rows))
    half = accuracy(spark, [x for i, x in enumerate(rows) if i // 5 % 2], [x for i, x in enumerate(rows) if i // 5 % 2 == 0])
    strange = set(urls.WANTED[::4] + urls.UNWANTED[::4])
    unseen = [x for x in rows if any(w in x[0] for w in strange)]
    words = accuracy(spark, [x for x in rows if x not in unseen], unseen)
    print("held out:", half, "unseen words:", words)
    assert half >= 0.9 and words >= 0.8


def language_model(rng, names):
    """Documents of made-up languages, each with its own letters in part."""
    letters = {k: "etaoin" + "".join(rng.sample("srhldcumfpgwybv", 6)) for k in names}
    text = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    table = np.full((langid.BUCKETS, len(names)), langid.SMOOTHING)
    for i, k in enumerate(names):
        for x in langid.trigrams(text(k, 4000)).tolist():
            table[x, i] += 1
    return langid.Model(list(names), table / table.sum(0)), text


def best_mixture(model, x):
    """The set of languages of greatest likelihood less the penalty, by EM over every set, in plain loops."""
    counts = {}
    for t in x.tolist():
        counts[t] = counts.get(t, 0) + 1
    price, best = langid.PENALTY * math.log(max(2, len(x))), None
    for size in range(1, len(model.languages) + 1):
        for chosen in itertools.combinations(range(len(model.languages)), size):
            share = [1 / size] * size
            for _ in range(200):
                part = [0.0] * size
                for t, n in counts.items():
                    p = [s * model.likelihood[t, k] for s, k in zip(share, chosen)]
                    for i, v in enumerate(p):
                        part[i] += n * v / sum(p)
                share = [v / len(x) for v in part]
            value = sum(n * math.log(sum(s * model.likelihood[t, k] for s, k in zip(share, chosen))) for t, n in counts.items()) - price * size
            if best is None or value > best[0]:
                best = value, dict(zip(chosen, share))
    return best[1]


def test_mixture_against_every_set_of_languages():
    rng = random.Random(11)
    model, text = language_model(rng, ["aa", "bb", "cc", "dd"])
    for mix in (("aa",), ("dd",), ("aa", "bb"), ("cc", "dd"), ("aa", "bb", "cc"), ("bb", "bb", "dd"), ()):
        x = langid.trigrams(" ".join(text(k, 60) for k in mix))
        got = langid.mixture(model, x)
        want = best_mixture(model, x) if len(x) else {}
        assert set(np.flatnonzero(got).tolist()) == set(want), mix
        assert all(abs(got[k] - s) < 0.02 for k, s in want.items())


def test_language_edges(spark):
    """Repeated rows, clashing columns, a tie between languages that are alike, and three languages in one text."""
    rng = random.Random(5)
    model, text = language_model(rng, ["aa", "bb", "cc"])
    alike = langid.Model(["x", "y"], model.likelihood[:, [0, 0]])
    rows = [(1, text("aa", 50)), (1, text("bb", 40)), (2, " ".join(text(k, 400) for k in ("aa", "bb", "cc")))]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("score", "shares", "lang", "language")])
    assert {r.found.lang_pred for r in langid.identify(df.where("doc_id = 1"), alike, out="found").collect()} == {"x"}
    got = langid.identify(df, model, out="found").collect()
    assert len(got) == len(rows) and all(r.language == r.score == "z" for r in got)
    assert [r.found.lang_pred for r in got if r.text == rows[0][1]] == ["aa"] * 4
    assert {s["lang"] for r in got if r.doc_id == 2 for s in r.found.shares} == {"aa", "bb", "cc"}
