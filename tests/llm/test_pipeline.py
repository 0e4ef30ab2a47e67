import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm import bpe, decontaminate, pii, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "ing", "tion", "er", "and"]) for _ in range(rng.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(40)
    rows = [(i, text(rng.randrange(5, 80)), "en", "s", 1) for i in range(60)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, "12 !! 34", None, "s", 1), (102, None, None, None, None), (103, f"{text(5)} {item} {text(5)}", "en", "s", 1), (104, f"{text(9)} someone@mail.example.com {text(9)}", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "benchmark_leaks", "personal_data", "tokens"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {}
    for i, t, *_ in sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=lambda r: r[0]):
        if not any((simhash.fingerprint(t) ^ simhash.fingerprint(o)).bit_count() <= 3 for o in kept.values()):
            kept[i] = t
    kept = {i: t for i, t in kept.items() if decontaminate.myers(decontaminate.normalise(item), decontaminate.normalise(t), int(0.1 * len(item))) > int(0.1 * len(item))}
    assert set(got) == set(kept) and 103 not in got and 100 not in got
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, t in kept.items():
        assert np.frombuffer(got[i].ids, "<u4").tolist() == enc.encode_ordinary(pii.replace(t, corpus_pipeline.SURROGATE_KEY, {})[0])


def alike(a, b):
    """Jaccard similarity of the 5-word shingles, by sets."""
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in (a, b)))
    return len(a & b) >= 0.8 * len(a | b)


def test_near_duplicates_by_every_pair(spark):
    rng = random.Random(2)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, rng.randrange(1, 5)):
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(500)}"
            rows.append((10 * i + j, " ".join(words)))
    rows += [(500, ""), (501, None), (None, rows[0][1]), (rows[5][0], rows[5][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("digest", F.lit("z"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    texts = {i: t or "" for i, t in rows if i is not None}
    group = {i: i for i in texts}
    for i in sorted(texts):
        for o in [o for o in texts if o < i and alike(texts[i], texts[o])]:
            a, b = group[i], group[o]
            group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    assert ids.count(None) == 1 and ids.count(rows[5][0]) in (0, 2)
    assert set(ids) - {None} == set(group.values())  # the least of each group stays


def test_stages_on_odd_tables(spark, tmp_path):
    """No rows; repeated rows, a very long text and clashing column names: the columns stay as they are in all stages but the last."""
    spark.createDataFrame([(1, "a passage of the benchmark that is long enough")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, long, "en", "s", 5), (2, "one two three four", "en", "s", 1), (2, "one two three four", "en", "s", 1), (3, "write to a@b.example.com now please", "en", "s", 1)]
    names = ("language", "_replaced", "_new", "gone", "digest", "found", "block", "item_id")
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.schema == docs.schema, name
        got = df.collect()
        assert all(r[n] == f"own {n}" for r in got for n in names)
        last = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
        assert last.count() == len(got) == (4 if start is docs else 0)
