"""Language identification: every label is learned, equal layouts give equal dictionaries, brute-force prediction."""

import random

import zstandard
from pyspark.sql import functions as F

from lanwatch.llm import language

RNG = random.Random(9)


def labelled(spark, languages, each):
    rows = []
    for k in range(languages):
        own = ["".join(RNG.choices("abcdefghijklmnopqrstuvwxyz"[k % 13:k % 13 + 12], k=5)) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(RNG.choices(own, k=25)), f"l{k:03d}") for i in range(each)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_three_hundred_labels_are_all_learned(spark):
    docs = labelled(spark, 300, 8)
    learned = language.learn(docs)
    taught = {r.lang for r in docs.where(~language.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(learned) == taught and len(taught) >= 299
    assert all(learned.values())


def test_labels_share_the_room(spark, monkeypatch):
    monkeypatch.setattr(language, "ALL_BYTES", 40 * 200)
    learned = language.learn(labelled(spark, 40, 10))
    assert len(learned) == 40 and sum(map(len, learned.values())) <= 40 * 200


def test_dictionaries_do_not_depend_on_layout(spark, monkeypatch):
    monkeypatch.setattr(language, "DICT_DOCS", 5)
    docs = labelled(spark, 3, 400)
    docs = docs.unionByName(docs.where("lang = 'l000'").withColumn("text", F.lit("one text that fills a third of the rows")))
    first, second = language.learn(docs.repartition(1)), language.learn(docs.repartition(13))
    assert first == second and set(first) == {"l000", "l001", "l002"}


def brute_predict(text, dictionaries):
    """Sizes with each dictionary, block by block, straight from the library."""
    if text is None or not any(c.isalpha() for c in text):
        return "und"
    data = text.lower().encode()
    sizes = {}
    for lang, raw in dictionaries.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=language.ENCODER)
        sizes[lang] = sum(len(c.compress(data[i:i + language.BLOCK_BYTES])) for i in range(0, len(data), language.BLOCK_BYTES))
    return min(sorted(sizes), key=sizes.__getitem__)


def test_query_equals_brute_force_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dictionaries = language.learn(docs)
    texts = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    got = {r.doc_id: r for r in language.query(spark, sf).collect()}
    assert set(got) == set(texts)
    sample = sorted(texts)[::3]
    assert all(got[i].lang_pred == brute_predict(texts[i][0], dictionaries) for i in sample)
    held = [i for i in texts if got[i].held_out and texts[i][0] and texts[i][1]]
    assert sum(got[i].lang_pred == texts[i][1] for i in held) / len(held) > 0.95


def test_model_does_not_depend_on_the_layout_of_files(spark, monkeypatch):
    from lanwatch.llm import lm
    monkeypatch.setattr(lm, "TASK_SPANS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = lm.word_counts(docs).cache()
    lexicon = lm.Lexicon(counts)
    scores = []
    for parts in (1, 5):
        rows = docs.repartition(parts, "lang").cache()
        scores.append({r.doc_id: r.score for r in lm.score(rows, counts, lexicon, lm.train(rows, lexicon)).collect()})
    assert max(abs(scores[0][k] - scores[1][k]) / abs(scores[0][k]) for k in scores[0]) < 1e-4


def test_score_equals_a_plain_network(spark):
    """Log probabilities of whole texts, one token at a time, straight from the definition of the unit."""
    import numpy as np
    from lanwatch.llm import gru
    rng = np.random.default_rng(4)
    counts = np.arange(200, 70, -1.0)
    model = gru.Model.new(counts, 500.0)
    model.train([rng.integers(0, len(counts) + 1, 60).astype(np.int32) for _ in range(40)])
    w, n = {k: v.astype(np.float64) for k, v in model.w.items()}, gru.HIDDEN
    texts = [rng.integers(0, len(counts) + 1, size).astype(np.int64) for size in (1, 7, 90, 300)]

    def plain(text):
        h, before, total = np.zeros(n), gru.END, 0.0
        for token in text:
            x, hu = w["embed"][before] @ w["wx"] + w["b"], h @ w["u"]
            z, r = (1 / (1 + np.exp(-(x[k * n:(k + 1) * n] + hu[k * n:(k + 1) * n]))) for k in (0, 1))
            new = np.tanh(x[2 * n:] + r * hu[2 * n:])
            h = z * h + (1 - z) * new
            classes = h @ w["wc"] + w["bc"]
            kind = len(classes) - 1 if token == len(counts) else token // gru.CLASS
            total += classes[kind] - np.log(np.exp(classes).sum())
            if token < len(counts):
                inside = h @ w["ww"][kind] + w["bw"][kind]
                total += inside[token % gru.CLASS] - np.log(np.exp(inside).sum())
            before = token
        return total

    assert np.allclose(model.score(texts), [plain(t) for t in texts], rtol=1e-4)
