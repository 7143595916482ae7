import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import labelled, langid, quality, queries, toxicity

from .helpers import EDGE, edge, empty

LABELS = [(i, i % 2, i % 2) for i in range(1, 10)]


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def accuracy(found, truth, column):
    got = [(r[column] == truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    return np.mean(got), len(got)


def test_toxicity_on_held_out_labels(spark, large):
    """Of the toxic labels held out at least 0.75 are found, of the others at most 0.03 wrongly; a constant does neither."""
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    found = queries.op3_toxicity(spark, large).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in found)
    said = {y: [r["predicted"] for r in found if r["held_out"] and truth.get(r["doc_id"]) == y] for y in (0, 1)}
    assert len(said[1]) >= 50 and np.mean(said[1]) >= 0.75
    assert len(said[0]) >= 300 and np.mean(said[0]) <= 0.03


def test_quality_on_held_out_labels(spark, medium):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    found = queries.op8_quality(spark, medium).collect()
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    got, n = accuracy(found, truth, "predicted")
    assert n > 50 and got >= 0.93


def test_language_on_held_out_documents(spark, medium):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    found = queries.op10_language(spark, medium).collect()
    assert all(r["held_out"] == held_out(r["doc_id"], 3, 1) for r in found)
    got, n = accuracy(found, truth, "lang_pred")
    assert n > 300 and got >= 0.98


def test_edge_rows(spark):
    labels = spark.createDataFrame([*LABELS, (None, 1, 1), (99, 0, 0), (4, None, 7)], "doc_id long, quality int, toxic int")
    for f in (toxicity.toxicity, quality.quality):
        found = f(edge(spark), labels).collect()
        assert len(found) == len(EDGE) and all(0 <= r["score"] <= 1 for r in found)
        assert f(empty(spark), labels).count() == 0
        assert f(edge(spark), labels.limit(0)).count() == len(EDGE)
    found = langid.identify(edge(spark)).collect()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert all(r["lang_pred"] != "und" for r in found if r["doc_id"] in (4, 5, 7))
    assert langid.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(edge(spark))
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE) - 4
    unknown = edge(spark).withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unknown).count() == len(EDGE) - 4
    assert langid.keep_identified(empty(spark)).count() == 0


def test_filters_have_no_false_negatives():
    texts = [("a", "alpha beta gamma delta"), ("b", "uno dos tres cuatro"), ("b", "dos tres seis siete")]
    model = langid.fit(texts)
    for lang, t in texts:
        bits = np.unpackbits(model.holders(langid.grams(t.encode())), axis=1, bitorder="little")
        assert bits[:, model.langs.index(lang)].all()
    assert model.predict("gamma delta beta")[0] == "a" and model.predict("tres siete")[0] == "b"
    assert model.predict("12345")[0] == "und" and model.predict(None)[0] == "und"


def test_more_languages_than_bits_of_a_byte():
    words = [f"{a}{b}{a}{b}{c}" for a in "bcdf" for b in "aei" for c in "xy"]
    texts = [(f"l{i:02d}", " ".join(f"{w}{k}".replace(str(k), "qrst"[k]) for k in range(4))) for i, w in enumerate(words)]
    model = langid.fit(texts)
    assert len(model.langs) == 24 and [model.predict(t)[0] for _, t in texts] == [x for x, _ in texts]


def test_windows_hold_the_whole_text():
    text = ("Some words, and MORE words! " * 50).encode()
    joined = b" ".join(w.removesuffix(b"\n" * 10).strip() for w in toxicity.windows(text))
    assert joined.split() == toxicity.words_of(text)
    assert toxicity.windows(b"") == [] and toxicity.windows(b" ,. ") == []


def test_rates_rise():
    out = toxicity.rising(np.array([0.1, 0.5, 0.2, 0.9]), np.ones(4))
    assert np.allclose(out, [0.1, 0.35, 0.35, 0.9])


def language_counts(text, lists):
    """For each language how many 4-grams of a text are in its set."""
    folded = "".join(c.lower() if c.isascii() and c.isalpha() else c if ord(c) > 127 else " " for c in text).encode()
    padded = b"  " + b" ".join(folded.split()) + b" "
    found = [padded[i : i + 4] for i in range(len(padded) - 3)]
    return {lang: sum(g in own for g in found) for lang, own in lists.items()}


def test_languages_match_exact_sets(spark, small):
    """The Bloom filters decide as sets of the same n-grams do, but for near ties."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect() if r["text"]]
    model = langid.fit([(lang, t) for _, lang, t in texts])
    lists = {lang: set() for lang in model.langs}
    shares = {}
    for lang in model.langs:
        own = [t for _, x, t in texts if x == lang]
        counted = Counter(g for t in own for g in {bytes(x) for x in langid.grams(t.encode()).astype(">u8").view("S8").tolist()})
        shares[lang] = {g: n / len(own) for g, n in counted.items() if n / len(own) >= langid.SUPPORT}
    for lang, held in shares.items():
        for g, s in held.items():
            if s * langid.CONTRAST >= max(o.get(g, 0) for o in shares.values()):
                lists[lang].add(g[-4:])
    for _, _, t in texts:
        want = language_counts(t, lists)
        first, second = sorted(want.values(), reverse=True)[:2]
        if first - second > 0.05 * sum(want.values()):
            assert model.predict(t)[0] == max(want, key=want.get)


def test_quality_matches_brute_force():
    """Neighbours and votes of every text against one loop over all labelled vectors."""
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "g4mma", "d-e", "!!", "zeta"]
    texts = [(int(y), " ".join(rng.choice(words, 30, p=p)).encode()) for y, p in zip(rng.integers(0, 2, 60), rng.dirichlet(np.ones(6), 60))]
    model = quality.fit(texts, {0: 30, 1: 30})
    ask = [" ".join(rng.choice(words, 20)).encode() for _ in range(20)]
    got = model.scores(ask)
    for vector, score in zip(model.latent(ask), got):
        near = sorted(((float(vector @ v), i) for i, v in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(0.0, min(1.0, c)) ** quality.SHARPNESS * model.weights[i] for c, i in near]
        vote = sum(w * model.labels[i] for w, (_, i) in zip(weights, near))
        assert abs(score - (vote + 1e-3 * model.prior) / (sum(weights) + 1e-3)) < 1e-3


def test_toxic_windows_match_their_compressed_lengths():
    """Scores from lengths that zstandard gives window by window."""
    texts = [(1, b"such a moron and idiot here"), (0, b"plain words of a day")] * 30
    model = toxicity.fit(texts, {1: 30, 0: 30})
    pair = model.compressors()
    for t in (b"the idiot came home with the moron", b"plain words of the day", b""):
        words, windows, now = toxicity.words_of(t), [], b""
        for w in words:
            now += b" " + w
            if len(now) >= toxicity.WINDOW:
                windows.append(now)
                now = b""
        windows += [now] if now else []
        lengths = [[len(c.compress(w + b" " + b"\n" * 10)) for c in pair] for w in windows]
        assert model.gains(t, pair) == [a - b for a, b in lengths]
    assert model.score(b"the idiot came home with the moron", pair) > model.score(b"plain words of the day", pair)


def test_samples_of_repeated_ids_and_long_texts(spark, monkeypatch):
    """An id that all rows share teaches like many; long texts teach by pieces of their whole length."""
    docs = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1)], "doc_id long, toxic int")
    found, sizes = labelled.sample(docs, labels, "toxic", lambda c: F.lit(True), 20)
    assert sizes == {0: 300, 1: 300} and sorted(y for y, _ in found) == [0] * 20 + [1] * 20
    assert langid.train_model(docs, F.lit(True), 40).langs == ["de", "en"]
    long = spark.createDataFrame([("ab" * 100_000 + "end",)], "text string").select(labelled.fitted(F.col("text"))).first()[0]
    assert labelled.FIT_CHARS <= len(long) <= labelled.FIT_CHARS + 100 and long.endswith("end")
