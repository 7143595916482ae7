import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import collocations, queries
from lodestar.llm.fmindex import Index

from .helpers import EDGE, edge, empty, rows

ALL = lambda a, b: np.ones(len(a), dtype=bool)


def phrases_of(symbols, size):
    windows = (symbols[i : i + size] for i in range(len(symbols) - size + 1))
    return Counter(tuple(w.tolist()) for w in windows if (w > 0).all())


def counted(p):
    return dict(zip(map(tuple, p.words.tolist()), p.n.tolist()))


@pytest.mark.parametrize("seed", range(40))
def test_extensions_in_both_directions(seed):
    rng = np.random.default_rng(seed)
    symbols = np.append(rng.integers(0, rng.integers(2, 9), rng.integers(0, 200)), 0)
    index = Index.view(Index.of(symbols, 4).pack())
    pairs = index.phrases(ALL)
    assert counted(pairs) == phrases_of(symbols, 2)
    for first in (True, False):
        three = index.extended(pairs, first, ALL)
        assert counted(three) == phrases_of(symbols, 3)
        for then in (True, False):
            assert counted(index.extended(three, then, ALL)) == phrases_of(symbols, 4)


def test_pruned_extensions_keep_what_is_allowed():
    rng = np.random.default_rng(1)
    symbols = np.append(rng.integers(0, 5, 400), 0)
    index = Index.of(symbols, 4)
    allowed = lambda a, b: (a + b) % 3 > 0
    four = index.extended(index.extended(index.phrases(allowed), True, allowed), False, allowed)
    fit = lambda w: all((a + b) % 3 > 0 for a, b in zip(w, w[1:]))
    assert counted(four) == {w: n for w, n in phrases_of(symbols, 4).items() if fit(w)}


def by_hand(docs, longest, least, most, inside):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in {k for k, _ in f}:
        rows = []
        own = {p: v for (k, p), v in f.items() if k == lang}
        for p, a in own.items():
            if len(p) < 2:
                continue
            longer = [q for q in own if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * own[q] >= inside * a for q in longer):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def corpus(spark, n=60):
    rng = np.random.default_rng(7)
    words = np.array(["New", "york", "city", "of", "the", "a", "café", "x1", "Été", "-"])
    ends = np.array([" ", "  ", "\t", ". ", ",", "\n", "\r\n", ":"])
    made = []
    for i in range(n):
        own = "".join(w + e for w, e in zip(rng.choice(words, 120, p=[0.2, 0.15, 0.1, *[0.55 / 7] * 7]), rng.choice(ends, 120, p=[0.7, *[0.3 / 7] * 7])))
        made.append((["en", "de", None, ""][i % 4], own))
    return spark.createDataFrame([*made, ("en", None), ("en", ""), ("fr", " . , ")], "lang string, text string")


@pytest.mark.parametrize(("longest", "least", "most", "inside", "shard"), [(4, 30, 2000, 80, 4_000_000), (4, 3, 20, 60, 500), (2, 5, 2000, 80, 1), (3, 1, 5000, 80, 2000), (5, 2, 5000, 90, 700)])
def test_against_brute_force(spark, longest, least, most, inside, shard):
    docs = corpus(spark)
    found = collocations.collocations(docs.repartition(3), longest=longest, least=least, most=most, inside=inside, shard_words=shard)
    want = by_hand([tuple(r) for r in docs.collect()], longest, least, most, inside)
    assert rows(found) == want and want


def test_hot_words_are_dealt_out_in_parts(spark, monkeypatch):
    """Phrases of words above any of the thresholds meet in the part that their last word tells, in every shard."""
    monkeypatch.setattr(collocations, "PARTS", ((40, 3), (400, 7)))
    monkeypatch.setattr(collocations, "ROWS", 5)
    docs = corpus(spark)
    found = collocations.collocations(docs.repartition(3), least=3, shard_words=700)
    assert rows(found) == by_hand([tuple(r) for r in docs.collect()], 4, 3, 2000, 80)


def test_rare_phrases_are_not_sent(spark, monkeypatch):
    """Phrases of frequent words that are rare themselves stay in their shards; a sketch of their slots tells."""
    sent, summed = [], collocations._summed

    def counting(shards, of, least):
        lists = collocations._each(shards, of, "lang string, first string, part int, tails string, n array<int>")
        sent.append(lists.agg(F.sum(F.size("n"))).first()[0] or 0)
        return summed(shards, of, least)

    monkeypatch.setattr(collocations, "_summed", counting)
    monkeypatch.setattr(collocations, "SLICE", 1 << 9, raising=False)
    rng = np.random.default_rng(3)
    made = [("en", " ".join(f"w{k}" for k in rng.integers(0, 150, 500)) + ". red green blue pink") for _ in range(40)]
    docs = spark.createDataFrame(made, "lang string, text string")
    found = collocations.collocations(docs.repartition(2), shard_words=5000)
    assert rows(found) == by_hand(made, 4, 30, 2000, 80)
    # Of some 18,000 pairs of frequent words, distinct in their shard, few are of those three that occur 30 times.
    assert 0 < sent[0] < 300 and 0 < sent[1] < 300


def test_phrases_between_two_words_are_dealt_out(spark, monkeypatch):
    """Phrases that begin with one hot word and end with one word are no single list: lists that meet are held together."""
    longest, summed = [], collocations._summed

    def measured(shards, of, least):
        lists = collocations._each(shards, of, "lang string, first string, part int, tails string, n array<int>")
        longest.append(lists.agg(F.max(F.size("n"))).first()[0])
        return summed(shards, of, least)

    monkeypatch.setattr(collocations, "_summed", measured)
    monkeypatch.setattr(collocations, "PARTS", ((40, 8),))
    made = [("en", ". ".join(f"from m{k} to" for k in range(60)))] * 30
    docs = spark.createDataFrame(made, "lang string, text string")
    assert rows(collocations.collocations(docs.repartition(2), shard_words=500)) == by_hand(made, 4, 30, 2000, 80)
    assert longest[1] < 30


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_lists_are_summed_up_as_lists(spark, monkeypatch, batch):
    """What shards send is no row for each phrase and shard, and lists of one word are summed up over batches."""
    plans, checkpointed = [], collocations.checkpointed
    monkeypatch.setattr(collocations, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().toString()) or checkpointed(df))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, batch)
    try:
        docs = corpus(spark, 40)
        found = collocations.collocations(docs.repartition(3), least=3, shard_words=1)
        assert rows(found) == by_hand([tuple(r) for r in docs.collect()], 4, 3, 2000, 80)
    finally:
        spark.conf.set(size, before)
    assert len(plans) == 6 and not [p for p in plans if "Generate" in p]


@pytest.mark.parametrize("least", [1, 5, 100])
def test_sums_of_lists(least):
    """Sums of random lists, also of slices of a batch, are those of their phrases one by one."""
    rng = np.random.default_rng(5)
    made = [("ab"[rng.integers(2)], "xy"[rng.integers(2)], 0, [f"{k} {k}" for k in rng.permutation(9)[: rng.integers(1, 9)]]) for _ in range(60)]
    ns = [rng.integers(1, 4, len(tails)).astype(np.int32) for *_, tails in made]
    batch = pa.RecordBatch.from_pylist(
        [{"lang": a, "first": b, "part": c, "tails": "\n".join(d), "n": n.tolist()} for (a, b, c, d), n in zip(made, ns)],
        pa.schema([("lang", pa.string()), ("first", pa.string()), ("part", pa.int32()), ("tails", pa.string()), ("n", pa.list_(pa.int32()))]),
    )
    want = Counter()
    for (lang, first, _, tails), n in list(zip(made, ns))[7:]:
        for tail, k in zip(tails, n.tolist()):
            want[lang, f"{first} {tail}"] += k
    found = collocations._added(pa.Table.from_batches([batch[7:20], batch[20:]]), least).to_pylist()
    assert sorted((x["lang"], x["phrase"], x["f"]) for x in found) == sorted((*k, f) for k, f in want.items() if f >= least)


def test_the_query_against_its_sql(spark, medium):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{medium}/documents.parquet'")
    found = queries.op13_collocations(spark, medium)
    assert all(kind == ("string" if c in ("lang", "phrase") else "bigint") for c, kind in found.dtypes)
    want = con.execute(queries.oracle_sql()["op13_collocations"])
    assert rows(found.select(*(c[0] for c in want.description))) == sorted(want.fetchall(), key=repr)


def test_edge_rows(spark):
    docs = edge(spark).withColumn("phrase", F.lit("x")).withColumn("lang_", F.lit("x"))
    found = collocations.collocations(docs, least=2)
    assert rows(found) == by_hand([(lang, t) for _, t, lang, _ in EDGE], 4, 2, 2000, 80)
    assert collocations.collocations(empty(spark)).count() == 0
    assert collocations.collocations(edge(spark).withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_products_beyond_64_bits(spark):
    """Scores of counts whose products with 2,000,000 pass 2**63."""
    df = spark.createDataFrame([(9 * 10**15, 10**16, 9 * 10**15 + 1)], "a long, l long, r long")
    got = df.select(F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")).first()[0]
    assert got == 2_000_000 * 9 * 10**15 // (19 * 10**15 + 1)
