import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import lm
from lodestar.llm.eliasfano import EliasFano, Trie

from .helpers import EDGE, edge, empty

numbers = st.lists(st.integers(0, 1 << 40), max_size=300).map(sorted)


@settings(max_examples=150, deadline=None)
@given(numbers, st.lists(st.integers(0, 1 << 40), min_size=1, max_size=50), st.integers(0, 300), st.integers(0, 300))
def test_sequences_round_trip_and_find_successors(values, wanted, first, end):
    v = np.array(values, dtype=np.int64)
    ef = EliasFano.of(v, (1 << 40) + 1)
    assert (ef.get(np.arange(len(v))) == v).all()
    first, end = sorted((min(first, len(v)), min(end, len(v))))
    x = np.array(wanted, dtype=np.int64)
    got = ef.successor(x, np.full(len(x), first), np.full(len(x), end))
    assert (got == first + np.searchsorted(v[first:end], x)).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=200))
def test_tries_answer_for_every_pair(pairs):
    span, pairs = 61, sorted(pairs)
    values = np.array([(a * 7 + b) % 50 / 10 + 0.1 for a, b in pairs])
    a, b = (np.array([p[k] for p in pairs], dtype=np.int64) for k in (0, 1))
    trie = Trie.view(Trie.of(a, b, values, span, 42.0).pack())
    x, y = (g.reshape(-1) for g in np.meshgrid(np.arange(span), np.arange(span), indexing="ij"))
    want = dict(zip(pairs, values))
    for u, v, got in zip(x.tolist(), y.tolist(), trie.found(x, y) / 42):
        assert abs(got - want.get((u, v), 0.0)) <= 0.5 / 42 + 1e-9


def brute(texts):
    """(base, score, known, length) of each text by dictionaries, the training tokens, and the step of a code."""
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    c, pairs, contexts = Counter(), Counter(), Counter()
    for i in train:
        c.update(tokens[i])
        pairs.update(zip([None, *tokens[i]], tokens[i]))
        contexts.update([None, *tokens[i][:-1]])
    n, v = sum(c.values()), len(c)
    whole = n + 0.5 * (v + 1)
    p1 = lambda w: (c[w] + 0.5) / whole
    out = {}
    for i, ts in tokens.items():
        base = sum(math.log10(p1(w)) for w in ts)
        score = sum(math.log10((pairs[a, b] + lm.PRIOR * p1(b)) / (contexts[a] + lm.PRIOR)) for a, b in zip([None, *ts], ts))
        out[i] = (base, score, sum(c[w] > 0 for w in ts), len(ts))
    return out, n, math.log10(1 + whole / lm.PRIOR) / 255


@pytest.mark.parametrize("frequent", [20, 500, lm.FREQUENT])
def test_scores_match_brute_force(spark, small, frequent):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want, n, step = brute({r["doc_id"]: r["text"] for r in docs.collect()})
    for r in lm.language_scores(docs, frequent_words=frequent).collect():
        base, score, known, length = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (length, known, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        # What each pair adds is quantised.
        assert abs(r["score"] - score) <= 0.5 * step * length + 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_several_shards_and_batches_give_the_same(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    key = lambda df: {str(r["doc_id"]): (round(r["base_score"], 6), round(r["score"], 6), r["n_known"]) for r in df.collect()}
    one = key(lm.language_scores(docs))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 9000)
    monkeypatch.setattr(lm, "BATCH_TOKENS", 3000)
    monkeypatch.setattr(lm, "MOST_TOKENS", 3000)
    monkeypatch.setattr(lm, "COUNTED", 2000)
    assert key(lm.language_scores(docs, frequent_words=300)) == one
    # Ids as text give the same folds and scores.
    assert key(lm.language_scores(docs.withColumn("doc_id", docs["doc_id"].cast("string")))) == one


def test_probabilities_of_all_words_sum_to_one():
    u = lm.Unigrams(np.array([5, 9, lm.END]), np.array([4, 3, 2]), 9, 3, 2)
    words = np.array([4, 3, 2, 0])  # the last stands for all unknown words
    assert math.isclose((10 ** u.log_p(words)).sum(), 1.0)
    pairs = np.array([2, 0, 2, 0])  # of the successors of word 0, which occurs 4 times
    gains = u.gain(pairs, words)
    p = 10 ** (u.backoff(np.array([4])) + u.log_p(words) + gains)
    assert math.isclose(p.sum(), 1.0)
    quantised = np.rint(gains * u.scale) / u.scale
    assert gains.max() * u.scale <= 255
    assert abs((10 ** (u.backoff(np.array([4])) + u.log_p(words) + quantised)).sum() - 1) < 0.01


def test_edge_rows(spark):
    found = lm.language_scores(edge(spark)).collect()
    assert len(found) == len(EDGE)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3, 8)} == {1}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found)
    assert lm.language_scores(empty(spark)).count() == 0
    alone = lm.language_scores(edge(spark).filter("doc_id = 4")).collect()
    assert len(alone) == 1
