import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import packing, queries

from .helpers import EDGE, edge, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def by_hand(counts, capacity):
    """Best-two-fit over single items, one bin after the other."""
    left, bins = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True), []
    while left:
        own, gap = [], capacity
        for s in list(left):
            if s <= gap:
                own.append(s)
                left.remove(s)
                gap -= s
        if gap and len(own) > 1:
            wide = gap + own[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if own[-1] < a + b <= wide]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a)
                left.remove(b)
                left = sorted([*left, own.pop()], reverse=True)
                own += [a, b]
        bins.append(sorted(own, reverse=True))
    return sorted(bins)


def test_plan_equals_packing_item_by_item():
    random.seed(5)
    for _ in range(300):
        capacity = random.randint(5, 40)
        counts = {s: random.randint(1, 6) for s in random.sample(range(1, capacity + 1), random.randint(1, min(12, capacity)))}
        got = sorted(sorted(own, reverse=True) for own, n in packing.plan(counts, capacity) for _ in range(n))
        assert got == by_hand(counts, capacity)


def test_plans_are_short_and_nearly_full():
    counts = {s: 1 + s * 7919 % 100_003 for s in range(1, 2049)}
    bins = packing.plan(counts)
    total = sum(s * n for s, n in counts.items())
    assert len(bins) < 10_000 and sum(n for _, n in bins) <= 1.02 * -(-total // 2048)
    used = Counter()
    for own, n in bins:
        assert sum(own) <= 2048
        for s in own:
            used[s] += n
    assert used == Counter(counts)
    # Only one item a bin fits: a hot length costs one line of the plan.
    assert packing.plan({1500: 10**12}) == [((1500,), 10**12)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sZ9é.,!_ \n\t\r  　᠎\x1c\x85½中", max_size=20))
def test_stretches_encode_as_the_whole(text):
    encoder = packing.Encoder.of_worker(PATH)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


def test_special_strings_and_a_small_memory(tokenizer):
    encoder = packing.Encoder(PATH, kept=3)
    texts = ["a b <|endoftext|> c", "one two, three; four", "", " ", "x\n\n y  z ", "it's we'll, don't."]
    for _ in range(3):
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [ids_of(tokenizer, t)[:-1] for t in texts]


def test_cuts():
    assert packing.cuts(1, 10) == [(0, 1)] and packing.cuts(10, 10) == [(0, 10)]
    assert packing.cuts(23, 10) == [(0, 3), (3, 10), (13, 10)] and packing.cuts(20, 10) == [(0, 10), (10, 10)]


def check(packed, docs, tokenizer, capacity=2048):
    """Every piece is there with its checksum, and sequences are gapless and no longer than they may be."""
    want = Counter()
    for doc_id, text in docs:
        ids = np.array(ids_of(tokenizer, text), dtype="<u4")
        for piece, (start, n) in enumerate(packing.cuts(len(ids), capacity)):
            want[doc_id, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def test_the_query(spark, small, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    packed = queries.op11_packing(spark, small)
    assert dict(packed.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = packed.collect()
    assert check(rows, docs, tokenizer) <= 1 + 1.02 * sum(r["length"] for r in rows) / 2048
    assert Counter(rows) == Counter(queries.op11_packing(spark, small).collect())


def test_edge_rows(spark, tokenizer):
    rows = packing.pack(edge(spark), PATH).collect()
    check(rows, [(d, t) for d, t, *_ in EDGE], tokenizer)
    assert {r["length"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert packing.pack(empty(spark), PATH).count() == 0
    assert max(r["piece"] for r in rows if r["doc_id"] == 7) >= 48


def test_copies_of_one_length_are_spread(spark, tokenizer):
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("some words that are alike").alias("text"))
    rows = packing.pack(docs, PATH).collect()
    n = len(ids_of(tokenizer, "some words that are alike"))
    assert check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer) == -(-3000 // (2048 // n))


def test_sequences_hold_their_documents_ids(spark, tokenizer):
    packed = packing.pack(edge(spark), PATH, capacity=64, ids=True)
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.sequences(packed).collect()}
    texts = {d: ids_of(tokenizer, t) for d, t, *_ in EDGE}
    for r in packed.collect():
        own = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert own == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]]
