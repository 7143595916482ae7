import random
import re

import pytest
import xxhash

from lodestar.llm import simhash
from lodestar.llm.components import components

from .helpers import EDGE, Groups, edge, empty, rows


def brute_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("k", [3, 5])
def test_fingerprints_match_brute_force(k):
    rng = random.Random(k)
    texts = [t for _, t, *_ in EDGE if t is None or len(t) < 1000]
    texts += [" ".join(rng.choice(["Ab", "c", "É", "dd"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    for t in texts:
        assert simhash.fingerprint_of(None if t is None else t.encode(), k) == brute_print(t, k)


def test_blocks_of_very_long_texts():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint_of(text.encode(), 3) == brute_print(text, 3)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_connect_what_is_within_two_bits(spark, bucket):
    rng = random.Random(bucket)
    prints = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(8):
            prints.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                at ^= 1 << b
    hot = rng.getrandbits(32) << 32
    prints |= {hot | (1 << a) | (1 << b) for a in range(6) for b in range(a + 1, 6)}
    groups = Groups(prints)
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 2:
                groups.join(a, b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = Groups(prints)
    for a, b in simhash.links(df, bucket).collect():
        assert (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 2
        got.join(a % (1 << 64), b % (1 << 64))
    assert {p: got.find(p) for p in prints} == {p: groups.find(p) for p in prints}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 170)] + [(5, i) for i in range(6, 40)] + [(7, 7), (8, 8), (None, 3), (50, 5), (5, 50)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 100 for i in range(100, 171)}, **{i: 5 for i in [*range(5, 40), 50]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edge_rows(spark):
    found = rows(simhash.near_duplicates(edge(spark)))
    assert len(found) == len(EDGE)
    by = {}
    for doc_id, fp, component in found:
        by.setdefault(doc_id, set()).add((fp, component))
    assert {c for d in (1, 2, 3, 8) for _, c in by[d]} == {1} and {f for f, _ in by[2]} == {0}
    assert {c for d in (5, 6) for _, c in by[d]} == {5}
    assert rows(simhash.near_duplicates(empty(spark))) == []


def test_one_document_of_each_group_stays(spark):
    kept = simhash.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 5, 7, 9]
    assert simhash.keep_one(empty(spark)).count() == 0


def near_copies(rng, n_words, changes, copies):
    words = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for i in rng.sample(range(n_words), changes):
            own[i] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket", [4, 64])
def test_near_copies_go_and_clean_documents_stay(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (bucket,))
    rng = random.Random(bucket)
    groups = [near_copies(rng, 300, changes, copies) for changes, copies in ((2, 60), (3, 20), (4, 5), (4, 5), (1, 3))]
    clean = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))) for _ in range(60)]
    assert min(jaccard(g[0], t) for g in groups for t in g) >= 0.8
    texts = [t for g in groups for t in g] + clean
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = 0
    for g in groups:
        assert len(kept & set(range(at, at + len(g)))) == 1 and at in kept
        at += len(g)
    assert set(range(at, len(texts))) <= kept


def kept_by_brute_force(texts):
    groups = Groups(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8:
                groups.join(a, b)
    return {groups.find(i) for i in range(len(texts))}


def test_only_similar_texts_are_one_group(spark):
    """Pairs a little above and below 0.8: a fingerprint cannot tell them, their shingles can."""
    rng = random.Random(7)
    texts = [t for changes in (5, 6, 7, 8, 9, 10, 12) for _ in range(12) for t in near_copies(rng, 300, changes, 1)]
    above = sum(jaccard(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2]))
    assert 12 <= above <= 72
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == kept_by_brute_force(texts)


def test_several_groups_under_one_full_key(spark, monkeypatch):
    """Texts of one template, at 0.6 to each other, in groups of near copies: all groups are found within full bands."""
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3,))
    rng = random.Random(8)
    template = [f"t{i}" for i in range(300)]
    texts = []
    for g in range(20):
        base = [*template, *(f"g{g}x{i}" for i in range(80))]
        for _ in range(3):
            own = list(base)
            own[rng.randrange(300, 380)] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == kept_by_brute_force(texts) and len(kept) == 20


def test_query_against_brute_force(spark, small):
    from lodestar.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: brute_print(r["text"], 3) for r in docs}
    groups = Groups(sorted(prints))
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    got = rows(queries.op1_simhash(spark, small).select("doc_id", "fingerprint", "component_id"))
    assert got == sorted(((d, f"{p:016x}", groups.find(d)) for d, p in prints.items()), key=repr)


def _groups(pairs):
    found = []
    for pair in pairs:
        touched = [g for g in found if g & set(pair)]
        found = [g for g in found if g not in touched] + [set(pair).union(*touched)]
    return found


def test_near_copies_are_found_by_their_fingerprints_alone(spark):
    """Without any band, sets whose fingerprints link are candidates, and stay linked only where the sets are alike."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    texts = []
    for k in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], f"other{k}"]), " ".join(words + words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = docs.select("doc_id", simhash._banded(F.col("text"), 5).alias("s")).select("doc_id", "s.*")
    rows = made.collect()
    found = {(r["a"], r["b"]) for r in simhash.fingerprint_pairs(made.select("fp", "id")).collect()}
    want = {(x["id"], y["id"]) for x in rows for y in rows if x["id"] < y["id"] and ((x["fp"] ^ y["fp"]) & (2**64 - 1)).bit_count() <= 2}
    joined = lambda pairs: {frozenset(g) for g in _groups(pairs)}
    assert found <= want and joined(found) == joined(want) and want
    prints = made.dropDuplicates(["id"]).withColumn("keys", F.array().cast("array<long>"))
    of = {r["id"]: sorted({int(x) for x in simhash.shingle_set(texts[r["doc_id"]].encode(), 5)}) for r in rows}
    hashed = spark.createDataFrame([(k, [(x & 0xFFFFFFFF) - (1 << 31) for x in v]) for k, v in of.items()], "id long, hashes array<int>")
    edges = simhash.near_links(prints, lambda ids: hashed.join(ids, "id"), simhash.fingerprint_pairs(made.select("fp", "id"))).collect()
    assert {(r["a"], r["b"]) for r in edges} == {p for p in found if len(set(of[p[0]]) & set(of[p[1]])) * 9 >= 4 * (len(of[p[0]]) + len(of[p[1]]))}
