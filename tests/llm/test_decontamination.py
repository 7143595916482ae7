import hashlib
import random
import re

import pytest

from lodestar.llm import decontamination

from .helpers import EDGE, edge, empty


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(i, tuple(w[s : s + n])) for s in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit |= set(range(s, s + len(x)))
                    found |= {str(i)} if i is not None else set()
        listed = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "É", "é", "It", "c-d", "7"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 14, 25]))) for i in range(12)] + [(None, text(11)), (3, None), (20, "a b"), (20, "a b")]
    docs = [(i, text(rng.randrange(60))) for i in range(25)] + [(99, f"x y {items[4][1]} z"), (None, text(30)), (5, text(30)), (98, None), (97, "")]
    got = decontamination.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted((tuple(r) for r in got.drop("mark").collect()), key=repr) == brute(docs, items)


def test_plain_path_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    items, docs = [(i, text(13)) for i in range(5)], [(i, text(200)) for i in range(10)]
    docs.append((50, "q " + items[0][1] + " r"))
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.drop("mark").collect()), key=repr) == brute(docs, items)


def test_positions_are_shuffled_without_their_texts(spark, small, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
    # Without it, Spark itself broadcasts what is small here.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{small}/documents.parquet")
        words_of = docs.select("doc_id", decontamination.words(docs["text"]).alias("w"))
        windows = decontamination.numbered(decontamination.windows_of(spark.read.parquet(f"{small}/benchmark.parquet")))
        plan = decontamination.hits(words_of, windows, "doc_id")._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(h#" in line]
    assert below and not any(re.search(r"[\[ ]w#\d+[,\]]", line) for line in below)
    assert not any("Python" in line or "Arrow" in line for line in plan)


def test_edge_rows(spark):
    items = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet"), (2, None), (3, "")], "item_id long, text string")
    found = decontamination.contamination(edge(spark), items).collect()
    assert len(found) == len(EDGE)
    by = {r["doc_id"]: r for r in found}
    assert by[7]["n_hit"] == by[7]["n_words"] == 100_000 and by[7]["n_items"] == 1
    assert all(not r["contaminated"] for r in found if r["doc_id"] != 7)
    assert decontamination.contamination(empty(spark), items).count() == 0
    assert all(not r["contaminated"] for r in decontamination.contamination(edge(spark), items.limit(0)).collect())
    kept = decontamination.keep_clean(edge(spark), items)
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE) - 1
    assert decontamination.keep_clean(edge(spark), items.limit(0)).count() == len(EDGE)
