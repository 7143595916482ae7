import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import queries, resampling

from .helpers import EDGE, edge, empty, rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_hand(docs, target, buckets, longest, least_words, percent):
    """(doc_id, n_features, weight, score, rank) one by one."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest))
    t = Counter(bucket(f) for x in target for f in features(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        own = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * (all_s + buckets) / ((s[bucket(f)] + 1) * (all_t + buckets)))) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least_words))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    place = {id(x): k for k, x in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*x[:4], place.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize(("buckets", "longest", "least", "percent"), [(10_000, 1, 20, 10), (97, 2, 5, 33), (64, 3, 1, 100)])
def test_against_brute_force(spark, small, buckets, longest, least, percent):
    docs, target = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    found = resampling.resample(docs, target, buckets=buckets, longest=longest, least_words=least, percent=percent)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = by_hand(texts, [r["text"] for r in target.collect()], buckets, longest, least, percent)
    assert rows(found.select("doc_id", "n_features", "weight", "score", "rank")) == want
    assert any(r[4] for r in want)


def test_the_query_against_its_sql(spark, small):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    found = queries.op12_resampling(spark, small)
    assert set(found.dtypes) == {(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")}
    want = con.execute(queries.oracle_sql()["op12_resampling"])
    names = [c[0] for c in want.description]
    assert rows(found.select(*names)) == sorted(want.fetchall(), key=repr)


def test_chained_checksums():
    words = [b"one", b"two", "dreié".encode(), b"4"]
    want = [zlib.crc32(b" ".join(words[i : i + n])) for n in (2, 3) for i in range(len(words) - n + 1)]
    assert list(resampling.runs(words, 3)) == want and list(resampling.runs([], 3)) == []


def test_edge_rows(spark):
    target = spark.createDataFrame([("word lorem",), (None,), ("",)], "text string")
    found = resampling.resample(edge(spark), target, least_words=1, percent=100)
    want = by_hand([(d, t) for d, t, *_ in EDGE], ["word lorem", None, ""], 10_000, 1, 1, 100)
    drop = lambda x: sorted((r[:4] for r in x), key=repr)
    got = [tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert drop(got) == drop(want) and sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert {r[4] for r in got if r[0] in (1, 2, 3, 8)} == {None}
    assert resampling.resample(empty(spark), target).count() == 0
    assert resampling.resample(edge(spark), target.limit(0)).count() == len(EDGE)
    kept = resampling.keep_drawn(edge(spark), target, least_words=1, percent=100)
    assert kept.columns == edge(spark).columns and kept.count() == len(EDGE) - 4


def test_equal_scores_are_spread_and_ranked_by_id(spark):
    docs = spark.range(5000).select((F.col("id") % 7).alias("doc_id"), F.concat(F.lit("word " * 20), F.col("id") % 3).alias("text"))
    ranked = resampling.resample(docs, docs.limit(1)).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 501))
    assert all((-a["score"], a["doc_id"]) <= (-b["score"], b["doc_id"]) for a, b in zip(ranked, ranked[1:]))
