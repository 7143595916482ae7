"""Look-ups of points and overlaps of intervals against plain loops, and on one very large script."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import captions as K


def made(seed, n=60):
    rng = random.Random(seed)
    num = lambda top: rng.choice([rng.randrange(top), rng.random() * top])
    cues = []
    for i in range(n):
        start = float(num(50))
        cues.append((i % 3, start, start + rng.choice([0.0, -1.0, 0.5, 3.0, num(40)]), rng.choice(["a", "b", " ", "c"])))
    sections = [(i % 3, i, float(num(45)), rng.choice([0.0, 1.0, 7.5, float(num(30))])) for i in range(n // 3)]
    points = [(rng.randrange(4), float(rng.choice([num(60), cues[rng.randrange(n)][1], cues[rng.randrange(n)][2]]))) for _ in range(n)]
    return cues, sections, points


@pytest.mark.parametrize("seed", range(4))
def test_against_loops(spark, seed):
    cues, sections, points = made(seed)
    c = spark.createDataFrame(cues, "script_id int, start double, end double, text string")
    s = spark.createDataFrame(sections, "script_id int, section_id int, start double, duration double")
    p = spark.createDataFrame(points, "script_id int, at double")
    captions = {(r["script_id"], r["at"]): r["caption"] for r in K.caption_at(p, c, "script_id", "at").collect()}
    found = {(r["script_id"], r["at"]): r["section_id"] for r in K.section_at(p, s, "script_id", "at").collect()}
    for k, at in set(points):
        hold = sorted((a, b, t) for x, a, b, t in cues if x == k and a <= at < b)
        assert captions[k, at] == (hold[0][2] if hold else "")
        own = sorted((a, i) for x, i, a, d in sections if x == k and a <= at < a + d)
        last = max(((a, i) for x, i, a, d in sections if x == k), default=(0, None))
        assert found[k, at] == (own[0][1] if own else last[1])
    assert len(captions) == len(found) == len(set(points))
    want = []
    for k, i, s0, d in sections:
        own = sorted((a, b, t) for x, a, b, t in cues if x == k and b > s0 and a < s0 + d and t.strip() and min(d, b - s0) > max(0.0, a - s0))
        want += [(k, i, n, max(0.0, a - s0), min(d, b - s0), t) for n, (a, b, t) in enumerate(own, 1)]
    assert sorted(tuple(r) for r in K.clip_cues(c, s, "script_id").collect()) == sorted(want)


def test_one_large_script(spark):
    """100,000 cues, sections and points of one script: rows met stay in proportion."""
    n = 100_000
    c = spark.range(n).select(F.lit(1).alias("script_id"), (F.col("id") * 0.5).alias("start"), (F.col("id") * 0.5 + 0.4).alias("end"), F.col("id").cast("string").alias("text"))
    s = spark.range(n // 2).select(F.lit(1).alias("script_id"), F.col("id").alias("section_id"), (F.col("id") * 1.0).alias("start"), F.lit(1.0).alias("duration"))
    p = c.select("script_id", (F.col("start") + F.when(F.col("start") % 2 == 0, 0.1).otherwise(0.45)).alias("at"))
    by_half = K.caption_at(p, c, "script_id", "at").agg(F.count_if(F.col("caption") == ""), F.count("*")).first()
    assert tuple(by_half) == (3 * n // 4, n)
    sections = K.section_at(p, s, "script_id", "at").filter(F.col("section_id") != F.floor("at")).count()
    assert sections == 0 and K.clip_cues(c, s, "script_id").count() == n
    met = K._met(c, "start", s.withColumn("s1", F.col("start") + 1).withColumnsRenamed({"start": "s0"}), "s0", "s1", "script_id").count()
    assert met <= 5 * n


def filled(rule, duration, items, opening=None):
    """Segments one after the other. items: (path, seconds or None for an image)."""
    out, at = [], 0.0
    if opening and duration > 0:
        at = min(3.0, max(duration, 0.1))
        out.append((opening, 0.0, at))
        items = [i for i in items if i[0] != opening] or items
    if rule == "whole":
        items = [i for i in items if i[1]]
    rest, most = {"even": (0.05, 20 * len(items) + 1), "whole": (0.0, 201), "stills": (0.01, 10**9)}[rule]
    k, base = 0, at
    while items and at < duration - rest and k < most:
        path, own = items[k % len(items)]
        step = {"even": max((duration - base) / len(items), 1.5), "whole": own, "stills": 2.5 if own is None else max(own, 0.1)}[rule]
        take = min(step, duration - at)
        out.append((path, at, take))
        at, k = at + take, k + 1
    return out


def test_segments_against_a_loop(spark):
    rng = random.Random(8)
    sections = [(s, k, rng.choice([0.0, 0.25, 3.0, 7.5, 30.0, 61.0])) for s in range(4) for k in range(6)] + [(9, 0, 5000.0), (9, 1, 300.0)]
    media = {key: [(f"p{rng.randrange(4)}-{i}", rng.choice([None, 0.5, 2.0, 4.0])) for i in range(rng.choice([0, 1, 2, 4]))] for key in [x[:2] for x in sections]}
    media[9, 0], media[9, 1] = [("a", 0.5), ("b", None)], [("c", 0.0), ("d", None)]
    openings = {(s, 0): media[s, 0][0][0] for s in range(4) if media[s, 0]} | {(9, 1): "c"}
    s = spark.createDataFrame(sections, "script_id int, section_id int, seconds double")
    rows = [(*key, i, p, "image" if x is None else "video", x) for key, items in media.items() for i, (p, x) in enumerate(items)]
    m = spark.createDataFrame(rows, "script_id int, section_id int, pos int, path string, kind string, seconds double")
    o = spark.createDataFrame([(*k, p) for k, p in openings.items()], "script_id int, section_id int, path string")
    for rule in K.RULES:
        for opened in (None, o) if rule == "even" else (None,):
            got = {}
            for r in K.fill_segments(m, s, rule, opened).collect():
                got.setdefault((r["script_id"], r["section_id"]), []).append((r["segment"], r["path"], r["start"], r["length"]))
            for a, b, duration in sections:
                # Where items last 0.1 seconds, sums in another order differ in the last bits.
                want = filled(rule, duration, media[a, b], openings.get((a, b)) if opened is not None else None)
                own = sorted(got.get((a, b), []))
                assert [x[0] for x in own] == list(range(len(want))) and [x[1] for x in own] == [x[0] for x in want]
                assert all(abs(x[2] - y[1]) < 1e-6 and abs(x[3] - y[2]) < 1e-6 for x, y in zip(own, want))
