import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import audit as A
from lodestar.operators import captions as K
from lodestar.operators import fingerprints as H
from lodestar.operators import gates as G
from lodestar.operators import media as M
from lodestar.operators import ranking as P
from lodestar.operators import similarity as S
from lodestar.plans import fixtures as X
from lodestar.plans import pipelines as E

# Pairs of topics and whether they are similar.
SIMILAR = [
    ("harbour bridge", "Harbour bridge repairs begin", True), ("glacier retreat", "glacier RETREAT measured", True),
    ("quiet violin solo", "violin solo, quiet", True), ("tidal turbine", "turbine tidal", True), ("green lantern kites", "lantern kites over sand", True),
    ("orchard", "apple orchard", True), ("orchard", "apple harvest", False), ("walnut desk", "cedar desk", False),
    ("k m p", "k r s", False), ("k m p", "k m s", True), ("", "", False), ("", "orchard", False), ("orchard", "", False),
    ("comet's tail", "tail of a comet", True), ("river_delta", "delta river", True), (None, "orchard", False), ("orchard", None, False),
    ("moss moss moss", "moss garden", True),
]

GOOD = dict(domain="MOVIE", subject="s", evidence="e", relevant="true", reason="r")
# Verdicts that differ from a good one, and whether they pass.
VERDICTS = [
    ({}, True), (dict(domain="ANIME", relevant="false", reason=""), True), (dict(domain="anime "), True),
    *((dict(domain=d), False) for d in ("GENERAL_TREND", "POLITICS", "SPORTS", "TECHNOLOGY", "BUSINESS", "GOSSIP", "OTHER", "", None)),
    *((dict(relevant=r), False) for r in ("false", '"true"', None)),
    (dict(reason=""), False), (dict(subject=""), False), (dict(evidence=""), False), (dict(evidence=None), False),
]


def test_similar_topics(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(SIMILAR)]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    found = {tuple(r) for r in S.similar_pairs(df, df, "i", "a", "i", "b").collect()}
    assert [(i, i) in found for i in range(len(SIMILAR))] == [expected for *_, expected in SIMILAR]


def test_similar_pairs_match_brute_force(spark):
    import random

    rng = random.Random(5)
    side = lambda n: [(i, " ".join(rng.choice("bcdfghjk") * 2 for _ in range(rng.randrange(4)))) for i in range(n)]
    left, right = side(120), side(90)
    want = set()
    for i, a in left:
        for j, b in right:
            x, y = set(a.split()), set(b.split())
            if x and y and len(x & y) >= min(2, len(x), len(y)):
                want.add((i, j))
    a, b = (spark.createDataFrame(x, "i long, t string") for x in (left, right))
    assert {tuple(r) for r in S.similar_pairs(a, b, "i", "t", "i", "t").collect()} == want
    used = b.select(F.col("i").alias("j"), F.col("t").alias("u")).filter("j < 6")
    hit = {i for i, j in want if j < 6}
    assert {r["i"] for r in S.semi_similar(a, used, "i", "t", "j", "u").collect()} == hit
    assert {r["i"] for r in S.anti_similar(a, used, "i", "t", "j", "u").collect()} == {i for i, _ in left} - hit


def test_existence_makes_no_pairs(spark):
    """A word pair that all titles share costs a semi-join its rows, not their product."""
    same = spark.range(3000).select("id", F.lit("harbour bridge").alias("t"))
    used = same.select(F.col("id").alias("j"), F.col("t").alias("u"))
    found = S._similar_ids(same, used, "id", "t", "j", "u")
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 3000


def test_near_clips_match_brute_force(spark):
    import random

    rng = random.Random(9)
    base = [rng.getrandbits(63) for _ in range(6)]
    near = lambda x: x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(8)))
    frames = {c: [base[0] if rng.random() < 0.4 else near(rng.choice(base)) for _ in range(rng.randrange(1, 6))] for c in range(40)}
    want = set()
    for a, x in frames.items():
        for b, y in frames.items():
            share = sum(any((f ^ g).bit_count() <= 6 for g in y) for f in x) / len(x)
            if a != b and share >= 0.5:
                want.add((a, b, share))
    rows = [(c, i, f) for c, fs in frames.items() for i, f in enumerate(fs)] + [(0, 9, None)]
    df = spark.createDataFrame(rows, "clip long, frame int, h long")
    assert {tuple(r) for r in H.near_dup_clips(df).collect()} == want
    assert H.near_dup_clips(df.limit(0)).count() == 0


@pytest.mark.parametrize("change,expected", VERDICTS)
def test_verdicts(spark, change, expected):
    v = GOOD | change
    c = [F.lit(v[k]).cast("string") for k in ("domain", "subject", "evidence", "relevant", "reason")]
    assert spark.range(1).select(G.verdict_ok(*c).alias("ok")).first()["ok"] is expected


def test_batches(spark):
    ranked = spark.range(1, 101).withColumnRenamed("id", "rank")
    assert G.gate_batches(ranked, F.col("rank") == 61, 20, 4).first()["batch"] == 4
    assert G.gate_batches(ranked, F.col("rank") == 81, 20, 4).count() == 0
    assert G.gate_batches(ranked, F.lit(False), 10, 3).count() == 0


def test_duplicates_keep_the_best(spark):
    rows = [("a", 1.0, "B"), ("a", 2.0, "C"), ("a", 2.0, "B"), ("b", 0.0, "A")]
    df = spark.createDataFrame(rows, "video_id string, trend_score double, source string")
    assert sorted(tuple(r) for r in P.dedupe_best(df).collect()) == [("a", 2.0, "B"), ("b", 0.0, "A")]
    assert {r["source"] for r in P.dedupe_best(df, keep="first").collect()} == {"A", "B"}


def test_near_hashes_match_brute_force(spark, small):
    fp = X.fp(spark, small).cache()
    h = sorted({r["h"] for r in fp.collect()})
    want = {(a, b) for a in h for b in h if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 6}
    assert {(r["a"], r["b"]) for r in H.near_hashes(fp).collect()} == want and want


def test_exact_quotas_reuse_what_a_quota_left(spark):
    rows = [(1, 1, 1, 1, p, i) for p, i in enumerate((10, 11, 12))] + [(1, 2, 1, 1, 0, 12)]
    df = spark.createDataFrame(rows, "script_id long, section_id long, tier int, query int, pos int, item long")
    exact = {(r["section_id"], r["item"]) for r in M.allocate_exact(df, 2).collect()}
    bulk = {(r["section_id"], r["item"]) for r in M.quota_first_n(df, 2).collect()}
    assert exact == {(1, 10), (1, 11), (2, 12)} and bulk == {(1, 10), (1, 11)}


def test_cues_cover_the_text(spark):
    df = spark.createDataFrame([(1, "One two three four five six seven. Eight nine… Ten!", 5000)], "k long, t string, ms long")
    cues = K.proportional_cues(df, ["k"], "t", "ms").orderBy("cue").collect()
    assert [c["text"] for c in cues] == ["One two three four five six", "seven.", "Eight nine…", "Ten!"]
    assert cues[0]["start_ms"] == 0 and cues[-1]["end_ms"] == 5000
    assert all(a["end_ms"] <= b["start_ms"] + 1 for a, b in zip(cues, cues[1:]))


def test_strict_topic_lock(spark):
    row = [("x", "zeta topic", "other trend", "", "", ["point"], "MOVIE", "RECAP")]
    df = spark.createDataFrame(row, "id string, topic string, source_trend string, hook_question string, content_angle string, key_points array<string>, content_domain string, content_type string")
    assert A.audit_research(df).first()["violations"] == []
    assert A.audit_research(df, strict=True).first()["violations"] == ["topic drifted"]


def test_captions_end_to_end(spark, small):
    out = E.build_captions(X.sections(spark, small), max_words=80).collect()
    assert out and all(r["coverage"] == 100.0 and not r["short"] for r in out)
    assert all(r["srt"].startswith("1\n00:00:00,000 --> ") and r["srt"].count(" --> ") == r["n_cues"] for r in out)


def test_verdicts_on_unknown_ids_are_an_error(spark):
    ranked = spark.createDataFrame([("1", "a title", 5, 2.0, "A")], "video_id string, title string, views long, trend_score double, source string")
    cands = ranked.withColumn("description", F.lit("")).withColumn("published_at", F.expr("TIMESTAMP '2024-01-31 00:00:00'"))
    history = spark.createDataFrame([(1, "something else")], "item_id long, topic string")
    rows = [("1", "ANIME", "s", "e", "true", "r", "RECAP"), (None, "ANIME", "s", "e", "true", "r", "RECAP")]
    schema = "candidate_id string, content_domain string, niche_subject string, niche_evidence string, us_movie_relevant string, us_relevance_reason string, content_type string"
    assert E.best_trend(cands, history, spark.createDataFrame(rows, schema), X.AS_OF, ("zz",)).count() == 1
    unknown = spark.createDataFrame([*rows, ("2", *rows[0][1:])], schema)
    with pytest.raises(ValueError, match="unknown candidate: 2"):
        E.best_trend(cands, history, unknown, X.AS_OF, ("zz",))
    assert E.best_trend(cands, history, unknown, X.AS_OF, ("zz",), strict=False).count() == 1


def test_sections_without_media_are_an_error(spark):
    sections = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "script_id long, section_id long")
    cands = spark.createDataFrame([(1, 0, 3, 1, 0, 7, "image"), (2, 0, 1, 2, 0, 8, "video")], "script_id long, section_id long, tier int, query int, pos int, item long, kind string")
    with pytest.raises(ValueError, match=r"\(2, 0\)"):  # a web clip of the second query is not eligible
        E.allocate_media(cands, sections, 2)
    found = E.allocate_media(cands, sections, 2, strict=False)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1, "7", "image"), (1, 1, 1, "7", "image")]
    media = spark.createDataFrame([(7, "https://a.org/x", 3.0, 5, None), (8, "https://a.org/y", 3.0, 5, None)], "media_id long, url string, duration double, size long, sha string")
    used = spark.createDataFrame([("image", "url", "https://a.org/x")], "media_type string, key_kind string, key_value string")
    assert E.allocate_media(cands, sections, 2, media, used, strict=False).count() == 0


def brute_near(a, b):
    return {(x, y) for x in a for y in b if bin((x ^ y) & (1 << 64) - 1).count("1") <= 6}


def test_full_bands_are_cut(spark, monkeypatch):
    """Very many hashes that share a band's bits meet by further bits: all near pairs, and few candidates."""
    rng = random.Random(4)
    base = 0x0123_4567_89AB_CDEF
    shared = [base & 0x3F_FFFF | rng.getrandbits(41) << 22 for _ in range(10_000)]
    near = [h ^ (1 << rng.randrange(22, 63)) ^ (1 << rng.randrange(22, 63)) for h in shared[:50]]
    df = spark.createDataFrame([(h,) for h in shared + near], "h long")
    got = {(r["a"], r["b"]) for r in H.near_hashes(df).collect()}
    own = sorted(set(shared + near))
    chosen = set(near) | set(shared[:50])
    assert {p for p in got if chosen & set(p)} == {(min(p), max(p)) for p in brute_near(chosen, own) if p[0] != p[1]}
    mask = H._mask([H._BANDS[i] for i in range(3)])
    keyed = H._keyed(df.distinct(), [mask])
    assert H._met(keyed, keyed).count() < 10_000 * 400  # of 10**8


def test_near_stored_hashes(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    stored = [rng.getrandbits(64) for _ in range(300)] + [0xFFFF_0000_0000_0000 | rng.getrandbits(12) for _ in range(300)]
    flip = lambda h, n: h ^ sum(1 << i for i in rng.sample(range(64), n))
    batch = [flip(h, n) for n in range(9) for h in rng.sample(stored, 12)]
    path = str(tmp_path / "index")
    frames = [(f"c{i // 3}", i % 3, signed(h)) for i, h in enumerate(stored)]
    H.index_fingerprints(spark.createDataFrame(frames[:200], "clip string, frame int, h long"), path)
    H.index_fingerprints(spark.createDataFrame(frames[100:], "clip string, frame int, h long"), path)
    for full in (64, 2):
        monkeypatch.setattr(H, "FULL", full)
        got = {(r["h"], r["other"]) for r in H.near_stored(spark.createDataFrame([(signed(h),) for h in batch], "h long"), path).collect()}
        assert got == {(signed(a), signed(b)) for a, b in brute_near(batch, stored)}


def test_few_folders_of_the_index_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    frames = spark.range(3000).select(F.lit("c").alias("clip"), F.lit(0).alias("frame"), F.xxhash64("id").alias("h"))
    H.index_fingerprints(frames, path)
    H._touched(spark.read.parquet(f"{path}/bands"), frames.limit(1).select(F.lit(2).alias("band"), F.lit(7).alias("cell"))).count()
    one = H._touched(spark.read.parquet(f"{path}/bands"), spark.createDataFrame([(2, 7), (2, 9), (0, 1)], "band int, cell int"))
    files = {f.split("bands/")[1].rsplit("/", 1)[0] for f in one.select(F.col("_metadata.file_path")).distinct().toPandas()["file_path"]}
    assert files == {"band=2/cell=7", "band=2/cell=9", "band=0/cell=1"}
    assert "PartitionFilters: [((" in one._jdf.queryExecution().toString()
    assert H._touched(spark.read.parquet(f"{path}/bands"), spark.createDataFrame([], "band int, cell int")).count() == 0


def test_clips_near_to_stored_ones(spark, tmp_path):
    """Planted: three of four frames near, two, one, none, a frame that every stored clip has, and unreadable entries."""
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    black = 0
    clips = {f"s{i}": [black] + [rng.getrandbits(64) for _ in range(3)] for i in range(40)}
    text = lambda hs: ",".join(f"{h:016x}" for h in hs)
    entries = [("video", "perceptual", text(hs)) for hs in clips.values()] + [("video", "perceptual", "zz,,12"), ("image", "perceptual", text([1, 2])), ("video", "hash", text([3]))]
    stored = H.stored_frames(spark.createDataFrame(entries, "media_type string, key_kind string, key_value string"))
    H.index_fingerprints(stored, str(tmp_path / "i"))
    far = lambda: rng.getrandbits(64)
    s0, s1 = clips["s0"], clips["s1"]
    batch = {1: [s0[1] ^ 0b111, s0[2], s0[3] ^ 0b111111, far()], 2: [s1[1], black, far(), far()], 3: [s1[1] ^ 1, far(), far(), far()], 4: [far()] * 4, 5: [black], 6: [s1[1] ^ 0x7F, s1[2] ^ 0x7F, far(), far()]}
    rows = [(c, k, signed(h)) for c, hs in batch.items() for k, h in enumerate(hs)]
    got = {(r["a_clip"], r["used"], r["share"]) for r in H.near_stored_clips(spark.createDataFrame(rows, "clip long, frame int, h long"), str(tmp_path / "i")).collect()}
    assert got == {(1, text(s0), 0.75), (2, text(s1), 0.5)} | {(5, text(hs), 1.0) for hs in clips.values()}
    assert spark.range(1).select(H.fingerprint(F.array(*(F.lit(signed(h)) for h in s0)))).first()[0] == text(s0)


def test_keyed_hashes_are_never_broadcast(spark):
    """Each hash has 84 keys, for which Spark's estimate of a table's size does not allow."""
    hashes = spark.range(300).select(F.xxhash64("id").alias("h"))
    keyed = H._keyed(hashes, [H._mask([H._BANDS[i] for i in three]) for three in H.combinations(range(9), 3)])
    assert "Broadcast" not in H._met(keyed, keyed)._jdf.queryExecution().executedPlan().toString()


def test_clips_of_frames_with_many_near_hashes(spark):
    """60 clips whose first frames are all near to each other, and whose others are near in pairs."""
    rows = [(k, 0, 1 << (k % 3) | 1 << (3 + k % 3)) for k in range(60)] + [(k, 1, (k // 2 + 1) * 0x5DEECE66D12F | 1 << (k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "clip long, frame int, h long")
    want = set()
    for a in range(60):
        for b in range(60):
            mine, other = ([h for c, _, h in rows if c == x] for x in (a, b))
            share = sum(any((h ^ o).bit_count() <= 6 for o in other) for h in mine) / 2
            if a != b and share >= 0.5:
                want.add((a, b, share))
    assert {tuple(r) for r in H.near_dup_clips(df).collect()} == want
