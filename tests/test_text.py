import pytest
from pyspark.sql import functions as F

from lodestar.functions import constants as C
from lodestar.functions import numbers as N
from lodestar.functions import sql_udfs
from lodestar.functions import text as T
from lodestar.functions import urls as U
from lodestar.operators import gates as G


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


# Texts and their normal forms.
NORMAL = [
    ("Harbour???", "harbour"), ("Tide-Table North", "tide table north"), ("   old \t  oak\n", "old oak"), ("north/south/east", "north south east"),
    ("RIVER, river", "river river"), ("", ""), (" \t ", ""), ("route 66 map", "route 66 map"), ("(moss)", "moss"), ("7", "7"),
    ("one...two;;three", "one two three"), ("left_right", "left right"), ("_", ""), ("comet’s tail", "comet s tail"), ("comet's tail", "comet s tail"),
    ("11:45 train", "11 45 train"), ("--", ""), (None, ""),
]

# Texts and whether they are banned: a banned word alone, in a sentence, in capitals, and none.
BANNED = [
    (f"{before}{word}{after}", True)
    for i, word in enumerate(C.BANNED_KEYWORDS)
    for before, after in [[("", ""), ("a film on ", " in town"), ("", "!")][i % 3]]
] + [(C.BANNED_KEYWORDS[0].upper(), True), ("Two TERRORISM trials", True), ("on self-harm", True), ("harbour lights at dawn", False), ("tide table", False), ("", False)]


def test_normal_forms(spark):
    df = spark.createDataFrame(NORMAL, "raw string, expected string")
    assert df.filter(T.normalize_text(F.col("raw")) != F.col("expected")).count() == 0
    sql_udfs.register(spark)
    df.createOrReplaceTempView("normal_forms")
    assert spark.sql("SELECT * FROM normal_forms WHERE normalize_text(raw) <> expected").count() == 0


def test_banned_texts(spark):
    df = spark.createDataFrame(BANNED, "text string, expected boolean")
    assert df.filter(~G.not_banned(F.col("text")) != F.col("expected")).count() == 0
    assert not value(spark, G.not_banned(F.lit("ripe grapes"))) and value(spark, G.not_banned(F.lit("ripe grapes"), whole_word=True))


@pytest.mark.parametrize("hours", [0.5, 1, 2, 4, 8, 12, 18, 24, 36, 48, 60, 72, 90, 120, 240])
def test_scores_are_bounded(spark, hours):
    score = value(spark, N.trend_score(F.lit(100_000), F.lit(5_000), F.lit(500), F.lit(float(hours))))
    assert 0 <= score <= 100


def test_terms_and_anchors(spark):
    assert value(spark, T.topic_terms(F.lit("The Matrix is a matrix of official facts"))) == ["matrix"]
    assert value(spark, T.topic_tokens(F.lit("the a GTA 6 trailer"))) == ["gta", "6"]
    assert value(spark, T.subject_anchors(F.lit("#OnePiece: Luffy meets NASA in Théâtre again, xy"))) == ["luffy", "nasa", "onepiece"]
    assert value(spark, T.subject_anchors(F.lit(None).cast("string"))) == []


def test_json_objects(spark):
    assert value(spark, T.json_object(F.lit('```json\n{"a": {"b": 1}}\n```'))) == '{"a": {"b": 1}}'
    assert value(spark, T.json_object(F.lit("none"))) is None


def test_times(spark):
    assert value(spark, N.srt_time(F.lit(3_723_004.9))) == "01:02:03,004"
    assert value(spark, N.srt_time_rounded(F.lit(1.9996))) == "00:00:02,000"
    assert value(spark, N.parse_srt_time(F.lit("01:02:03,004"))) == 3_723_004
    assert value(spark, N.parse_srt_time(F.lit("1:2"))) is None
    assert value(spark, N.chapter_ts(F.lit(3725))) == "1:02:05" and value(spark, N.chapter_ts(F.lit(65))) == "1:05"
    as_of = F.expr("TIMESTAMP '2024-01-02 00:00:00'")
    assert value(spark, N.age_hours(N.text_time(F.lit("2024-01-01T00:00:00Z")), as_of)) == 24
    assert value(spark, N.age_hours(N.text_time(F.lit("2024-01-01T00:00:00")), as_of)) == 73
    assert value(spark, N.age_hours(N.text_time(F.lit("soon")), as_of)) == 73


def test_hashes(spark):
    grid = F.array(*(F.lit(float(i % 9 if i // 9 % 2 else -(i % 9))) for i in range(72)))
    assert value(spark, N.grid_hash(grid)) & (2**64 - 1) == 0x00FF00FF00FF00FF
    assert value(spark, N.hex_hash(F.lit("ffffffffffffffff"))) == -1 and value(spark, N.hex_hash(F.lit("xyz"))) is None
    assert value(spark, N.hamming(F.lit(-1), F.lit(0))) == 64 and value(spark, N.hamming(F.lit(None).cast("long"), F.lit(0))) == 9999


def test_error_classes(spark):
    for message, kind in (("api key missing", "auth"), ("Error 503", "transient"), ("quota exceeded", "transient"), ("bad", "fatal"), (None, "fatal")):
        assert value(spark, N.error_class(F.lit(message).cast("string"))) == kind


@pytest.mark.parametrize(
    "url,canonical",
    [
        ("pexels:12", "pexels:12"), ("HTTPS://Ex.com/A?b=1#c", "https://ex.com/A"), ("https://youtu.be/abc?t=1", "youtube:abc"),
        ("https://m.youtube.com/watch?a=1&v=xyz&b=2", "youtube:xyz"), ("not a url", "not a url"), ("", ""), (None, ""),
        ("https://www.youtube.com/about", "https://www.youtube.com/about"),
    ],
)
def test_canonical_urls(spark, url, canonical):
    assert value(spark, U.canonical_url(F.lit(url).cast("string"))) == canonical


def test_blocked_domains(spark):
    blocked = lambda u: not value(spark, U.domain_not_blocked(F.lit(u)))
    assert blocked("https://alamy.com:80/x") and blocked("http://eu.alamy.com/") and blocked("https://www.pond5.com/x")
    assert not blocked("https://notalamy.com/") and not blocked("")


def test_chunks_keep_all_words_in_order(spark):
    sentences = [" ".join(f"w{k}_{i}" for i in range(n)) + "." for k, n in enumerate([3, 70, 20, 200, 1, 79, 80, 81, 5])]
    text = "  ".join(sentences)
    chunks = value(spark, T.chunk_text(F.lit(text), 10))
    assert " ".join(chunks).split() == text.split()
    assert all(len(c.split()) <= 80 for c in chunks)
    assert value(spark, T.chunk_text(F.lit("  "), 80)) == []
