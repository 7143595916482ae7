import random

import pytest

from lodestar.llm import linededup

from .helpers import EDGE, edge, empty

SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a") for i, t in texts], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_chunks_hold_all_lines():
    rng = random.Random(1)
    for _ in range(50):
        lines = [prose(rng, rng.choice([0, 1, 3, 9, 30])) for _ in range(rng.randrange(1, 30))]
        found = linededup.chunks("\n".join(lines).encode())
        assert [f for f, *_ in found] == [0, *(e for _, e, _ in found[:-1])] and found[-1][1] == len(lines)
        assert sum(n for *_, n in found) == sum(len(x.split()) for x in lines)


def test_boundaries_do_not_shift():
    rng = random.Random(2)
    shared = [prose(rng, 5) for _ in range(40)]
    cut = lambda lines: {tuple(lines[a:b]) for a, b, _ in linededup.chunks("\n".join(lines).encode())}
    common = cut([prose(rng, 5), *shared]) & cut([prose(rng, 5), prose(rng, 5), *shared, prose(rng, 5)])
    assert sum(map(len, common)) >= 34


def test_repeated_passages_go_but_the_first(spark):
    rng = random.Random(3)
    passage = "\n".join(prose(rng, 30) for _ in range(3))
    clean = [(i, f"{prose(rng, 40)}\n{prose(rng, 4)}\n{prose(rng, 40)}") for i in range(100, 130)]
    planted = [(i, f"{prose(rng, 20)}\n{passage}\n{prose(rng, 20)}") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, clean + planted)).collect()}
    assert all(got[i] == t for i, t in clean)
    assert got[0] == planted[0][1]
    for i, t in planted[1:]:
        first, *_, last = t.split("\n")
        assert got[i] == f"{first}\n{last}"


@pytest.mark.parametrize("per_line", [1, 2, 3, 5])
def test_repeated_passages_of_short_lines_go(spark, per_line):
    """What stays of a repeated passage is near its ends, however short its lines are; each document's own lines stay."""
    rng = random.Random(per_line)
    passage = [prose(rng, per_line) for _ in range(300 // per_line)]
    own = [[prose(rng, 3) for _ in range(10)] for _ in range(12)]
    planted = [(i, "\n".join([*o[:5], *passage, *o[5:]])) for i, o in enumerate(own)]
    got = {r["doc_id"]: r["text"].split("\n") for r in linededup.dedup_lines(frame(spark, planted)).collect()}
    assert "\n".join(got[0]) == planted[0][1]
    for i in range(1, len(own)):
        left = got[i]
        assert left[:5] == own[i][:5] and left[-5:] == own[i][5:]
        assert sum(len(x.split()) for x in left[5:-5]) <= 0.25 * 300


def test_chunks_of_short_lines_can_be_removed():
    rng = random.Random(9)
    for _ in range(100):
        lines = [prose(rng, rng.choice([0, 1, 1, 2, 3, 5])) for _ in range(rng.randrange(10, 80))]
        found = [n for *_, n in linededup.chunks("\n".join(lines).encode())]
        assert len(found) == 1 or min(found) >= linededup.LEAST_WORDS


def test_exact_copies_keep_one_text(spark):
    rng = random.Random(4)
    text = prose(rng, 60)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, [(i, text) for i in (7, 3, 5)])).collect()}
    assert got == {3: text, 5: "", 7: ""}


def test_edge_rows(spark):
    found = linededup.dedup_lines(edge(spark), gone="gone")
    assert found.columns == [*edge(spark).columns, "_gone"]
    rows = found.collect()
    assert len(rows) == len(EDGE)
    texts = {(r["doc_id"], r["text"]) for r in rows}
    assert texts == {(i, t) for i, t, *_ in EDGE} and all(r["_gone"] == [] for r in rows)
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_query_against_brute_force(spark, small):
    """What goes is, for each chunk of enough words that two documents have, all but its first place."""
    from lodestar.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    places = {}
    for i, t in sorted(docs.items()):
        lines = (t or "").encode().split(b"\n")
        for at, (a, b, n) in enumerate(linededup.chunks((t or "").encode())):
            if n >= linededup.LEAST_WORDS:
                places.setdefault(b"\n".join(lines[a:b]), []).append((i, at))
    gone = {i: set() for i in docs}
    for found in places.values():
        if len({i for i, _ in found}) > 1:
            for i, at in found:
                if (i, at) != min(found):
                    gone[i].add(at)
    for r in queries.op6_line_dedup(spark, small).collect():
        assert r["removed"] == ",".join(map(str, sorted(gone[r["doc_id"]]))) and r["n_removed"] == len(gone[r["doc_id"]])
