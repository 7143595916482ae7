import hashlib
from math import log2

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import secrets

from .helpers import EDGE, edge, empty, rows


def brute_runs(s):
    out = []
    for i in range(len(s) - secrets.WINDOW + 1):
        w = s[i : i + secrets.WINDOW]
        digits, lower, upper = (sum(f(c) for c in w) for f in (str.isdigit, str.islower, str.isupper))
        if not digits or not lower + upper:
            continue
        kind = "hex" if all(c in "0123456789abcdefABCDEF" for c in w) else "mixed" if lower and upper else "lower" if lower else "upper"
        entropy = -sum(w.count(c) / len(w) * log2(w.count(c) / len(w)) for c in set(w))
        if entropy >= secrets.THRESHOLDS[kind] - 1e-12:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + len(w))
            else:
                out.append((i, i + len(w)))
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdef0123456789ABCxyzQRS_+-", min_size=20, max_size=80))
def test_incremental_entropy_is_the_entropy_of_each_window(s):
    assert [(a, b) for a, b in secrets.random_runs(s)] == brute_runs(s)


def test_base_patterns():
    t = 'x PASSWORD = "hunter2hunter2" token=api_key:"longvalue1" AKIAABCDEFGHIJKL AKIA123 ' + "0" * 32 + " secret: short1 é"
    found = secrets.base_spans(t)
    assert [(secrets.KINDS[k], t[a:b]) for a, k, b in found] == [
        ("assign", 'PASSWORD = "hunter2hunter2'),
        ("access", "AKIAABCDEFGHIJKL"),
        ("hex", "0" * 32),
    ]
    assert secrets.base_spans("ſecret=abcdefghij") == []
    assert secrets.base_spans("é secret=abcdefghij")[0][0] == 2


def test_entropy_adds_spans_and_the_allow_list_takes_them_away():
    key = "q7Zx9Lm2Vt5Kp8Rw3Yb6Nd1H"
    assert [s[1] for s in secrets.entropy_spans(f"see {key} here", [])] == [3]
    assert secrets.entropy_spans(f"see {key} here", [(4, 0, 20)]) == []
    for plain in ("thequickbrownfoxjumpsoverit", "12345678901234567890123", "your_api_key_9f8a7b6c5d4e3f2a1b", "abcdefghij0123456789ABCDEFGHIJ"):
        assert secrets.entropy_spans(plain, []) == []


def test_allowed_and_base_spans_hide_only_themselves():
    key = "q7Zx9Lm2Vt5Kp8Rw3Yb6Nd1H"
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    for before in ("/data/sample/", "EXAMPLE_KEY=", f"{uuid}_", "--------", "========"):
        text = before + key
        assert [text[a:b] for a, _, b in secrets.entropy_spans(text, [])][-1].endswith(key)
    text = "0" * 32 + key
    assert [text[a:b] for a, _, b in secrets.entropy_spans(text, secrets.base_spans(text))] == [key]


def test_edge_rows(spark):
    found = rows(secrets.find_secrets(edge(spark)))
    assert len(found) == len(EDGE)
    assert {r[5] for r in found} == {hashlib.sha256(b"").hexdigest()} and {r[6] for r in found} == {""}
    assert rows(secrets.find_secrets(empty(spark))) == []


def test_query_against_brute_force(spark, small):
    from lodestar.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op4_secrets(spark, small).collect():
        base = secrets.base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert set(filter(None, joined.split(","))) <= set(filter(None, r["spans"].split(",")))
