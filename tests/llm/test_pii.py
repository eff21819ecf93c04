"""Personal data against plain patterns, and disguises with their places."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlake.llm import pii, queries

SF = "/root/testdata/sf0.001"
#: The base patterns.
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
CARD = "4111 1111 1111 1111"


def plain(t):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            ok = (
                True,
                k == 1 and all(int(x) <= 255 for x in m.group().split(".")),
                16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0,
                8 <= len(digits) <= 15,
            )[k]
            if ok:
                out.append((k, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "25", "256", " ", "-", "+", "(", ")", "0", "a@b.c", "1.2.3.4", "4111111111111111", "é", "\n", "..", "+49 170 1234567", "%", "@@"]), max_size=25))
def test_base_spans_equal_plain_patterns(parts):
    t = "".join(parts)
    assert sorted(pii.base_spans(t)) == sorted(plain(t))
    assert set(pii.base_spans(t)) == {s[:3] for s in pii.spans(t, True) if s[3]}


def found(t):
    """Kind and text of the spans that the patterns alone do not find."""
    (suspect,) = pii.suspects(pa.array([t]), [t])
    return [(pii.KINDS[k], t[a:b]) for k, a, b, base in pii.spans(t, bool(suspect)) if not base]


@pytest.mark.parametrize(
    ("t", "want"),
    [
        ("mail jane (at) mail.example.com now", ("email", "jane (at) mail.example.com")),
        ("mail jane[at]mail[dot]com, now", ("email", "jane[at]mail[dot]com")),
        ("write to jane.doe AT example DOT com today", ("email", "jane.doe AT example DOT com")),
        ("jane dot doe at mail dot example dot org", ("email", "jane dot doe at mail dot example dot org")),
        ("escribe a juan arroba correo punto es ya", ("email", "juan arroba correo punto es")),
        ("jane＠example．com", ("email", "jane＠example．com")),
        ("jаne@exаmple.com", ("email", "jаne@exаmple.com")),  # Cyrillic a
        ("x jane​@exam​ple.com y", ("email", "jane​@exam​ple.com")),
        ("jane @ example.com", ("email", "jane @ example.com")),
        ("card ４１１１ 1111 1111 1111 ok", ("card", "４１１１ 1111 1111 1111")),
        ("card 4111–1111–1111–1111 ok", ("card", "4111–1111–1111–1111")),
        ("four one one one one one one one one one one one one one one one", ("card", "four one one one one one one one one one one one one one one one")),
        ("cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno", ("card", "cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno")),
        ("host 10 dot 0 dot 0 dot 1 up", ("ip", "10 dot 0 dot 0 dot 1")),
        ("host 10[.]0[.]0[.]1 up", ("ip", "10[.]0[.]0[.]1")),
        ("host one nine two dot one six eight dot 0 dot 1", ("ip", "one nine two dot one six eight dot 0 dot 1")),
        ("call plus 49 170 1234567 now", ("phone", "plus 49 170 1234567")),
        ("call +٤٩ ١٧٠ ١٢٣٤٥٦٧ now", ("phone", "+٤٩ ١٧٠ ١٢٣٤٥٦٧")),
    ],
)
def test_disguises_are_found_in_their_place(t, want):
    assert want in found(t)


@pytest.mark.parametrize(
    "t",
    [
        "We met at noon. Then at the dot on the map, at example.com or so.",
        "one two or three; at one point four of them, un deux trois, plus 3 others",
        "Élan naïve über · 2019–2020 • 5 points",
        "ping @user.name at 3.14 (at least) [dot matrix]",
        "jane@example.com and 10.0.0.1 and " + CARD,
    ],
)
def test_prose_and_plain_data_give_nothing_more(t):
    assert found(t) == []


def test_transducers_keep_places():
    for t in ("a​b＠ｃ．d", "jane (at) x dot y", "four one one", "ﬁ İ K", ""):
        for written, begin, end in (pii.characters(t), pii.tokens(pii.characters(t))):
            assert len(written) == len(begin) == len(end) and (begin < end).all() and (begin[1:] >= begin[:-1]).all()


def test_long_texts_take_linear_time():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "one " * 50_000, "at " * 60_000, "@" * 100_000, "(at) " * 40_000):
        pii.spans(t, True)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_personal_data"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base = sorted(plain(r.text))
        shown = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[r.doc_id][1:6] == (*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(shown.encode()).hexdigest())
        assert set(filter(None, shown.split(","))) <= set(got[r.doc_id].spans.split(","))
        assert got[r.doc_id].spans == shown  # these texts hold no disguises


def test_edges(spark):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (None, "a@b.de é@x.y", "z", 3), (4, "jane (at) b.de +1 (017) 555-7713", "z", 4), (4, "jane (at) b.de +1 (017) 555-7713", "z", 4), (5, "x" * 200_000 + " " + CARD, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string, `a.b` int")
    out = pii.find(docs, "_pii").collect()
    assert [r["pii"] for r in out] == list("xyzzzz") and out[0].asDict().keys() == {"doc_id", "text", "pii", "a.b", "_pii"}
    spans = {r["a.b"]: [tuple(s) for s in r["_pii"]] for r in out}
    assert spans[1] == spans[2] == [] and spans[3] == [("email", 0, 6, True)]
    assert spans[4] == [("email", 0, 14, False), ("phone", 15, 32, True)] and spans[5] == [("card", 200_001, 200_020, True)]
    hidden = {r["a.b"]: r["masked"] for r in pii.masked(docs).collect()}
    assert hidden[1] is None and hidden[3] == "<email> é@x.y" and hidden[4] == "<email> <phone>" and hidden[5].endswith("x <card>")
    assert pii.digest(docs.limit(0)).count() == 0 and pii.find(docs).columns == ["doc_id", "text", "a.b", "pii"]
