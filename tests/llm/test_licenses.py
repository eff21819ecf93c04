"""Licence labels against a plain reading of the rules, without an index."""

import re

import numpy as np
import pytest

from spendlake.llm import licenses

TEMPLATES = licenses.TEMPLATES
MIT = TEMPLATES[1][1]


def labels(spark, texts):
    return {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def plain(words, rare):
    """Labels and score of one text: every beginning of every template is tried."""
    own, score, found = set(), 0.0, []
    for p, label in licenses.PHRASES.items():
        if f" {p} " in f" {' '.join(words)} ":
            own, score = own | {label}, 0.5
    for (label, body, phrases), chosen in zip(TEMPLATES, rare, strict=True):
        body, groups, voted, last = body.split(), [], {}, None
        here = lambda b, q: words[b + q] if 0 <= b + q < len(words) else ""
        for b in range(-len(body), len(words)):
            posted = [q for q, w in enumerate(body) if w in chosen]
            votes = sum(here(b, q) == body[q] for q in posted)  # noqa: B023
            if votes:
                voted[b] = 4 * votes >= len(posted)
        for b in sorted(voted):
            if voted[b] and (last is None or b - last > 8):
                last = b
                groups.append([x for x in voted if abs(x - b) <= 8])
        for begins in groups:
            places = {b + q for b in begins for q in range(len(body)) if here(b, q) == body[q]}
            share = np.mean([any(here(b, q) == body[q] for b in begins) for q in range(len(body))])
            text = lambda b, q, n: " ".join(here(b, q + i) for i in range(n))
            keys = any(" ".join(body[q : q + len(p.split())]) == p and text(b, q, len(p.split())) == p for p in phrases for q in range(len(body)) for b in begins)
            if share >= 0.7 and keys:
                found.append((-len(places), -share, label, places))
    taken = set()
    for _, share, label, places in sorted(found, key=lambda x: x[:3]):
        if not taken & places:
            taken, own, score = taken | places, own | {label}, max(score, -share)
    return ",".join(sorted(own)), score


def by_phrase(words):
    """What a search for the key phrases alone would say."""
    line = f" {' '.join(words)} "
    return ",".join(sorted({label for label, _, phrases in TEMPLATES if any(f" {p} " in line for p in phrases)} | {label for p, label in licenses.PHRASES.items() if f" {p} " in line}))


def test_labels_equal_a_plain_reading(spark):
    rng = np.random.default_rng(4)
    filler = sorted({w for _, body, _ in TEMPLATES for w in body.split()})
    texts = [MIT + " Licensed under CC BY-NC 4.0"]
    for k in range(70):
        parts = [TEMPLATES[j][1].split() for j in rng.permutation(len(TEMPLATES))[: rng.integers(0, 5)]]
        parts = [[w for w in p if rng.random() > 0.04 * (k % 4)] for p in parts]
        texts.append(" ".join(w for p in parts for w in [*rng.choice(filler, rng.integers(0, 40)), *p]))
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    held = {w: sum(w in x for x in words) for w in filler}
    rare = [sorted(set(body.split()), key=lambda w: (held[w], w))[: licenses.RARE] for _, body, _ in TEMPLATES]
    got, want = labels(spark, texts), {k: plain(x, rare) for k, x in enumerate(words)}
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]), texts[k]
    assert got[0][0] == "cc-by-nc,mit" and sum("," in a for a, _ in got.values()) > 15
    assert sum(got[k][0] != by_phrase(x) for k, x in enumerate(words)) > 5


def test_a_phrase_alone_is_no_notice_and_a_notice_may_lack_a_phrase(spark):
    texts = {
        "open the mozilla public license page": "",
        "we do not allow redistribution and use in source and binary forms": "",
        "creative commons attribution noncommercial noderivatives": "",
        MIT.replace("free of charge", "at no cost"): "mit",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-nc-nd",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        TEMPLATES[6][1].replace("general", "lesser general").replace("program", "library").replace("version 3", "version 2.1"): "gpl,lgpl",  # a base phrase stands in it
        "some words before " + MIT.replace("copy modify", "copy read modify and so on") + " and after": "mit",
        MIT.replace("free of charge", "at no cost").replace("without restriction", "with limits"): "",
        "mit license": "mit",
    }
    assert {k: v[0] for k, v in labels(spark, list(texts)).items()} == dict(enumerate(texts.values()))
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    assert sum(by_phrase(w) != label for w, label in zip(words, texts.values(), strict=True)) >= 4


def test_repeated_and_very_long_texts(spark):
    texts = ["the mit license " * 20000, " ".join([MIT] * 200), "x" * 100_000, MIT + " " + "word " * 50_000 + MIT.upper()]
    got = labels(spark, texts)
    assert [got[k][0] for k in range(4)] == ["mit", "mit", "", "mit"]
