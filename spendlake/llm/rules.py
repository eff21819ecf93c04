"""Quality rules in a short-circuit cascade, all in DataFrame functions.

Rules are conditions on a document's figures. On a sample, one pass counts the documents that fail each
combination of rules and the words, characters and lines that their figures walk over. From these counts the
rules are put in order: again and again the rule that rejects most of the documents still there per unit of
work. A document runs through them in that order in one expression, which splits the text once and computes a
figure only when the first rule that needs it is reached; a rejected document is not looked at by later rules.
The order changes the cost, never the verdict, and is the same in every run on the same rows.

Rows: null text has no words and fails the rule on few words; so does an empty one. Texts of any length are
judged whole. Repeated rows get a result each, nothing ties; null `doc_id`s are kept. Other columns are not
looked at and `keep` returns them as they are, whatever their names. An empty table gives an empty result.
Trigrams of words are compared by 64-bit hash within one document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def words(text: str = "text") -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text, empty for null."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")


def _lines(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_symbols(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOLS)).cast("long")


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def n_dup_lines(text: str = "text") -> Column:
    return _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(grams: Column) -> Column:
    """Words covered by windows whose hash stands twice or more in `grams`."""

    def counted(marked: Column) -> Column:
        g = lambda k: F.get(marked, k)["g"]
        twice = F.filter(marked, lambda x, k: (x["g"] == g(k + 1)) | ((k > 0) & (x["g"] == g(F.greatest(k - 1, F.lit(0))))))
        return F.aggregate(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct((i + 3).alias("upto"), (acc["n"] + (i + 3 - F.greatest(acc["upto"], i)).cast("long")).alias("n")),
            lambda acc: acc["n"],
        )

    return _let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), counted)


def _grams(w: Column) -> Column:
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.transform(F.sequence(F.lit(0), F.size(w) - 3), gram)


def n_dup_grams(w: Column) -> Column:
    """Three-word windows of the word array `w` beyond the first of each kind."""
    return F.when(F.size(w) >= 4, _let(_grams(w), lambda g: F.size(g) - F.size(F.array_distinct(g)))).otherwise(0).cast("long")


def n_repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more in the word array `w`."""
    grams = _grams(w)
    repeats = lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _covered(g)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(w) >= 4, _let(grams, repeats)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """`docs` with `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`."""
    figures = _let(
        words(),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            n_repeat_words(w).alias("n_repeat_words"),
        ),
    )
    rows = docs.withColumns({"_figures": figures, "n_symbols": n_symbols(), "n_dup_lines": n_dup_lines()})
    return rows.withColumns({c: F.col(f"_figures.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}).drop("_figures")


#: Work of a figure for each word, character and line of a text, in units of about 10 ns; words are split before.
WORK = {"n_words": (0.1, 0, 0), "word_chars": (3, 0.2, 0), "n_symbols": (0, 0.5, 0), "n_dup_lines": (0, 0.2, 20), "n_dup_grams": (20, 0, 0), "n_repeat_words": (60, 0, 0)}


@dataclass(frozen=True)
class Rule:
    """A document fails if `fails` of its figures is true; `sql` is the same condition in SQL.

    Where `spared` holds for the cheaper figures `first`, it cannot fail, and the dearer ones are not computed.
    """

    name: str
    figures: tuple[str, ...]
    fails: Callable[..., Column] = field(repr=False)
    sql: str
    first: tuple[str, ...] = ()
    spared: Callable[..., Column] | None = field(default=None, repr=False)


#: Limits are set so that ordinary prose in any of the languages passes.
BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 50, "n_words < 50"),
    Rule("repeated_trigrams", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n, "100 * n_repeat_words > 50 * n_words", ("n_dup_grams", "n_words"), lambda d, n: 12 * d <= n),
)  # d windows beyond the first of their kind belong to 2 d windows at most, which cover 6 d words at most
EXTRA = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: s > 0.2 * n, "n_symbols > 0.2 * n_words"),
    Rule("repeated_lines", ("n_dup_lines", "n_words"), lambda d, n: (d >= 5) & (d * 10 > n), "n_dup_lines >= 5 and n_dup_lines * 10 > n_words"),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n, "word_chars < 2 * n_words"),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 25 * n, "word_chars > 25 * n_words"),
)
#: Documents, about, that the order of the rules is estimated on.
SAMPLE = 5000


def _failed(rule: Rule) -> Column:
    """The rule on rows of `measured`."""
    return F.coalesce(rule.fails(*map(F.col, rule.figures)), F.lit(False))


def ordered(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Rules, best first, with their share of rejections among documents that reach them and their work for each.

    The sample serves only to order the rules; every rule still judges every document. A rule that needs a
    figure which an earlier rule has computed does no work for it again.
    """
    n = docs.count()
    taken = measured(docs.select("text").sample(min(1.0, sample / max(n, 1)), 11))
    mask = sum((F.when(_failed(r), 1 << k).otherwise(0) for k, r in enumerate(rules)), F.lit(0))
    body = F.coalesce(F.col("text"), F.lit(""))
    lines = F.regexp_count(body, F.lit("\n")) + 1
    counts = taken.groupBy(mask.alias("mask")).agg(F.count("*"), F.sum("n_words"), F.sum(F.char_length(body)), F.sum(lines)).collect()  # 2 ** len(rules) rows at most
    left, out, known = [(r[0], r[1], r[2:]) for r in counts], [], set()
    while len(out) < len(rules):
        reach = sum(c for _, c, _ in left)
        units = [sum(x[k] for _, _, x in left) / reach if reach else 0.0 for k in range(3)]

        def judged(k: int) -> tuple[float, float]:
            work = 1e-6 + sum(w * u for f in (rules[k].first or rules[k].figures) if f not in known for w, u in zip(WORK[f], units, strict=True))  # noqa: B023
            return sum(c for m, c, _ in left if m >> k & 1) / reach if reach else 0.0, work  # noqa: B023

        open_ = [k for k in range(len(rules)) if rules[k] not in [r for r, _, _ in out]]
        best = min(open_, key=lambda k: (-judged(k)[0] / judged(k)[1], judged(k)[1], rules[k].name))  # noqa: B023
        out.append((rules[best], *judged(best)))
        left, known = [x for x in left if not x[0] >> best & 1], known | set(rules[best].first or rules[best].figures)
    return out


def cascade(rules: list[Rule], text: str = "text") -> Column:
    """True if no rule fails a text; figures are computed when a rule needs them, once, and not after a rule has failed."""

    def given(names: tuple[str, ...], have: dict[str, Column], w: Column, then: Callable[[dict[str, Column]], Column]) -> Column:
        missing = next((f for f in names if f not in have), None)
        return _let(figures[missing](w), lambda x: given(names, have | {missing: x}, w, then)) if missing else then(have)

    def judge(k: int, have: dict[str, Column], w: Column) -> Column:
        if k == len(rules):
            return F.lit(True)
        rule = rules[k]
        fails = lambda h: rule.fails(*(h[f] for f in rule.figures))
        after = lambda h: F.when(fails(h), F.lit(False)).otherwise(judge(k + 1, h, w))
        if rule.spared is None:
            return given(rule.figures, have, w, after)
        dear = lambda h: F.when(rule.spared(*(h[f] for f in rule.first)), F.lit(False)).otherwise(given(rule.figures, h, w, fails))
        return given(rule.first, have, w, lambda h: F.when(dear(h), F.lit(False)).otherwise(judge(k + 1, h, w)))

    figures = {
        "n_words": lambda w: F.size(w).cast("long"),
        "word_chars": lambda w: F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": lambda w: n_symbols(text),
        "n_dup_lines": lambda w: n_dup_lines(text),
        "n_dup_grams": n_dup_grams,
        "n_repeat_words": n_repeat_words,
    }
    return _let(words(text), lambda w: judge(0, {}, w))


def judge(docs: DataFrame, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """`doc_id`, the figures, `base_failed` and `kept`.

    As every figure is returned, all are computed here; the order of the rules still ends the verdict early.
    """
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | _failed(rule)
    kept = F.lit(True)
    for rule, _, _ in reversed(ordered(docs, extra)):
        kept = F.when(_failed(rule), F.lit(False)).otherwise(kept)
    return measured(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & kept).alias("kept")
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *EXTRA)) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return docs.filter(cascade([r for r, _, _ in ordered(docs, rules)]))


#: The same figures and verdict as SQL for another engine.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
p AS (SELECT DISTINCT r, i + k AS i FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1),
n AS (SELECT r, count(*) AS n_repeat_words FROM p GROUP BY r),
f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR """ + " OR ".join(f"({r.sql})" for r in EXTRA) + """) AS kept
FROM f
"""
