"""Personal data in texts, also where it is disguised, with places in the text as it stands.

Base: e-mail addresses, IP addresses, card numbers and phone numbers as patterns find them in the text itself,
leftmost and not overlapping within a kind; a match that fails its check (parts of an address, Luhn sum, number of
digits) is dropped and nothing else is tried in its place.

Disguises: two transducers rewrite a text and keep, for every character they write, the place it comes from. The first
goes character by character: letters and digits that look like ASCII ones (other alphabets, full width,
mathematical), digits of any script, dashes, spaces, dots and signs become their ASCII character, characters without
width go. The second goes by tokens: spelled digits (three or more in a row, in four languages), bracketed or spaced
words for @ and dot. A bare "at" counts only before a name that goes on with a bracketed dot, or with spelled
ones up to a common end such as "com", so prose stays as it is. The patterns then run over what each has written, and spans are brought back to the text. A span
within another of its kind is left out; base spans always stay.

Nothing is rewritten in rows that neither hold a character of the first kind nor a token of the second, which is
found for a whole batch by word hashes in numpy.

Rows: null and empty texts have no spans. Long texts are searched whole, in time that is linear in their length.
Repeated rows get a result each; a null `doc_id` is kept. Spans of one place but different kinds all stay. Columns
named as the result are replaced, all others kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other alphabets and the ASCII letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u", "օ": "o",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
    "ı": "i", "İ": "I", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ℓ": "l", "。": ".", "｡": ".", "․": ".", "·": ".", "•": ".", "﹒": ".", "﹫": "@",
}
#: Characters without width.
UNSEEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufe0e\ufe0f\ufeff"
#: Words for the digits from 0 on.
DIGITS = {
    "en": "zero one two three four five six seven eight nine",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
}
#: Words for @ and for a dot.
AT = ("at", "arroba", "arobase", "ät")
DOT = ("dot", "punto", "point", "punkt")

#: Ends of names that a wholly spelled address must have, as other words may follow a bare "dot".
ENDS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "ai", "co", "dev", "app", "me", "eu", "de", "fr", "es", "it", "uk", "us", "ch", "at", "nl", "be", "pt", "mx", "ar", "br", "ca", "example", "test")

SPELLED = {w: str(k) for words in DIGITS.values() for k, w in enumerate(words.split())} | {"oh": "0"}
_IN_A_ROW = 3


class _Glyphs(dict):
    """What the first transducer writes for a character code; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = c
        if code > 0x7F:
            plain = unicodedata.normalize("NFKC", c)
            if c in LOOKALIKES:
                out = LOOKALIKES[c]
            elif c in UNSEEN:
                out = ""
            elif unicodedata.category(c) == "Pd" or c == "−":
                out = "-"
            elif unicodedata.category(c) == "Zs":
                out = " "
            elif (digit := unicodedata.decimal(c, None)) is not None:
                out = str(digit)
            elif len(plain) == 1 and plain != c:
                out = plain if plain < "\x7f" else LOOKALIKES.get(plain, c)
        self[code] = out
        return out


GLYPHS = _Glyphs()


def _any(words) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, words), key=lambda w: (-len(w), w))) + ")"


_OPEN, _CLOSE = r"[(\[{<]\s{0,3}", r"\s{0,3}[)\]}>]"
_AT_BOX = rf"\s{{0,3}}{_OPEN}(?:{_any(AT)}|@){_CLOSE}\s{{0,3}}"
_DOT_BOX = rf"\s{{0,3}}{_OPEN}(?:{_any(DOT)}|\.){_CLOSE}\s{{0,3}}"
_DOT_BARE = rf"\s{{1,3}}{_any(DOT)}\s{{1,3}}(?=[A-Za-z0-9])"
_WORD_DIGIT = rf"(?<![A-Za-z0-9]){_any(SPELLED)}(?![A-Za-z0-9])"
_BETWEEN = r"[ \t-]{1,2}"
_NAME = "[A-Za-z0-9-]{1,63}"
_TOKENS = re.compile(
    rf"(?P<at>{_AT_BOX}|\s{{1,3}}{_any(AT)}\s{{1,3}}(?={_NAME}(?:{_DOT_BOX}|(?:(?:\.|{_DOT_BOX}|{_DOT_BARE}){_NAME}){{0,4}}{_DOT_BARE}{_any(ENDS)}(?![A-Za-z0-9])))|(?<=[A-Za-z0-9])\s{{1,3}}@\s{{1,3}}(?=[A-Za-z0-9]))"
    rf"|(?P<dot>{_DOT_BOX}|{_DOT_BARE})"
    rf"|(?P<digits>{_WORD_DIGIT}(?:{_BETWEEN}{_WORD_DIGIT}){{{_IN_A_ROW - 1},}})"
    rf"|(?P<plus>(?<![A-Za-z0-9])plus {{1,3}}(?=[0-9]|{_WORD_DIGIT}{_BETWEEN}))",
    re.IGNORECASE,
)
_DIGIT_WORD = re.compile(_any(SPELLED), re.IGNORECASE)
#: A row without any of these, without a spelled dot and without spelled digits in a row is as the second transducer leaves it.
_BOXED = re.compile(rf"{_OPEN}(?:{_any(AT)}|{_any(DOT)}|@|\.){_CLOSE}", re.IGNORECASE)
_SPACED = re.compile(r"\s@\s|(?<![A-Za-z0-9])plus {1,3}[0-9]", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(t: str) -> Iterator[tuple[int, int]]:
    """From each @ the name before it, as far as no match before has taken it, and the domain after it."""
    done, at = 0, t.find("@")
    while at >= 0:
        found = _DOMAIN.match(t, at)
        if found:
            begin = at
            while begin > done and t[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            if begin < at:
                yield begin, found.end()
                done = found.end()
        at = t.find("@", max(at + 1, done))


def _digits(t: str) -> str:
    return "".join(c for c in t if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """Number of the kind, start and end of each match that passes its check."""
    out = [(0, a, b) for a, b in emails(t)]
    out += [(1, *m.span()) for m in _IP.finditer(t) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() <= 38 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in t:
        out += [(3, *m.span()) for m in _PHONE.finditer(t) if 8 <= len(_digits(m.group())) <= 15]
    return out


Mapped = tuple[str, np.ndarray, np.ndarray]


def characters(t: str) -> Mapped:
    """What the first transducer writes, and for each character the start and end of what it stands for."""
    size = np.array([len(GLYPHS[ord(c)]) for c in t], np.int64)
    at = np.repeat(np.arange(len(t)), size)
    return t.translate(GLYPHS), at, at + 1


def tokens(mapped: Mapped) -> Mapped:
    """What the second transducer writes, with places in the text that the first has read."""
    t, begin, end = mapped
    out, first, last, done = [], [], [], 0
    for m in _TOKENS.finditer(t):
        out.append(t[done : m.start()])
        first.append(begin[done : m.start()])
        last.append(end[done : m.start()])
        if m.lastgroup == "digits":
            for d in _DIGIT_WORD.finditer(m.group()):
                out.append(SPELLED.get(d.group().lower(), "-"))
                first.append(begin[m.start() + d.start()][None])
                last.append(end[m.start() + d.end() - 1][None])
        else:
            out.append({"at": "@", "dot": ".", "plus": "+"}[m.lastgroup])
            first.append(begin[m.start()][None])
            last.append(end[m.end() - 1][None])
        done = m.end()
    return "".join([*out, t[done:]]), np.concatenate([*first, begin[done:]]), np.concatenate([*last, end[done:]])


def disguised_spans(t: str) -> set[tuple[int, int, int]]:
    """Spans that the patterns find in what the transducers write, as places in `t`."""
    out = set()
    one = characters(t)
    for written, begin, end in (one, tokens(one)):
        if written != t:
            out |= {(k, int(begin[a]), int(end[b - 1])) for k, a, b in base_spans(written)}
    return out


def spans(t: str, suspect: bool) -> list[tuple[int, int, int, bool]]:
    """Kind, start, end and whether it is a base span, in this order; `suspect`: the transducers may change the text."""
    base = sorted(base_spans(t))
    out = [(*s, True) for s in base]
    if suspect:
        upto = [0] * len(KINDS)
        for kind, a, last, added in sorted([(k, a, -b, 0) for k, a, b in base] + [(k, a, -b, 1) for k, a, b in disguised_spans(t)]):
            if added and -last > upto[kind]:  # not within one that begins before or with it
                out.append((kind, a, -last, False))
            upto[kind] = max(upto[kind], -last)
    return sorted(out)


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _hashed(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(text.word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


def suspects(column: pa.Array, texts: list[str]) -> np.ndarray:
    """Rows that the transducers may change."""
    data, offsets = text.buffers(column)
    data = text.LOWER[data]
    starts, ends, first = text.spans(data, offsets, _LETTERS)
    out = np.zeros(len(texts), dtype=bool)
    short = np.flatnonzero(ends - starts <= 16)
    hashes = np.zeros(len(starts), np.uint64)
    hashes[short] = text.word_hashes(data, starts[short], ends[short])
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    out[row[np.isin(hashes, _hashed(DOT))]] = True
    digit = np.flatnonzero(np.isin(hashes, _hashed(SPELLED)))
    third = digit[2:][digit[2:] - digit[:-2] == 2]
    out[row[third]] = True  # also where the row changes in between, which does no harm
    for k, t in enumerate(texts):
        if not out[k]:
            out[k] = (not t.isascii() and any(c > "\x7f" and GLYPHS[ord(c)] != c for c in set(t))) or bool(_BOXED.search(t))
            out[k] |= ("@" in t or "plus " in t.lower()) and bool(_SPACED.search(t))
    return out


def find(docs: DataFrame, result: str = "pii") -> DataFrame:
    """`docs` with `result`, the list of (kind, start, end, base) by kind and start; code points, end exclusive."""
    names = [c for c in docs.columns if c != result]
    rows = docs.select(F.coalesce("text", F.lit("")).alias("t"), F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in names)).alias("r"))

    def job(batches):
        for batch in batches:
            for part in text.slices(batch, "t"):
                texts = part.column("t").to_pylist()
                found = [spans(t, bool(s)) for t, s in zip(texts, suspects(part.column("t"), texts), strict=True)]
                flat = [s for each in found for s in each]
                kind, start, end, base = zip(*flat, strict=True) if flat else ((), (), (), ())
                items = pa.StructArray.from_arrays(
                    [pa.array([KINDS[k] for k in kind], pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(base, pa.bool_())], ["kind", "start", "end", "base"]
                )
                cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("r"), pa.ListArray.from_arrays(cut, items)], ["r", "found"])

    item = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean")
    out = rows.select("r", "t").mapInArrow(job, T.StructType([rows.schema["r"]]).add("found", T.ArrayType(item)))
    return out.select(*(F.col("r").getField(c).alias(c) for c in names), F.col("found").alias(result))


def masked(docs: DataFrame, result: str = "masked") -> DataFrame:
    """`docs` with `result`, the text with each span replaced by its kind in angle brackets; of spans that overlap the first, then the longest, counts."""
    ordered = F.sort_array(F.transform("_pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        # text between what is done and the span, then the kind
        taken = F.struct(F.concat(acc["out"], F.substring("text", (acc["done"] + 1).cast("int"), (s["start"] - acc["done"]).cast("int")), F.lit("<"), s["kind"], F.lit(">")).alias("out"), (-s["last"]).alias("done"))
        return F.when(s["start"] >= acc["done"], taken).otherwise(acc)

    text_ = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring("text", (acc["done"] + 1).cast("int"), F.lit(2**31 - 1))))
    return find(docs, "_pii").withColumn(result, F.when(F.col("text").isNotNull(), text_)).drop("_pii")


def digest(docs: DataFrame) -> DataFrame:
    """`doc_id`, the number of base spans of each kind, a hash of these and all spans as `kind:start:end`."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("_pii", lambda s: s["base"])
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    found = find(docs.select("doc_id", "text"), "_pii")
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("_pii", shown), ",").alias("spans"))
