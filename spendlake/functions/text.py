"""Text expressions of purchase records, all inside whole-stage code generation."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables decompose by a rule of their own.
HANGUL = ("\uac00", "\ud7a3")


def _decomposed(code: int) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))


@cache
def _tables() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one without marks, these, and those that decompose to several; marks stand at the end of the first, without a partner."""
    one, gone, several = {}, [], {}
    for code in (*range(0x80, 0xAC00), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
        c, plain = chr(code), _decomposed(code)
        if plain != c:
            if len(plain) == 1:
                one[c] = plain
            elif plain:
                several[c] = plain
            else:
                gone.append(c)
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _class(chars: Sequence[str]) -> str:
    """A regular expression of these characters, neighbours as ranges."""
    codes, out = sorted(map(ord, chars)), []
    for code in codes:
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"


# Unit codes with their dimension and factor to the canonical unit, the pattern that finds them, and bare unit words.
UNIT_CODES = {"KG": ("PESO", 1000.0), "GR": ("PESO", 1.0), "G": ("PESO", 1.0), "ML": ("VOLUME", 1.0), "L": ("VOLUME", 1000.0)}
UNIT_PATTERN = r"(\d+(?:,\d+)?)\s*(KG|GR|ML|L|G)\b"
UNIT_WORDS = {
    "QUILOGRAMA": ("PESO", 1000.0),
    "GRAMA": ("PESO", 1.0),
    "LITRO": ("VOLUME", 1000.0),
    "MILILITRO": ("VOLUME", 1.0),
    "METRO": ("COMPRIMENTO", 1.0),
    "UNIDADE": ("CONTAGEM", None),
    "UN": ("CONTAGEM", None),
}

# Categories of interest, in order, with the words that tell them.
RELEVANT = {
    "TI / Informatica": (
        "computador", "notebook", "software", "licenciamento de uso", "servidor de rede", "impressora",
        "monitor computador", "monitor de video", "storage", "firewall", "antivirus", "roteador",
    ),
    "Telecom": ("telefonia", "link dedicado", "dados moveis", "central telefonica"),
    "Consultoria / Servicos Profissionais": ("consultoria", "auditoria", "assessoria juridica", "advocaticio"),
    "Seguranca / Vigilancia": ("vigilancia patrimonial", "seguranca patrimonial", "monitoramento eletronico", "cftv", "sistema de alarme"),
    "Limpeza / Facilities": ("servico de limpeza", "conservacao predial", "jardinagem", "dedetizacao", "manutencao predial"),
    "Mobiliario / Material de Escritorio": ("mobiliario", "cadeira escritorio", "mesa escritorio", "papel a4", "material de escritorio"),
    "Locacao de Veiculos": ("locacao de veiculo", "locacao veicular", "aluguel de veiculo", "locacao de frota"),
    "Marketing / Publicidade": ("publicidade", "propaganda", "material grafico"),
}

# Known typing errors in item texts.
TYPOS = {"desaude": "de saude"}


def strip_accents(c: Column) -> Column:
    """Text decomposed by compatibility (NFKD), without combining marks; null stays null.

    Texts of ASCII alone, as long in bytes as in characters, stay as they are. Characters that become one other character,
    or none, are translated. Texts that hold any that become several go character by character.
    """
    source, target, several = _tables()
    one = lambda x: F.translate(x, source, target)

    def character(x: Column) -> Column:
        s = F.ascii(x) - 0xAC00
        tail = F.when(s % 28 > 0, F.hex(0x11A7 + s % 28)).otherwise("")
        jamo = F.decode(F.unhex(F.concat(F.hex(0x1100 + F.floor(s / 588)), F.hex(0x1161 + F.floor(s % 588 / 28)), tail)), "UTF-16BE")
        wide = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in several.items())), F.lit("\x02"), F.lit("\x01"))[x]
        return F.when(x.between(*HANGUL), jamo).when(x.rlike(_class(list(several))), wide).otherwise(one(x))

    many = c.rlike(_class(list(several))[:-1] + rf"{HANGUL[0]}-{HANGUL[1]}]")
    return F.when(F.octet_length(c) == F.length(c), c).when(many, F.array_join(F.transform(F.split(c, ""), character), "")).otherwise(one(c))


def _holds(plain: Column, words: Sequence[str]) -> Column:
    return plain.rlike(r"(?iU)\b(?:" + "|".join(words) + r")\b")


def has_word(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words stands in the text as a whole word, whatever its case and accents."""
    return _holds(strip_accents(c), words)


def first_category(c: Column, categories: Mapping[str, Sequence[str]], plain: Column | None = None) -> Column:
    """Name of the first category, in order, one of whose words stands in the text; null if none does. `plain`: the text without accents, if a column has it."""
    plain = strip_accents(c) if plain is None else plain
    every = [x for words in categories.values() for x in words]
    return F.when(_holds(plain, every), F.coalesce(*(F.when(_holds(plain, words), F.lit(name)) for name, words in categories.items())))


def normalize_unit(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def item_key(c: Column, fixes: Mapping[str, str] = TYPOS) -> Column:
    """Lower case without accents, typos replaced as whole words, single spaces; empty becomes null."""
    out = F.lower(strip_accents(c))
    for wrong, right in fixes.items():
        out = F.regexp_replace(out, rf"(?U)\b{wrong}\b", right)
    return F.nullif(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), F.lit(""))


def parse_unit(c: Column) -> tuple[Column, Column]:
    """Dimension and canonical value of a unit text such as `EMBALAGEM 500,00 G`; null where it cannot be read."""
    unit = normalize_unit(c)
    number = F.nullif(F.regexp_replace(F.regexp_extract(unit, UNIT_PATTERN, 1), ",", "."), F.lit("")).try_cast("double")
    code = F.regexp_extract(unit, UNIT_PATTERN, 2)
    dims, factors, word_dims, word_values = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, (dim, factor) in UNIT_CODES.items():
        dims, factors = F.when(code == name, dim).otherwise(dims), F.when(code == name, factor).otherwise(factors)
    for name, (dim, factor) in UNIT_WORDS.items():
        word_dims = F.when(unit == name, dim).otherwise(word_dims)
        word_values = F.when(unit == name, F.lit(factor).cast("double")).otherwise(word_values)
    return F.coalesce(F.when(number.isNotNull(), dims), word_dims), F.coalesce(number * factors, word_values)


def to_boolean(c: Column) -> Column:
    """`true` and `1` in any case are true; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def snippet(c: Column, pattern: str, before: int = 30, after: int = 60) -> Column:
    """Text around the first match of a pattern; null without a match."""
    at = F.regexp_instr(c, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(c, start, at - start + after))


def long_words(c: Column, least: int = 4, stop: Sequence[str] = ()) -> Column:
    """Words `[a-z]+` of the lower-cased text of at least `least` letters and not in `stop`."""
    found = F.regexp_extract_all(F.lower(strip_accents(c)), F.lit("([a-z]+)"))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*stop) if stop else F.length(w) >= least)


def relabel(c: Column, labels: Mapping[str, str]) -> Column:
    """The label of a value, or the value itself where it has none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))[c], c) if labels else c


def contains(c: Column, every: Sequence[str] = (), any_of: Sequence[str] = ()) -> Column:
    """Whether a text holds every text of one list and, if there are any, one of another; accents and case aside."""
    plain = F.lower(strip_accents(c))
    out = F.lit(True)
    for x in every:
        out = out & plain.contains(x)
    some = F.lit(not any_of)
    for x in any_of:
        some = some | plain.contains(x)
    return out & some
