"""Text functions as Column expressions: accents, compaction, codes, glued cells, descriptions."""

from __future__ import annotations

import functools
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import numbers

# The Korean syllables are made of 19 first, 21 middle and 28 last letters (none is the first of the last), in order.
SYLLABLES, FIRST, MIDDLE, LAST = 0xAC00, 0x1100, 0x1161, 0x11A7
MIDDLES, LASTS, SYLLABLE_END = 21, 28, 0xD7A3
GAP = 4  # characters nearer than this are tested as one range
EARLY = 0x580  # from here on characters are rare in texts of Latin letters


@functools.cache
def _folded() -> tuple[str, str, str, str, str]:
    """For all characters with a compatibility form or a mark: those that become one character and then those that go, what the first become, the others as JSON, a short and a longer pattern that all of the others fit."""
    one, gone, several = {}, [], {}
    for code in (*range(0x80, SYLLABLES), *range(SYLLABLE_END + 1, 0xD800), *range(0xE000, 0x110000)):
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare:
            gone.append(c)
        elif len(bare) > 1:
            several[c] = bare
        elif bare != c:
            one[c] = bare
    ranges = [[SYLLABLES, SYLLABLE_END]]
    for code in map(ord, several):
        near = next((r for r in ranges[1:] if code - r[1] <= GAP), None)
        if near:
            near[1] = code
        else:
            ranges.append([code, code])
    fits = lambda rs: "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in rs) + "]"
    return "".join([*one, *gone]), "".join(one.values()), json.dumps(several), fits([r for r in ranges if r[1] < EARLY] + [[EARLY, 0x10FFFF]]), fits(ranges)


# Units of measure, those of volume, and marks that end a description.
UNITS = (
    "TON", "TONS", "TN", "KG", "KGL", "KGS", "KGSC", "UN", "UND", "UNID", "UNI", "PC", "PCS", "L", "LT", "M", "M2", "M3", "SC", "CX",
    "GL", "BAG", "BIGBAG", "DZ", "FD", "BB", "DOSE", "HA", "ML", "T", "MIL", "G",
)
VOLUME_UNITS = ("L", "LT", "LTS", "LTR", "LITRO", "LITROS")
DESCRIPTION_ENDS = (
    "obs", "origem", "icms", "inscricao", "calculodo", "informacoes", "reservado", "dadosadicionais", "valortotal", "base", "lote",
    "b.c", "bc.", "reg.min", "regmapa", "aplicacao", "viasolo",
)
DATE, CNPJ, CPF = r"\d{2}/\d{2}/\d{4}", r"\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}", r"\d{3}\.\d{3}\.\d{3}-\d{2}"
VALUE = r"\d{1,3}(?:\.\d{3})*,\d{2}"


def strip_accents(text: Column) -> Column:
    """Compatibility forms without combining marks, for every character: letters lose their accents, ligatures part, raised and circled signs become plain.

    ASCII texts stay as they are; only texts with a character that becomes several are taken apart.
    """
    given, made, several, short, pattern = _folded()
    letters = F.from_json(F.lit(several), "map<string,string>")  # one constant in the plan
    jamo = "".join(map(chr, range(FIRST, FIRST + 19))), "".join(map(chr, range(MIDDLE, MIDDLE + MIDDLES))), "".join(map(chr, range(LAST + 1, LAST + LASTS)))

    def taken_apart(c: Column) -> Column:
        at = F.ascii(c) - SYLLABLES
        last = F.pmod(at, F.lit(LASTS))
        parts = F.substring(F.lit(jamo[0]), (at / (MIDDLES * LASTS)).cast("int") + 1, F.lit(1)), F.substring(F.lit(jamo[1]), F.pmod((at / LASTS).cast("int"), F.lit(MIDDLES)) + 1, F.lit(1)), F.when(last > 0, F.substring(F.lit(jamo[2]), last, F.lit(1))).otherwise("")
        return F.when(c.between(chr(SYLLABLES), chr(SYLLABLE_END)), F.concat(*parts)).when(c.rlike(pattern), F.coalesce(letters[c], c)).otherwise(c)

    parted = F.when(text.rlike(short) & text.rlike(pattern), F.array_join(F.transform(F.split(text, ""), taken_apart), "")).otherwise(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(parted, given, made)).otherwise(text)


def normalise(text: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(text))


def compact(text: Column) -> Column:
    """Only letters and digits of the normalised text."""
    return F.regexp_replace(normalise(text), r"[^\p{L}\p{N}]", "")


def extract_or_null(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, trimmed; null where there is none (T5)."""
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, group)))


def distinct_ids(text: Column, pattern: str = CNPJ) -> Column:
    """Digits of all matches, distinct, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s: F.regexp_replace(s, r"\D", "")))


def fix_code(code: Column) -> Column:
    """A product code whose digits were read as letters; what has code shape stays."""
    shape = r"^[A-Za-z]{1,4}\d{2,8}$"
    mapped = F.translate(code, "OoIilSsBZG", "0011155826")
    return F.when(code.rlike(shape), code).when(code.rlike(r"^[A-Za-z0-9]{2,12}$") & mapped.rlike(shape), mapped).otherwise(code)


def split_glued(token: Column) -> Column:
    """Cells that were read as one token, apart."""
    blocks = F.filter(F.transform(F.split(F.coalesce(token, F.lit("")), r"\|"), lambda b: F.trim(b)), lambda b: b != "")

    def parts(b: Column) -> Column:
        cut = lambda pattern, n: F.array(*[F.regexp_extract(b, pattern, i + 1) for i in range(n)])
        one, two, four = r"^(\d{4,8})([A-Za-z]{1,5})$", r"^([A-Za-z]{1,5})(\d{4,8})$", r"^(\d{8})(\d{1,3})(\d{4})([A-Za-z]{1,5})$"
        return F.when(b.rlike(one), cut(one, 2)).when(b.rlike(two), cut(two, 2)).when(b.rlike(four), cut(four, 4)).otherwise(F.array(b))

    return F.flatten(F.transform(blocks, parts))


def classify(token: Column) -> Column:
    """The product column that a token's shape names, or null."""
    t = F.trim(token)
    return (
        F.when(t.rlike(r"^\d{8}$"), "ncm").when(t.rlike(r"^[1-7]\d{3}$"), "cfop").when(t.rlike(r"^\d{1,3}/\d{1,2}$"), "origem_cst")
        .when(F.upper(t).isin(*UNITS), "unidade").when(t.rlike(r"^[A-Za-z]{1,4}\d{2,8}$"), "codigo").when(t.rlike(r"^\d{2,3}$"), "origem_cst")
    )


def clean_description(text: Column) -> Column:
    """One-spaced text up to the first mark of another section, without outer punctuation."""
    one_spaced = F.trim(F.regexp_replace(text, r"\s+", " "))

    def cut(s: Column) -> Column:
        places = [F.nullif(F.locate(m, s["low"]), F.lit(0)) for m in DESCRIPTION_ENDS]
        bare = F.regexp_replace(F.substring(s["t"], F.lit(1), F.least(*places, F.length(s["t"]) + 1) - 1), r"^[ .,;:\-]+|[ .,;:\-]+$", "")
        return F.nullif(bare, F.lit(""))

    return numbers.let(one_spaced, lambda t: numbers.let(F.struct(t.alias("t"), F.lower(t).alias("low")), cut))


def operation_nature(text: Column) -> Column:
    """Text before a trailing upper-case label."""
    return F.split(text, r"\s+[A-ZÀ-Ú]{2,}[\s(]").getItem(0)


def state_of(text: Column) -> Column:
    """The two capitals a glued state cell begins with."""
    return F.when(text.rlike("^[A-Z]{2}"), F.substring(text, 1, 2)).otherwise(text)


def country_of(text: Column) -> Column:
    """A country cell without a state glued before it."""
    return F.regexp_replace(text, r"^[A-Z]{2}(?=[A-ZÀ-Ú])", "")


def checked_address(address: Column, name: Column) -> Column:
    """Null where the address is only digits or repeats the name."""
    digits = F.length(F.regexp_replace(address, r"\D", ""))
    bad = (~address.rlike(r"\p{L}") & (digits >= 6)) | (compact(address) == compact(name))
    return F.when(F.coalesce(bad, F.lit(False)), None).otherwise(address)


def series_of(text: Column) -> Column:
    """First run of digits without leading zeros."""
    return F.regexp_extract(text, r"\d+", 0).try_cast("int").cast("string")


def clean_code(code: Column) -> Column:
    """First word where it has code shape and others follow."""
    first = F.split(F.trim(code), r"\s+").getItem(0)
    return F.when(F.trim(code).rlike(r"\s") & first.rlike(r"^[A-Za-z]{1,4}\d{2,8}$"), first).otherwise(code)


def clean_cfop(cfop: Column) -> Column:
    """First four digits of an operation code with something after them."""
    return F.when(F.trim(cfop).rlike(r"^\d{4}"), F.substring(F.trim(cfop), 1, 4)).otherwise(cfop)


def file_size(size: Column) -> Column:
    """Bytes as B, kB or MB."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.format_number(size / 1024, 1), F.lit(" kB"))).otherwise(F.concat(F.format_number(size / (1024 * 1024), 1), F.lit(" MB")))
