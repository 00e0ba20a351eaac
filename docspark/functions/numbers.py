"""Locale-aware number parsing as Column expressions (no UDF), with a status for every value.

Parsing never fails: what can't be read gives null. Signs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d+(?:[.,]\d+)*"

# Inclusive plausible bounds of each field.
RANGES = {
    "valor_da_nota": (0.0, 50_000_000.0), "peso_bruto": (0.0, 10_000_000.0), "peso_liquido": (0.0, 10_000_000.0),
    "quantidade": (0.0, 1_000_000.0), "valor_unitario": (0.0, 10_000_000.0), "desconto": (0.0, 10_000_000.0),
    "valor_total": (0.0, 50_000_000.0), "bc_icms": (0.0, 50_000_000.0), "valor_icms": (0.0, 10_000_000.0),
    "valor_ipi": (0.0, 10_000_000.0), "aliquota": (0.0, 100.0),
}
# All statuses in report order, and those to review.
STATUSES = ("ok", "limpio", "recuperado", "reubicado", "no_parseable", "fuera_rango", "vacio")
TO_REVIEW = ("no_parseable", "fuera_rango", "recuperado", "reubicado")
NO_READING = "no se puede interpretar de forma fiable"
NO_RELIABLE = "texto con varios numeros pero ninguno fiable"
SEVERAL = "texto con varios numeros; se tomo el relevante"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use).getItem(0)


def number_tokens(text: Column) -> Column:
    """All number tokens of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def clean_token(token: Column) -> Column:
    """Without currency and percent signs, blanks and trailing separators."""
    return F.regexp_replace(F.regexp_replace(token, r"R\$|[$%\s]", ""), r"[.,]+$", "")


def _plain(token: Column, drop: str) -> Column:
    return F.replace(token, F.lit(drop), F.lit("")).try_cast("double")


def _decimal(token: Column, mark: str) -> Column:
    """Whole part plus fraction, as two parts of a sum."""
    whole = F.regexp_replace(F.regexp_extract(token, rf"^(.*)[{mark}]\d+$", 1), "[.,]", "")
    return whole.try_cast("double") + F.concat(F.lit("0."), F.regexp_extract(token, rf"[{mark}](\d+)$", 1)).try_cast("double")


def parse_token(token: Column) -> Column:
    """One number token as double, or null where its groups are broken."""
    return let(clean_token(token), lambda t: F.when(t.rlike(r"^\d[\d.,]*$"), _read_token(t)))


def _read_token(t: Column) -> Column:
    """The rules, for a clean token as ``number_tokens`` gives it."""
    return (
        F.when(~t.contains(".") & ~t.contains(","), t.try_cast("double"))
        .when(t.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), _decimal(t, "."))
        .when(t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), _decimal(t, ","))
        .when(t.contains(".") & t.contains(","), None)
        .when(t.rlike(r"^\d{1,3}(\.\d{3}){2,}$"), _plain(t, "."))
        .when(t.rlike(r"^\d{1,3}(,\d{3}){2,}$"), _plain(t, ","))
        .when(t.rlike(r"^\d+\.\d{3}$"), _plain(t, "."))
        .when(t.rlike(r"^\d+,\d{3}$"), _plain(t, ","))
        .when(t.rlike(r"^\d{1,18}\.\d+$") | (t.rlike(r"^\d{1,3}(\.\d{3})+\.\d+$") & ~t.rlike(r"\.\d{3}$")), _decimal(t, "."))
        .when(t.rlike(r"^\d{1,18},\d+$") | (t.rlike(r"^\d{1,3}(,\d{3})+,\d+$") & ~t.rlike(r",\d{3}$")), _decimal(t, ","))
    )


def decimals(token: Column) -> Column:
    """Digits after the last separator; one kind of separator before three digits counts as grouping."""
    return let(clean_token(token), _count_decimals)


def _count_decimals(t: Column) -> Column:
    groups = t.rlike(r"[.,]\d{3}$") & ~(t.contains(".") & t.contains(","))
    return F.when(groups | ~t.rlike("[.,]"), 0).otherwise(F.length(F.regexp_extract(t, r"(\d*)$", 1)))


def parse_number(text: Column) -> Column:
    """Of several numbers the last with two or more decimals, else the last readable one."""
    return let(number_tokens(text), _choose_number)


def _choose_number(tokens: Column) -> Column:
    """The number that a text's tokens mean; they are named several times, so they must be computed already."""
    read = F.transform(tokens, lambda t: F.struct(_read_token(t).alias("v"), _count_decimals(t).alias("d")))

    def choose(p: Column) -> Column:
        precise = F.try_element_at(F.filter(p, lambda x: x["d"] >= 2), F.lit(-1))
        last = F.try_element_at(F.filter(p, lambda x: x["v"].isNotNull()), F.lit(-1))
        return F.when(F.exists(p, lambda x: x["d"] >= 2), precise["v"]).otherwise(last["v"])

    return F.when(F.size(tokens) == 1, _read_token(F.get(tokens, F.lit(0)))).when(F.size(tokens) > 1, let(read, choose))


def first_number(text: Column) -> Column:
    """The first readable number."""
    return F.try_element_at(F.filter(F.transform(number_tokens(text), _read_token), lambda v: v.isNotNull()), F.lit(1))


def field_status(raw: Column, field: str) -> Column:
    """Struct ``valor, estado, motivo`` of a raw text cell (N9 with the bounds of P9)."""
    low, high = RANGES.get(field, (float("-inf"), float("inf")))

    def judge(s: Column) -> Column:
        value, n, blank = s["v"], s["n"], s["blank"]
        state = F.when(blank, "vacio").when(value.isNull(), "no_parseable").when(~value.between(low, high), "fuera_rango").when(n > 1, "limpio").otherwise("ok")
        reason = F.when(blank, "vacio").when(value.isNull(), F.when(n > 1, NO_RELIABLE).otherwise(NO_READING)).when(~value.between(low, high), f"fuera del rango plausible para '{field}'").when(n > 1, SEVERAL).otherwise("")
        return F.struct(F.when(~blank & value.between(low, high), value).alias("valor"), state.alias("estado"), reason.alias("motivo"))

    def read(s: Column) -> Column:
        return let(F.struct(_choose_number(s["t"]).alias("v"), F.size(s["t"]).alias("n"), (s["r"].isNull() | (F.trim(s["r"]) == "")).alias("blank")), judge)

    return let(raw, lambda r: let(F.struct(r.alias("r"), number_tokens(r).alias("t")), read))


def readings(token: Column) -> Column:
    """Plausible values of an ambiguous token: as parsed, as three decimals, with a lost final zero."""
    t = F.trim(token)
    three = F.when(t.rlike(r"^\d{1,3}[.,]\d{3}$"), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))
    lost = F.when(t.rlike(r"^\d{1,3}([.,]\d{3})*[.,]\d$"), parse_number(F.concat(F.regexp_replace(t, r"[.,](\d)$", ".$1"), F.lit("0"))))
    return F.array_distinct(F.array_compact(F.array(parse_number(t), three, lost)))


def recover_quantity(quantity: Column, unit: Column, description: Column, raw_price: Column) -> Column:
    """A missing quantity from the unit cell, the description or a price cell with two numbers."""
    top = RANGES["quantidade"][1]
    inside = first_number(unit)
    named = parse_number(F.regexp_extract(F.coalesce(description, F.lit("")), r"[Qq]tde[:.\s]*(\d[\d.,]*)", 1))
    paired = F.when(F.size(number_tokens(raw_price)) >= 2, first_number(raw_price))
    missing = quantity.isNull() | (quantity == 0)

    def choose(s: Column) -> Column:
        origin = F.when(s["u"].isNotNull(), "unidade").when(s["d"].isNotNull(), "descricao").when(s["p"].isNotNull(), "valor_unitario")
        found = F.coalesce(s["u"], s["d"], s["p"])
        taken = missing & (found > 0) & (found <= top)
        return F.struct(F.when(taken, found).otherwise(quantity).alias("quantidade"), F.when(taken, origin).alias("origen"))

    return let(F.struct(inside.alias("u"), named.alias("d"), paired.alias("p")), choose)


def strip_unit_number(unit: Column) -> Column:
    """A unit without the number stuck to its end."""
    bare = F.trim(F.regexp_replace(unit, r"\s*\d[\d.,]*\s*$", ""))
    return F.when(unit.rlike(r"\d") & (bare != ""), bare).otherwise(unit)
