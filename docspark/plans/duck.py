"""Pieces of DuckDB SQL that several statements share."""

from __future__ import annotations

NUMBER = r"[0-9]+(?:[.,][0-9]+)*"


def clean(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, 'R\$|[$%\s]', '', 'g'), '[.,]+$', '')"


def token(t: str) -> str:
    """One number token as double."""
    full = lambda p: f"regexp_full_match({t}, '{p}')"

    def dec(mark: str) -> str:
        return rf"(TRY_CAST(regexp_replace(regexp_replace({t}, '[{mark}][0-9]+$', ''), '[.,]', '', 'g') AS DOUBLE) + TRY_CAST('0.' || regexp_extract({t}, '[{mark}]([0-9]+)$', 1) AS DOUBLE))"

    drop = lambda mark: f"TRY_CAST(replace({t}, '{mark}', '') AS DOUBLE)"
    return (
        f"CASE WHEN NOT {full('[0-9][0-9.,]*')} THEN NULL WHEN {full('[0-9]+')} THEN TRY_CAST({t} AS DOUBLE) "
        f"WHEN {full('[0-9]{1,3}(,[0-9]{3})+[.][0-9]+')} THEN {dec('.')} WHEN {full('[0-9]{1,3}([.][0-9]{3})+,[0-9]+')} THEN {dec(',')} "
        f"WHEN contains({t}, '.') AND contains({t}, ',') THEN NULL "
        f"WHEN {full('[0-9]{1,3}([.][0-9]{3}){2,}')} THEN {drop('.')} WHEN {full('[0-9]{1,3}(,[0-9]{3}){2,}')} THEN {drop(',')} "
        f"WHEN {full('[0-9]+[.][0-9]{3}')} THEN {drop('.')} WHEN {full('[0-9]+,[0-9]{3}')} THEN {drop(',')} "
        f"WHEN {full('[0-9]{1,18}[.][0-9]+')} OR ({full('[0-9]{1,3}([.][0-9]{3})+[.][0-9]+')} AND NOT regexp_matches({t}, '[.][0-9]{{3}}$')) THEN {dec('.')} "
        f"WHEN {full('[0-9]{1,18},[0-9]+')} OR ({full('[0-9]{1,3}(,[0-9]{3})+,[0-9]+')} AND NOT regexp_matches({t}, ',[0-9]{{3}}$')) THEN {dec(',')} END"
    )


def tokens(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{NUMBER}')"


def decimals(t: str) -> str:
    return f"CASE WHEN (regexp_matches({t}, '[.,][0-9]{{3}}$') AND NOT (contains({t}, '.') AND contains({t}, ','))) OR NOT regexp_matches({t}, '[.,]') THEN 0 ELSE length(regexp_extract({t}, '([0-9]*)$', 1)) END"


def number(text: str) -> str:
    """The number that a text means."""
    ts = tokens(text)
    precise = f"list_filter({ts}, lambda t: {decimals('t')} >= 2)"
    read = f"list_filter(list_transform({ts}, lambda t: {token('t')}), lambda v: v IS NOT NULL)"
    last = f"list_extract(list_transform({precise}, lambda t: {token('t')}), -1)"
    return f"CASE WHEN len({ts}) = 0 THEN NULL WHEN len({ts}) = 1 THEN list_extract(list_transform({ts}, lambda t: {token('t')}), 1) WHEN len({precise}) > 0 THEN {last} ELSE list_extract({read}, -1) END"


def first(text: str) -> str:
    return f"list_extract(list_filter(list_transform({tokens(text)}, lambda t: {token('t')}), lambda v: v IS NOT NULL), 1)"


def brazilian(v: str) -> str:
    return f"translate(format('{{:,.2f}}', {v}), ',.', '.,')"


def check_digit(base: str) -> str:
    total = f"list_sum(list_transform(range(0, 43), lambda i: CAST({base}[43 - i] AS INT) * (i % 8 + 2)))"
    return f"CASE WHEN 11 - {total} % 11 >= 10 THEN 0 ELSE 11 - {total} % 11 END"
