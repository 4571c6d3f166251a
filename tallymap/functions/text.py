"""Repair of delivered attribute text: array literals, pairs, blanks, digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymap.functions.geometry import bind
from tallymap.schema import ARRAY_ATTRIBUTES, TEXT_ATTRIBUTES

# Fixed value: the text that stands for an unknown duration.
UNKNOWN_DURATION = "Durée non définie dans l'acte"


def is_array_literal(c: Column) -> Column:
    return c.startswith("{") & c.endswith("}") & (F.length(c) >= 2)


def _inner(c: Column) -> Column:
    return F.substring(c, F.lit(2), F.length(c) - 2)


def parse_array(c: Column) -> Column:
    """``{a,"b c",NULL}`` to an array; commas inside quotes stay, a bare NULL is null.
    A value that is no literal becomes an array of that one value."""
    tokens = F.regexp_extract_all(_inner(c), F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), 1)

    def value(t: Column) -> Column:
        unquoted = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"\\(.)", "$1")
        return F.when(t.startswith('"'), unquoted).when(F.upper(t) != "NULL", t)

    return F.when(is_array_literal(c), F.transform(tokens, value)).when(c.isNotNull(), F.array(c))


def array_literal(items: Column) -> Column:
    """An array as ``{"a","b",NULL}``."""
    quoted = F.transform(
        items, lambda i: F.concat(F.lit('"'), F.regexp_replace(i, r'(["\\])', r"\\$1"), F.lit('"'))
    )
    return F.concat(F.lit("{"), F.array_join(quoted, ",", "NULL"), F.lit("}"))


def blank_to_null(c: Column) -> Column:
    """Empty text and ``0`` are stored as null."""
    return F.when(~c.isin("", "0"), c)


def plus_to_literal(c: Column) -> Column:
    """Feed arrays ``a+b`` to ``{"a","b"}``; blank to ``{NULL}``."""
    listed = F.concat(F.lit('{"'), F.replace(c, F.lit("+"), F.lit('","')), F.lit('"}'))
    return F.coalesce(F.when(blank_to_null(c).isNotNull(), listed), F.lit("{NULL}"))


def unique_pairs(systems: Column, numbers: Column) -> Column:
    """Struct (si_metier, numero_dossier) of two literals without repeated pairs.

    The i-th items belong together; the first of equal pairs stays, in order. Null becomes
    ``{}``; numbers beyond the systems are dropped, missing ones read as empty. Text that is
    no literal passes unchanged.
    """

    def items(c: Column) -> Column:
        return F.split(F.coalesce(_inner(c), F.lit("")), ",", -1)

    def pair_up(lists: Column) -> Column:
        pairs = F.transform(
            lists["s"],
            lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(lists["n"], i), F.lit("")).alias("n")),
        )
        return bind(pairs, lambda ps: bind(F.transform(ps, label), lambda labels: first_of_each(ps, labels)))

    def label(p: Column) -> Column:
        return F.concat(p["s"], F.lit(":"), p["n"])

    def first_of_each(pairs: Column, labels: Column) -> Column:
        return F.filter(pairs, lambda p, i: F.array_position(labels, label(p)) == i + 1)

    def joined(pairs: Column, field: str) -> Column:
        return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p[field]), ","), F.lit("}"))

    def passes(c: Column) -> Column:
        return c.isNull() | is_array_literal(c)

    kept = bind(F.struct(items(systems).alias("s"), items(numbers).alias("n")), pair_up)
    result = bind(
        kept, lambda ps: F.struct(joined(ps, "s").alias("si_metier"), joined(ps, "n").alias("numero_dossier"))
    )
    unchanged = F.struct(systems.alias("si_metier"), numbers.alias("numero_dossier"))
    return F.when(passes(systems) & passes(numbers), result).otherwise(unchanged)


def fingerprint(columns: dict[str, Column] | None = None) -> Column:
    """MD5 of the 13 attributes, each followed by ``/``; null counts as empty and the quotes
    of array literals are left out."""
    pieces = []
    for name in TEXT_ATTRIBUTES:
        c = (columns or {}).get(name, F.col(name)).cast("string")
        if name in ARRAY_ATTRIBUTES:
            c = F.replace(c, F.lit('"'), F.lit(""))
        pieces += [F.coalesce(c, F.lit("")), F.lit("/")]
    return F.md5(F.concat(*pieces))


def duration_label(amount: Column, unit: Column) -> Column:
    """``12 Mois(s)``; rounds halves up; the fixed text when amount or unit is unknown."""
    known = F.concat(F.round(amount).cast("bigint").cast("string"), F.lit(" "), unit, F.lit("(s)"))
    return F.coalesce(known, F.lit(UNKNOWN_DURATION))


def level_label(length: Column) -> Column:
    """Name of a classification level by the length of its code."""
    return F.when(length == 1, "Classe").when(length == 2, "Type").otherwise("sous-categorie")
