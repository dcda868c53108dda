"""Column expressions for text: folding, numbers, dates and slugs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED, _PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Another spelling of September.
SETIEMBRE = "setiembre"
_MONTH_NUMBERS = {m: k for k, m in enumerate(MONTHS, 1)} | {SETIEMBRE: 9}
#: Spanish numbers in words, folded.
SPELLED = {
    "un": 1, "uno": 1, "primer": 1, "primero": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9, "diez": 10,
    "once": 11, "doce": 12, "trece": 13, "catorce": 14, "quince": 15, "dieciseis": 16, "diecisiete": 17, "dieciocho": 18, "diecinueve": 19, "veinte": 20,
    "veintiun": 21, "veintiuno": 21, "veintidos": 22, "veintitres": 23, "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27,
    "veintiocho": 28, "veintinueve": 29, "treinta": 30, "treintayuno": 31, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80,
    "noventa": 90,
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` worked out once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), r"\A\s+|\s+\z", "")


def unaccent(c: Column | str) -> Column:
    return F.translate(col(c), _ACCENTED, _PLAIN)


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return F.lower(unaccent(c))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def all_found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def safe_int(c: Column | str) -> Column:
    """The first white-space token without trailing ``.``, ``-`` and ``/`` as int, else null."""
    token = F.regexp_extract(F.trim(col(c)), r"^(\S+)", 1)
    return F.regexp_replace(token, r"[./-]+$", "").try_cast("int")


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def record_slug(kind: Column, number: Column, year: Column, content_id: Column, title: Column) -> Column:
    """kind-number-year, else kind-number, else kind-title, else kind-content id; the number has four digits at least."""
    n = F.lpad(number.cast("string"), 4, "0")
    n = F.when(F.length(number.cast("string")) >= 4, number.cast("string")).otherwise(n)
    s = slugify(title)
    return F.coalesce(F.when(number.isNotNull() & year.isNotNull(), F.concat_ws("-", kind, n, year.cast("string"))), F.when(number.isNotNull(), F.concat_ws("-", kind, n)), F.when(F.length(s) > 0, F.concat_ws("-", kind, s)), F.concat_ws("-", kind, content_id.cast("string")))


def clean_spaces(c: Column | str) -> Column:
    """Single spaces, none before punctuation or line ends, and two line breaks in a row at most."""
    out = F.regexp_replace(col(c), "\\x{00A0}", " ")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, " +([,.;:])", "$1")
    out = F.regexp_replace(out, " *\\n *", "\n")
    return strip(F.regexp_replace(out, "\\n{3,}", "\n\n"))


def parse_date(c: Column | str) -> Column:
    """The first date in the text: dd/MM/yyyy (or d/M), ISO, or '31 de marzo de 1986'; unknown gives null."""
    t = col(c)
    dmy = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
    words = r"(?iu)\b(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})\b"
    month = F.element_at(F.create_map(*[F.lit(x) for m, k in _MONTH_NUMBERS.items() for x in (m, k)]), fold(F.regexp_extract(t, words, 2)))
    iso = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    return F.coalesce(
        _date(F.regexp_extract(t, dmy, 3), F.regexp_extract(t, dmy, 2), F.regexp_extract(t, dmy, 1)),
        _date(F.regexp_extract(t, iso, 1), F.regexp_extract(t, iso, 2), F.regexp_extract(t, iso, 3)),
        _date(F.regexp_extract(t, words, 3), month.cast("string"), F.regexp_extract(t, words, 1)),
    )


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def _spelled(c: Column) -> Column:
    """A number under 100 in words, folded: one word, or tens 'y' units; unknown words give null."""
    parts = F.split(c, " y ")
    known = F.create_map(*[F.lit(x) for w, k in SPELLED.items() for x in (w, k)])
    return F.aggregate(parts, F.lit(0), lambda total, w: total + F.element_at(known, w))


def date_in_words(c: Column | str) -> Column:
    """'a los veinticinco días del mes de junio del año dos mil veinticuatro', accents or not; null if a part is unknown."""
    t = fold(c)
    number = "[a-z]+(?: y [a-z]+)?"
    pattern = f"a los? ({number}) dias? del mes de ([a-z]+) del? (?:ano )?(dos mil|mil novecientos) ?({number})?"
    months = F.create_map(*[F.lit(x) for m, k in _MONTH_NUMBERS.items() for x in (m, k)])
    century = F.when(F.regexp_extract(t, pattern, 3) == "dos mil", 2000).when(F.regexp_extract(t, pattern, 3) == "mil novecientos", 1900)
    rest = F.regexp_extract(t, pattern, 4)
    year = century + F.when(rest == "", 0).otherwise(F.coalesce(_spelled(rest), F.lit(0)))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.element_at(months, F.regexp_extract(t, pattern, 2)), _spelled(F.regexp_extract(t, pattern, 1))), "yyyy-MM-dd")


def clip(c: Column | str, most: int = 8000, head: int = 5000, tail: int = 2500, marker: str = "\n[...]\n") -> Column:
    """Texts over ``most`` characters as their head, a marker and their tail."""
    t = col(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, head), F.lit(marker), F.right(t, F.lit(tail)))).otherwise(t)


def embed_text(full: Column | str, summary: Column | str, least: int = 100, most_tokens: int = 6000) -> Column:
    """The full text if it has ``least`` characters and at most ``most_tokens`` tokens (four characters each), else a summary of ``least``, else null."""
    f, s = col(full), col(summary)
    return F.when((F.length(f) >= least) & (F.ceil(F.length(f) / 4) <= most_tokens), f).when(F.length(s) >= least, s)


def spanish_number(c: Column) -> Column:
    """'68.036.468,88' as decimal; null if it is none."""
    return F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".").try_cast("decimal(18,2)")
