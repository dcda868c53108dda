"""Parsers of norm texts: front matter, sections, numbers, amounts, references, embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import all_found, col, fold, found, let, safe_int, spanish_number, strip

FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def frontmatter(text: Column | str) -> Column:
    """Map of the ``key: value`` lines of a leading block between ``---`` lines; the last of equal keys holds; else an empty map."""
    lines = F.split(F.regexp_extract(col(text), FRONT, 1), r"\r?\n")
    pairs = F.filter(lines, lambda x: x.rlike(r"^\s*[^#:\s][^:]*:"))
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    last = lambda es: lambda k: F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"]
    keys = lambda es: F.array_distinct(F.transform(es, lambda e: e["k"]))
    return let(entries, lambda es: F.map_from_arrays(keys(es), F.transform(keys(es), last(es))))


def body(text: Column | str) -> Column:
    """The text after its front matter, or the whole text."""
    return F.regexp_replace(col(text), FRONT, "")


def meta(m: Column, key: str) -> Column:
    """A value without its quotes; empty is null."""
    v = F.regexp_replace(F.element_at(m, F.lit(key)), r"^[\"'](.*)[\"']$", "$1")
    return F.when(v != "", v)


def meta_bool(m: Column, key: str) -> Column:
    v = F.lower(meta(m, key))
    return F.when(v == "true", True).when(v == "false", False)


def meta_list(m: Column, key: str) -> Column:
    """``[a, "b"]`` as an array of strings."""
    inner = F.regexp_extract(F.element_at(m, F.lit(key)), r"^\[(.*)\]$", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", ""))), lambda x: x != "")


def content_id(m: Column) -> Column:
    """From ``contenido_id``, else from the url; null if neither has one."""
    return F.coalesce(safe_int(meta(m, "contenido_id")), F.regexp_extract(meta(m, "url"), r"contents/(\d+)", 1).try_cast("int")).cast("long")


def norm_defaults(m: Column) -> dict[str, Column]:
    """Kind, version, url and first state, with defaults."""
    kind = F.lower(meta(m, "tipo"))
    version = F.lower(meta(m, "version"))
    return {
        "tipo": F.when(kind.isin("ordenanza", "decreto", "resolucion"), kind).otherwise("decreto"),
        "version": F.when(version.isin("completa", "extracto"), version).otherwise("completa"),
        "url": F.coalesce(meta(m, "url"), F.concat(F.lit("contents/"), content_id(m).cast("string"))),
        "estado": F.lit("vigente"),
    }


def title(text: Column | str, kind: Column, number: Column, year: Column, stem: Column) -> Column:
    """First ``# `` heading, else 'Tipo Nº n/a', else the file's stem."""
    return F.coalesce(found(col(text), r"(?m)^#[ \t]+(.*?)[ \t]*$"), F.when(number.isNotNull(), F.concat(F.initcap(kind), F.lit(" Nº "), number.cast("string"), F.coalesce(F.concat(F.lit("/"), year.cast("string")), F.lit("")))), stem)


def visto(text: Column | str) -> Column:
    return strip(found(col(text), r"(?isuU)\bVISTO\b\s*:?\s*(.*?)(?=\bCONSIDERANDO\b|\bPOR\s+(?:TODO\s+)?ELLO\b|\z)"))


def considerando(text: Column | str) -> Column:
    return strip(found(col(text), r"(?isuU)\bCONSIDERANDO\b\s*:?\s*(.*?)(?=\bPOR\s+(?:TODO\s+)?ELLO\b|^\s*ART[IÍ]CULO\b|\bORDENANZA\s+N|\z)"))


def strict_sections(text: Column | str) -> Column:
    """(visto, considerando), both or neither; the second ends at 'por todo ello' or at a spaced O R D E N A N Z A."""
    p = r"(?isu)\bVISTO\s*:?\s*(.+?)\bCONSIDERANDO\s*:?\s*(.+?)(?:POR\s+TODO\s+ELLO|O\s+R\s+D\s+E\s+N\s+A\s+N\s+Z\s+A|\z)"
    return F.struct(strip(found(col(text), p, 1)).alias("visto"), strip(found(col(text), p, 2)).alias("considerando"))


def official_extract(text: Column | str) -> Column:
    """The lines that aren't blank, headings, emphasis, rules or notices, joined by spaces."""
    lines = F.transform(F.split(body(text), r"\r?\n"), lambda x: F.trim(x))
    keep = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(#|\*|---|>)"))
    out = F.array_join(keep, " ")
    return F.when(out != "", out)


def txt_title(text: Column | str) -> Column:
    return F.get(F.filter(F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def txt_extract(text: Column | str) -> Column:
    """The second line that isn't blank, if it ends with [...]."""
    second = F.get(F.filter(F.transform(F.split(col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    return F.when(second.rlike(r"\[(\.\.\.|…)\]$"), second)


def legal_number(kind: Column, heading: Column, text: Column) -> Column:
    """(numero, anio): a decree's from its title 'n/yy', else from 'ORDENANZA|DECRETO Nº n/y' in the text, an ordinance's last one and others' first.

    Two-digit years are 20yy in titles; in texts up to 50, else 19yy. Years outside 1980 to 2100 don't count.
    """
    in_title = r"\b(\d{1,5})\s*/\s*(\d{2}|\d{4})\b"
    t_year = F.regexp_extract(heading, in_title, 2).try_cast("int")
    t_year = F.when(t_year < 100, 2000 + t_year).otherwise(t_year)
    pattern = r"(?iu)\b(?:ORDENANZA|DECRETO)\s+N\s*[º°ro.]*\s*(\d{1,5})\s*/\s*(\d{4}|\d{2})\b"
    raw = F.arrays_zip(all_found(text, pattern, 1).alias("n"), all_found(text, pattern, 2).alias("y"))
    full = lambda y: F.when(y < 51, 2000 + y).when(y < 100, 1900 + y).otherwise(y)
    hits = F.transform(raw, lambda x: F.struct(x["n"].cast("int").alias("numero"), full(x["y"].cast("int")).alias("anio")))
    hits = F.filter(hits, lambda x: x["anio"].between(1980, 2100))
    from_text = F.when(F.size(hits) > 0, F.when(kind == "ordenanza", F.element_at(hits, -1)).otherwise(F.element_at(hits, 1)))
    from_title = F.when((kind == "decreto") & t_year.between(1980, 2100), F.struct(F.regexp_extract(heading, in_title, 1).cast("int").alias("numero"), t_year.alias("anio")))
    return F.coalesce(from_title, from_text)


def file_number(text: Column | str) -> Column:
    return found(col(text), r"(?iu)\bexpediente\s+(?:N\s*[º°ro.]*\s*)?(\d[\d.\-]*/\d{2,4})")


def amounts(text: Column | str) -> Column:
    """Array of (valor, moneda, es_porcentaje): =A= australes, $ or ARS pesos, and % or 'por ciento'."""
    t = col(text)

    def kind(pattern: str, currency: str | None, percent: bool) -> Column:
        value = (lambda x: F.regexp_replace(x, ",", ".").try_cast("decimal(18,2)")) if percent else spanish_number
        return F.transform(all_found(t, pattern), lambda x: F.struct(value(x).alias("valor"), F.lit(currency).cast("string").alias("moneda"), F.lit(percent).alias("es_porcentaje")))

    return F.concat(
        kind(r"=A=\s*(\d[\d.]*(?:,\d+)?)", "AUSTRAL", False),
        kind(r"(?:\$|\bARS)\s*(\d[\d.]*(?:,\d+)?)", "ARS", False),
        kind(r"(?iu)\b(\d+(?:[.,]\d+)?)\s*(?:%|por ciento)", None, True),
    )


#: Fixed value: the source's own pattern of repeals, which is a class of characters: 'deroga la' has it, 'derogar la' hasn't.
NARROW_REPEAL = r"(?iu)derog[ar\|a]\s+(?:la\s+)?ordenanza\s+[nº°]*\s*(\d+)/(\d{4})"


def mined_references(text: Column | str, reference_mode: bool = False) -> Column:
    """Array of (relacion, destino_tipo, numero, anio) found by pattern; ``reference_mode`` takes 'deroga' alone for repeals."""
    t = col(text)
    number = r"N?\s*[º°]?\s*(\d{1,5})"
    repeal = NARROW_REPEAL if reference_mode else rf"(?iu)\bder[oó]g(?:ar|a|ase|ue|uese)[^.]{{0,80}}?\bordenanza\s+{number}\s*/\s*(\d{{4}})"

    def kind(relation: str, target: str, pattern: str, year: bool) -> Column:
        hits = F.arrays_zip(all_found(t, pattern, 1).alias("n"), (all_found(t, pattern, 2) if year else all_found(t, pattern, 1)).alias("y"))
        return F.transform(hits, lambda x: F.struct(F.lit(relation).alias("relacion"), F.lit(target).alias("destino_tipo"), x["n"].try_cast("int").alias("numero"), (x["y"].try_cast("int") if year else F.lit(None).cast("int")).alias("anio")))

    return F.concat(
        kind("adhiere", "ley", rf"(?iu)adhi[eé]r(?:ase|ese|e)?[^.]{{0,60}}?\bley\s+(?:(?:nacional|provincial)\s+)?{number}", False),
        kind("modifica", "ordenanza", rf"(?iu)modif[ií](?:case|quese|ca|car)[^.]{{0,80}}?\bordenanza\s+{number}\s*/\s*(\d{{4}})", True),
        kind("deroga", "ordenanza", repeal, True),
        kind("cita", "decreto_ley", rf"(?iu)\bdecreto[\s-]+ley\s+{number}", False),
    )


def affected_articles(c: Column | str) -> Column:
    """Numbers of articles in free text such as 'Arts. 1, 3 y 5 bis', lower case."""
    return F.transform(all_found(F.coalesce(col(c), F.lit("")), r"(?iu)(\d+(?:\s*(?:bis|ter|quater|quinquies))?)"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))


def card_title(c: Column | str) -> Column:
    """(tipo, numero, anio) of 'Ley 13413/2005' and the like, else Desconocido, 0, 0."""
    p = r"(?u)\b(Ley|Decreto|Resolucion)\s+(\d+)/(\d{4})\b"
    hit = F.regexp_extract(col(c), p, 1) != ""
    return F.struct(F.when(hit, F.regexp_extract(col(c), p, 1)).otherwise("Desconocido").alias("tipo"), F.when(hit, F.regexp_extract(col(c), p, 2).try_cast("int")).otherwise(0).alias("numero"), F.when(hit, F.regexp_extract(col(c), p, 3).try_cast("int")).otherwise(0).alias("anio"))


def strip_fences(c: Column | str) -> Column:
    """Without code fences, and with one blank line at most."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"(?m)^[ \t]*```\w*[ \t]*\r?\n?", ""), r"\n[ \t]*\n([ \t]*\n)+", "\n\n"))


#: Boilerplate phrases of provincial norms, in the order in which they go.
BOILERPLATE = (
    r"(?i)LA PLATA,\s+\d+\s+de\s+\w+\s+de\s+\d{4}",
    r"(?is)VISTO el expediente.*?Y CONSIDERANDO:?",
    r"(?is)Por ello,.*?(EL GOBERNADOR|EL PRESIDENTE) DE LA PROVINCIA DE BUENOS AIRES.*(DECRETA|PROMULGA|SANCIONA):?",
    r"(?is)Registrar, comunicar y dar al SINDMA.*?(AXEL KICILLOF|MARIA EUGENIA VIDAL|DANIEL SCIOLI|FIRMANTES)",
)


def strip_boilerplate(c: Column | str) -> Column:
    """A page's main text without date line, VISTO to CONSIDERANDO, preamble, signatures, tags that are left, and doubled white space."""
    out = col(c)
    for phrase in BOILERPLATE:
        out = F.regexp_replace(out, phrase, "")
    out = F.regexp_replace(out, r"<[^>]*>?", "")
    out = strip(F.regexp_replace(out, r"(\r\n|\r|\n){2,}", "\n\n"))
    return F.regexp_replace(out, r"\s{2,}", " ")


def json_in_text(c: Column | str) -> Column:
    """The fenced block, else from the first { to the last }, else the whole."""
    t = col(c)
    return strip(F.coalesce(found(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), found(t, r"(?s)(\{.*\})"), t))


def state_guess(text: Column | str) -> Column:
    """A norm's own state as its text suggests it (a repealing text counts as repealed, as in the source of this rule)."""
    t = fold(text)
    return F.when(t.contains("derogase") | t.contains("derogar la presente"), "derogada").when(t.contains("modificase") | t.contains("sustituyese"), "modificada").otherwise("vigente")
