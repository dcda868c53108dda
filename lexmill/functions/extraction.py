"""Model responses as typed rows: JSON of any kind by variant, validated field by field, with defaults; broken JSON mended.

A value's kind decides: a number where a text is asked for is no text, and a list may mix texts and objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.parse import json_in_text
from lexmill.functions.text import MONTHS, SETIEMBRE, col, found, let, strip
from lexmill.session import ship_package

#: Relations, states, and the kinds and roles of entities that a response may name.
RELATIONS = ("modifica", "deroga_total", "deroga_parcial", "complementa", "reglamenta", "adhiere", "prorroga", "convalida", "cita", "sustituye")
#: The relations of the other line of responses, which has no 'complementa'.
ITEM_RELATIONS = ("deroga_total", "deroga_parcial", "modifica", "sustituye", "prorroga", "convalida", "adhiere", "reglamenta", "cita")
STATES = ("vigente", "modificada", "derogada_total", "derogada_parcial", "sin_determinar")
ENTITIES = ("persona_fisica", "empresa", "organismo_municipal", "organismo_provincial", "organismo_nacional", "institucion_educativa", "club_asociacion", "otro")
ROLES = ("beneficiario", "contratista", "contraparte_contractual", "firmante", "solicitante", "mencionado", "sancionado", "otro")
#: Fixed value: what stands for a response that can't be read.
NEUTRAL = (
    '{"summary": {"trata": "Norma municipal con regulaciones locales", "resuelve": "Disposiciones generales aplicables en el ámbito distrital.",'
    ' "depende": "No especificado"}, "relaciones_vigencia": []}'
)

_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def _part(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column, key: str) -> Column:
    """STRING, BIGINT, ARRAY<...> and so on; VOID for null, null for none."""
    return F.schema_of_variant(_part(v, key))


class Text:
    """A text; if it isn't required, null or none is null."""

    def __init__(self, key: str, required: bool = False) -> None:
        self.key, self.required = key, required

    pattern, kind = "^STRING$", "string"

    def valid(self, v: Column) -> Column:
        k = _kind(v, self.key)
        is_one = F.coalesce(k.rlike(self.pattern), F.lit(False))
        return is_one if self.required else is_one | k.isNull() | (k == "VOID")

    def value(self, v: Column) -> Column:
        return F.when(_kind(v, self.key).rlike(self.pattern), F.try_variant_get(v, f"$.{self.key}", self.kind))


class Number(Text):
    pattern, kind = _NUMBER, "double"


class Flag(Text):
    pattern, kind = "^BOOLEAN$", "boolean"


class Choice(Text):
    """One of some texts, else a fallback, which whatever else stands there gives too."""

    def __init__(self, key: str, values: Sequence[str] | None, fallback: str) -> None:
        super().__init__(key)
        self.values, self.fallback = values, fallback

    def valid(self, v: Column) -> Column:
        return F.lit(True)

    def value(self, v: Column) -> Column:
        t = super().value(v)
        known = t.isNotNull() if self.values is None else t.isin(*self.values)
        return F.when(known, t).otherwise(self.fallback)


class Share(Number):
    """A number from 0 to 1, else 0.5."""

    def valid(self, v: Column) -> Column:
        return F.lit(True)

    def value(self, v: Column) -> Column:
        x = super().value(v)
        return F.when(x.between(0, 1), x).otherwise(0.5)


class Day(Text):
    """A date as yyyy-MM-dd, from that, d/M/yyyy or '31 de marzo de 1986'; else null."""

    def valid(self, v: Column) -> Column:
        return F.lit(True)

    def value(self, v: Column) -> Column:
        return let(strip(super().value(v)), iso_day)


class Texts(Text):
    """A list of texts; none is an empty list."""

    def valid(self, v: Column) -> Column:
        k = _kind(v, self.key)
        items = F.try_variant_get(v, f"$.{self.key}", "array<variant>")
        return F.coalesce(k.isNull() | k.startswith("ARRAY<") & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))

    def value(self, v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{self.key}", "array<string>"), F.array().cast("array<string>"))


class Rows(Text):
    """A list of objects with fields; none is an empty list."""

    def __init__(self, key: str, *fields: Text) -> None:
        super().__init__(key)
        self.fields = fields

    def valid(self, v: Column) -> Column:
        k = _kind(v, self.key)
        good = lambda x: _every([F.schema_of_variant(x).startswith("OBJECT<"), *(f.valid(x) for f in self.fields)])
        return F.coalesce(k.isNull() | k.startswith("ARRAY<") & F.forall(F.try_variant_get(v, f"$.{self.key}", "array<variant>"), good), F.lit(False))

    def value(self, v: Column) -> Column:
        return F.coalesce(F.transform(F.try_variant_get(v, f"$.{self.key}", "array<variant>"), lambda x: _struct(x, self.fields)), F.array())


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _struct(v: Column, fields: Sequence[Text]) -> Column:
    return F.struct(*[f.value(v).alias(f.key) for f in fields])


def iso_day(t: Column) -> Column:
    """A day text as yyyy-MM-dd; other forms give null. Whether the calendar has the day isn't asked."""
    numbers, words = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})\s+de\s+(\w+)\s+de\s+(\d{4})$"
    months = F.create_map(*[F.lit(x) for k, m in [*enumerate(MONTHS, 1), (9, SETIEMBRE)] for x in (m, f"{k:02d}")])
    part = lambda s, p, k: F.regexp_extract(s, p, k)
    low = F.lower(t)
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
        .when(t.rlike(numbers), F.concat_ws("-", part(t, numbers, 3), F.lpad(part(t, numbers, 2), 2, "0"), F.lpad(part(t, numbers, 1), 2, "0")))
        .when(low.rlike(words), F.concat(part(low, words, 3), F.lit("-"), F.element_at(months, part(low, words, 2)), F.lit("-"), F.lpad(part(low, words, 1), 2, "0")))
    )


def response_fields(categories: Sequence[str] | None = None) -> list[Text]:
    """The fields of a full response; ``categories`` are the slugs that may stand, others become 'sin-categoria'."""
    return [
        Text("resumen", required=True),
        Texts("palabras_clave"),
        Rows("categorias", Choice("slug", categories, "sin-categoria"), Share("relevancia")),
        Text("expediente"),
        Day("fecha_sancion"),
        Choice("estado", STATES, "sin_determinar"),
        Text("notas_vigencia"),
        Number("monto_principal"),
        Text("moneda"),
        Text("seccion_visto"),
        Text("seccion_considerando"),
        Rows("articulos", Text("numero", required=True), Text("texto", required=True), Text("resumen", required=True)),
        Rows("entidades", Text("nombre", required=True), Choice("tipo", ENTITIES, "otro"), Choice("rol", ROLES, "otro"), Text("cuit"), Text("contexto")),
        Rows(
            "referencias",
            Choice("tipo", RELATIONS, "cita"),
            Number("destino_numero"),
            Number("destino_anio"),
            *map(Text, ("norma_externa_tipo", "norma_externa_referencia", "norma_externa_descripcion", "articulos_afectados", "notas")),
        ),
        Rows("montos_detallados", Text("concepto"), Number("valor"), Text("moneda"), Text("unidad"), Flag("es_porcentaje")),
        Rows("anexos", *map(Text, ("numero", "titulo", "tipo", "contenido"))),
    ]


def extraction(c: Column | str, categories: Sequence[str] | None = None) -> Column:
    """A response's fields as a struct: what may be missing is null or an empty list, unknown names fall back.

    Null, for quarantine, if the text holds no JSON object, or a field that must be a text (number, list) is none.
    """
    fields = response_fields(categories)
    read = lambda v: F.when((F.schema_of_variant(v).startswith("OBJECT<")) & _every([f.valid(v) for f in fields]), _struct(v, fields))
    return let(F.try_parse_json(json_in_text(c)), read)


def _items(v: Column, key: str) -> Column:
    """A list's elements; what is no list has none."""
    return F.coalesce(F.when(_kind(v, key).startswith("ARRAY<"), F.try_variant_get(v, f"$.{key}", "array<variant>")), F.array().cast("array<variant>"))


def _filled(v: Column, key: str) -> Column:
    """A text, number or true as text; null for all else, and for an empty text, 0 and false."""
    k, x = _kind(v, key), F.try_variant_get(v, f"$.{key}", "string")
    return F.when((k == "STRING") & (x != ""), x).when(k.rlike(_NUMBER) & (F.try_variant_get(v, f"$.{key}", "double") != 0), x).when((k == "BOOLEAN") & (x == "true"), x)


def relation_items(v: Column, key: str = "relaciones") -> Column:
    """The relations of a response (a variant): texts cite what they say, unknown kinds cite, other items go."""

    def one(x: Column) -> Column:
        plain = F.schema_of_variant(x) == "STRING"
        kind = _filled(x, "tipo")
        text = lambda k: F.when(~plain, F.try_variant_get(x, f"$.{k}", "string"))
        number = lambda k: F.when(~plain, F.try_variant_get(x, f"$.{k}", "int"))
        return F.struct(
            F.when(~plain & kind.isin(*ITEM_RELATIONS), kind).otherwise("cita").alias("tipo"),
            F.coalesce(F.when(~plain, _filled(x, "destino_tipo")), F.lit("otro")).alias("destino_tipo"),
            number("destino_numero").alias("destino_numero"),
            number("destino_anio").alias("destino_anio"),
            F.when(plain, F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.destino_referencia", "string")).alias("destino_referencia"),
            text("articulos_afectados").alias("articulos_afectados"),
            text("texto_cita").alias("texto_cita"),
        )

    return F.transform(F.filter(_items(v, key), lambda x: F.schema_of_variant(x).rlike("^(STRING$|OBJECT<)")), one)


def article_items(v: Column, key: str = "articulos") -> Column:
    """The articles of a response: texts and objects, numbered by their place in the list where they have no number."""
    placed = F.transform(_items(v, key), lambda x, k: F.struct(x.alias("x"), (k + 1).alias("orden")))

    def one(p: Column) -> Column:
        x, plain = p["x"], F.schema_of_variant(p["x"]) == "STRING"
        return F.struct(
            F.coalesce(F.when(~plain, _filled(x, "numero")), p["orden"].cast("string")).alias("numero"),
            p["orden"].alias("orden"),
            F.coalesce(F.when(plain, F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.texto", "string")), F.lit("")).alias("texto"),
            F.when(~plain, F.try_variant_get(x, "$.resumen", "string")).alias("resumen"),
        )

    return F.transform(F.filter(placed, lambda p: F.schema_of_variant(p["x"]).rlike("^(STRING$|OBJECT<)")), one)


def summary_parts(v: Column) -> Column:
    """(trata, resuelve, depende, texto) of a summary that is an object or a text; the text joins what isn't empty by lines."""
    k = _kind(v, "summary")
    own = lambda name: F.when(k.startswith("OBJECT<"), F.try_variant_get(v, f"$.summary.{name}", "string"))
    plain = F.when(k == "STRING", F.try_variant_get(v, "$.summary", "string"))
    about = F.coalesce(own("trata"), plain)
    parts = F.filter(F.array(about, own("resuelve"), own("depende")), lambda x: x.isNotNull() & (x != ""))
    joined = F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
    return F.struct(about.alias("trata"), own("resuelve").alias("resuelve"), own("depende").alias("depende"), F.coalesce(joined, _filled(v, "summary_texto"), plain).alias("texto"))


def embedded_articles(text: Column | str) -> Column:
    """The articles under norma.articulos of a JSON object in the text as (numero, contenido, estado); null if there is no such list."""

    def read(v: Column) -> Column:
        items = F.try_variant_get(v, "$.norma.articulos", "array<variant>")
        listed = F.schema_of_variant(F.try_variant_get(v, "$.norma.articulos", "variant")).startswith("ARRAY<") & ~F.exists(items, lambda x: F.schema_of_variant(x) == "VOID")
        one = lambda x: F.struct(F.coalesce(_filled(x, "numero"), F.lit("1")).alias("numero"), F.coalesce(_filled(x, "contenido"), F.lit("")).alias("contenido"), _filled(x, "estado").alias("estado"))
        return F.when(listed, F.transform(items, one))

    return let(F.try_parse_json(found(col(text), r"(?s)(\{.*\})")), read)


_TOKEN = re.compile(r'[ \t\r\n]+|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[{}\[\],:]', re.DOTALL)
_OPEN_TEXT = re.compile(r'"(?:[^"\\]|\\.)*(?=\\?\Z)', re.DOTALL)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{0,4}|.)", re.DOTALL)
_CONTROL = re.compile(r"[\x00-\x1f]")
_CLOSER = {"{": "}", "[": "]"}


def _text_token(t: str) -> str:
    """A text as valid JSON: control characters escaped, and backslashes of escapes that there aren't."""
    good = lambda x: len(x) == 5 or x in tuple('"\\/bfnrt')
    t = _ESCAPE.sub(lambda m: m[0] if good(m[1]) else "\\" + m[0], t) if "\\" in t else t
    return _CONTROL.sub(lambda m: f"\\u{ord(m[0]):04x}", t)


def _without_cut_escape(t: str) -> str:
    """A text that the end cuts, without an escape of which the end is missing."""
    last = None
    for last in _ESCAPE.finditer(t):  # noqa: B007
        pass
    return t[: last.start()] if last and last.end() == len(t) and last[1][0] == "u" and len(last[1]) < 5 else t


def close_json(text: str) -> str | None:
    """The object that the text begins with, mended in one pass; null if there is none.

    Commas that are missing between members are put in and trailing ones left out, wrong escapes are kept as they look.
    Where the text ends or goes wrong, it is cut at the last place at which all that is open can be closed (a value
    that is a text is closed where it ends), and closed there.
    """
    out: list[str] = []
    stack: list[str] = []
    state, closable, at = "value", 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            tail = _OPEN_TEXT.match(text, at)
            if tail and stack and (state == "value" or stack[-1] == "[" and state in ("first", "next", "item")):  # a value that the end cuts
                out += [","] * (state == "next") + [_text_token(_without_cut_escape(tail[0])) + '"']
                closable = len(out)
            break
        token, at = m[0], m.end()
        if token[0] in " \t\r\n":
            continue
        inside = stack[-1] if stack else ""
        if not stack and token != "{":
            break
        if token == ",":
            if state != "next":
                break
            out.append(",")
            state = "key" if inside == "{" else "item"
            continue
        if token == ":":
            if state != "colon":
                break
            out.append(":")
            state = "value"
            continue
        if token in "}]":
            if _CLOSER[inside] != token or state not in ("first", "next", "key", "item"):
                break
            if state in ("key", "item"):
                out.pop()
            out.append(token)
            stack.pop()
            if not stack:
                return "".join(out)
            state, closable = "next", len(out)
            continue
        if inside == "{" and state in ("first", "next", "key"):
            if token[0] != '"':
                break
            out += [","] * (state == "next") + [_text_token(token)]
            state = "colon"
            continue
        if state == "colon":
            break
        out += [","] * (state == "next")
        if token in "{[":
            stack.append(token)
            out.append(token)
            state = "first"
        else:
            out.append(_text_token(token) if token[0] == '"' else token)
            state = "next"
        closable = len(out)
    if not closable:
        return None
    return "".join(out[:closable]) + "".join(_CLOSER[x] for x in reversed(stack))


def repair_json(df: DataFrame, c: str, name: str) -> DataFrame:
    """``df`` with the JSON object of a response as text: out of its fence, without thoughts, from the first brace on.

    What doesn't parse as it is goes through ``close_json`` in Arrow batches; what holds no object becomes ``NEUTRAL``.
    """
    ship_package(df.sparkSession)
    fenced = F.coalesce(found(F.col(c), r"(?s)```(?:json)?\s*(.*?)\s*```"), F.col(c))
    plain = found(F.regexp_replace(fenced, r"(?s)<think>.*?</think>", ""), r"(?s)(\{.*)")
    whole = found(plain, r"(?s)\A(.*\})")

    @F.arrow_udf("string")
    def mend(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if x is None else close_json(x) for x in batch.to_pylist()], pa.string())

    fine = F.try_parse_json(F.col("_whole")).isNotNull()
    rows = df.withColumn("_plain", plain).withColumn("_whole", whole).withColumn("_fine", fine).withColumn("_broken", F.when(~F.coalesce("_fine", F.lit(False)), F.col("_plain")))
    return rows.withColumn(name, F.coalesce(F.when(F.col("_fine"), F.col("_whole")), mend("_broken"), F.lit(NEUTRAL))).drop("_plain", "_whole", "_fine", "_broken")
