"""Responses by variant: kinds, defaults and quarantine; items of mixed kinds; broken JSON against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import extraction as E
from lexmill.operators.splits import article_list, fan_out
from lexmill.operators.windows import norm_states

FULL = {
    "resumen": "r",
    "palabras_clave": ["a", "b"],
    "categorias": [{"slug": "salud-publica", "relevancia": 0.7}, {"slug": "otra", "relevancia": 3}, {"relevancia": "x"}, {"slug": 5}],
    "expediente": "12/2004",
    "fecha_sancion": "31 de marzo de 1986",
    "estado": "derogada_total",
    "monto_principal": 12.5,
    "articulos": [{"numero": "1", "texto": "t", "resumen": "s", "más": 1}],
    "entidades": [{"nombre": "n", "tipo": k, "rol": r} for k, r in zip([*E.ENTITIES, "club"], [*E.ROLES, "jefe"], strict=True)] + [{"nombre": "m", "cuit": "20"}],
    "referencias": [{"tipo": k, "destino_numero": 5, "destino_anio": 1999} for k in (*E.RELATIONS, "inventa")] + [{"tipo": 7, "norma_externa_referencia": "Ley 5"}],
    "montos_detallados": [{"concepto": "c", "valor": 5, "es_porcentaje": True}, {"concepto": "d", "valor": None}, {"valor": 3}, {"concepto": "e", "valor": 1.5, "moneda": ""}],
    "anexos": [{"numero": "I", "titulo": "t"}, {"titulo": "u"}],
}


def read(spark, texts, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, t string")
    return [r.e.asDict(True) if r.e else None for r in df.select("id", E.extraction("t", **more).alias("e")).orderBy("id").collect()]


def test_full_response(spark):
    (e,) = read(spark, ["Claro:\n```json\n" + json.dumps(FULL) + "\n```"], categories=["salud-publica"])
    assert [(c["slug"], c["relevancia"]) for c in e["categorias"]] == [("salud-publica", 0.7), ("sin-categoria", 0.5), ("sin-categoria", 0.5), ("sin-categoria", 0.5)]
    assert [r["tipo"] for r in e["referencias"]] == [*E.RELATIONS, "cita", "cita"] and e["referencias"][9]["destino_numero"] == 5
    assert [x["tipo"] for x in e["entidades"]] == [*E.ENTITIES, "otro", "otro"] and [x["rol"] for x in e["entidades"]] == [*E.ROLES, "otro", "otro"]
    assert (e["estado"], e["fecha_sancion"], e["expediente"], e["monto_principal"], e["notas_vigencia"]) == ("derogada_total", "1986-03-31", "12/2004", 12.5, None)
    assert e["articulos"] == [{"numero": "1", "texto": "t", "resumen": "s"}]


@pytest.mark.parametrize(
    "change,good",
    [
        ({}, True),
        ({"resumen": 5}, False),
        ({"resumen": None}, False),
        ({"palabras_clave": None}, False),
        ({"palabras_clave": ["a", 1]}, False),
        ({"articulos": [{"numero": 1, "texto": "t", "resumen": "s"}]}, False),
        ({"articulos": ["t"]}, False),
        ({"articulos": []}, True),
        ({"entidades": [{"tipo": "otro"}]}, False),
        ({"estado": 3}, True),
        ({"moneda": None}, True),
        ({"moneda": 3}, False),
        ({"fecha_sancion": 3}, True),
        ({"montos_detallados": [{"valor": "5"}]}, False),
        ({"montos_detallados": [{"es_porcentaje": None}]}, True),
        ({"referencias": {"tipo": "cita"}}, False),
    ],
)
def test_quarantine(spark, change, good):
    (e,) = read(spark, [json.dumps({"resumen": "r", **change})])
    assert (e is not None) == good
    if good:
        assert e["palabras_clave"] == [] and e["estado"] == "sin_determinar" and e["fecha_sancion"] is None and e["entidades"] == []


def test_no_json(spark):
    assert read(spark, [None, "", "hola", "[1]", "{", '{"resumen": "a"', '"x"']) == [None] * 7


def test_days(spark):
    days = {"2004-13-40": "2004-13-40", " 1/2/2004 ": "2004-02-01", "5 de Setiembre de 1990": "1990-09-05", "5 de setembro de 1990": None, "": None, "hoy": None}
    df = spark.createDataFrame([(k,) for k in days], "t string")
    assert {r.t: r.d for r in df.select("t", E.iso_day(F.trim("t")).alias("d")).collect()} == days


def test_items_of_mixed_kinds(spark):
    v = {
        "relaciones": ["Ley 5", {"tipo": "sustituye", "destino_tipo": "ordenanza", "destino_numero": "7", "destino_anio": 1999, "destino_referencia": "Ord 7/1999"}, {"tipo": "complementa"}, 5, None, {"destino_tipo": ""}],
        "articulos": ["uno", {"numero": 2, "texto": "dos", "resumen": "d"}, 7, {"texto": None}, {"numero": 0, "texto": "x"}, {"numero": "0"}],
        "summary": {"trata": "a", "resuelve": "", "depende": "c"},
    }
    others = [{"summary": "s"}, {"summary": 5, "summary_texto": "t"}, {"summary": {}}, {"relaciones": {"a": 1}, "articulos": "x"}, {}]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate([v, *others])], "id long, t string").withColumn("v", F.try_parse_json("t"))
    rows = df.select("id", E.relation_items(F.col("v")).alias("r"), E.article_items(F.col("v")).alias("a"), E.summary_parts(F.col("v")).alias("s")).orderBy("id").collect()
    assert [tuple(x)[:5] for x in rows[0].r] == [("cita", "otro", None, None, "Ley 5"), ("sustituye", "ordenanza", 7, 1999, "Ord 7/1999"), ("cita", "otro", None, None, None), ("cita", "otro", None, None, None)]
    assert [tuple(x) for x in rows[0].a] == [("1", 1, "uno", None), ("2", 2, "dos", "d"), ("4", 4, "", None), ("5", 5, "x", None), ("0", 6, "", None)]
    assert [tuple(r.s) for r in rows] == [("a", "", "c", "a\nc"), ("s", None, None, "s"), (None, None, None, "t"), (None,) * 4, (None,) * 4, (None,) * 4]
    assert all(r.r == [] and r.a == [] for r in rows[1:])


def test_substitution_reaches_the_cascade(spark):
    text = json.dumps({"resumen": "r", "referencias": [{"tipo": "sustituye", "destino_numero": 5, "destino_anio": 1999}]})
    parts = fan_out(spark.createDataFrame([(1, text), (2, "no")], "id long, t string").select("id", E.extraction("t").alias("e")))
    norms = spark.createDataFrame([(1, 9, 2001, "vigente"), (7, 5, 1999, "vigente")], "id long, numero int, anio int, estado string")
    refs = parts["referencias"].selectExpr("norma_id as norma_origen_id", "cast(destino_numero as int) as numero", "cast(destino_anio as int) as anio", "tipo as relacion", "cast(null as string) as externa")
    key = norms.selectExpr("id as norma_destino_id", "numero", "anio")
    states = {r.id: r.estado for r in norm_states(norms, refs.join(key, ["numero", "anio"])).collect()}
    assert states == {1: "vigente", 7: "modificada"}


def test_fan_out(spark):
    e = spark.createDataFrame([(1, json.dumps(FULL))], "id long, t string").select("id", E.extraction("t").alias("e"))
    parts = {k: (v.orderBy("orden") if "orden" in v.columns else v).collect() for k, v in fan_out(e).items()}
    assert {k: len(v) for k, v in parts.items()} == {"normas": 1, "articulos": 1, "entidades": 10, "categorias": 4, "referencias": 12, "montos_detallados": 2, "anexos": 1}
    assert [(m.orden, m.concepto, m.moneda, m.es_porcentaje) for m in parts["montos_detallados"]] == [(1, "c", "ARS", True), (4, "e", "ARS", False)]
    assert parts["normas"][0].resumen == "r" and parts["anexos"][0].numero == "I"


def test_article_list(spark):
    j = {"norma": {"articulos": [{"numero": "2 bis", "contenido": "c", "estado": "v"}, {"numero": 3}, "x", {"numero": 0, "contenido": 5}]}}
    rows = [(1, "antes " + json.dumps(j) + " fin"), (2, 'ver art. 7 {"norma": {"articulos": {}}}'), (3, '{"norma": {"articulos": []}}'), (4, None), (5, '{"norma": {"articulos": [null]}}')]
    got = {}
    for r in article_list(spark.createDataFrame(rows, "id long, texto string")).collect():
        got.setdefault(r.id, []).append((r.numero, r.contexto, r.estado))
    assert got[1] == [("2 bis", "c", "v"), ("3", "", None), ("1", "", None), ("1", "5", None)]
    assert got[2][0][0] == "7" and 3 not in got and got[4] == [("1", "", None)] and got[5][0][0] == "1"


def some_value(rng, depth):
    kind = rng.choice("snbldo" if depth else "snb")
    text = lambda: "".join(rng.choice('ab"\\\n\té,:}{[] ') for _ in range(rng.randint(0, 6)))
    if kind == "s":
        return text()
    if kind == "n":
        return rng.choice([0, -3, 12, 1.5, 2e20])
    if kind == "b":
        return rng.choice([True, False, None])
    n = rng.randint(0, 4)
    return [some_value(rng, depth - 1) for _ in range(n)] if kind == "l" else {text() + str(k): some_value(rng, depth - 1) for k in range(n)}


def brute_close(text):
    """The longest prefix that parses when what is open is closed."""
    for end in range(len(text), 0, -1):
        stack, quoted, skip = [], False, False
        for ch in text[:end]:
            if skip:
                skip = False
            elif quoted:
                quoted, skip = ch != '"', ch == "\\"
            elif ch == '"':
                quoted = True
            elif ch in "{[":
                stack.append("}" if ch == "{" else "]")
            elif ch in "}]" and stack:
                stack.pop()
        if skip:
            continue
        try:
            return json.loads(text[:end] + '"' * quoted + "".join(reversed(stack)), strict=False)
        except ValueError:
            continue
    return None


def test_cuts_against_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        text = json.dumps({"k": some_value(rng, 3), "m": some_value(rng, 3)}, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert json.loads(E.close_json(text)) == json.loads(text)
        cut = text[: rng.randint(1, len(text))]
        assert json.loads(E.close_json(cut)) == brute_close(cut), cut


@pytest.mark.parametrize(
    "text,expected",
    [
        ('{"a": 1\n"b": 2}', {"a": 1, "b": 2}),
        ('{"a": true\n"b": "x"\n"c": [1\n2 3,]\n"d": {},}', {"a": True, "b": "x", "c": [1, 2, 3], "d": {}}),
        ('{"a": "x\ny\t", "b": "\\q"}', {"a": "x\ny\t", "b": "\\q"}),
        ('{"a": 1, "b": [1, 2, "cort', {"a": 1, "b": [1, 2, "cort"]}),
        ('{"a": 1, "b": tr', {"a": 1}),
        ('{"a": 1} resto }', {"a": 1}),
        ('{"a": [1, 2}', {"a": [1, 2]}),
        ("{", {}),
        ("x", None),
        ('{"a": "\\u00', {"a": ""}),
    ],
)
def test_mended(text, expected):
    got = E.close_json(text)
    assert (json.loads(got) if got else None) == expected


def test_repair_in_linear_time_and_last_resort(spark):
    long = '{"a": [' + ", ".join('{"n": %d, "t": "áé"}' % k for k in range(40_000)) + ', {"n": 7, "t": "cor'
    assert len(json.loads(E.close_json(long))["a"]) == 40_001
    deep = '{"a": ' + "[" * 3000
    assert E.close_json(deep).count("]") == 3000
    rows = [(0, '<think>{no}</think>Va: {"a": 1, } fin'), (1, '```json\n{"a": 2}\n```'), (2, "nada"), (3, None), (4, long)]
    got = {r.id: r.j for r in E.repair_json(spark.createDataFrame(rows, "id long, t string"), "t", "j").collect()}
    assert json.loads(got[0]) == {"a": 1} and json.loads(got[1]) == {"a": 2} and got[2] == got[3] == E.NEUTRAL and json.loads(got[2])["relaciones_vigencia"] == []
    assert len(json.loads(got[4])["a"]) == 40_001
