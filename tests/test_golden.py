"""Small golden cases for parsers, splits, the cascade, trees, paging and vectors."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import extraction as E
from lexmill.functions import parse as P
from lexmill.functions import text as T
from lexmill.operators import filters as L
from lexmill.operators import graph as G
from lexmill.operators import joins as J
from lexmill.operators import splits as X
from lexmill.operators import vectors as V
from lexmill.operators import windows as W
from lexmill.operators.search import snippets
from lexmill.sources.corpus import markdown_rows, parse_norms, read_markdown, read_text, write_markdown
from lexmill.sources.html_rows import page_rows


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("sin artículos", [("1", 1)]),
        ("Art. 1 uno", [("1", 1)]),
        ("ARTÍCULO 1º: a\nARTÍCULO 2 BIS.- b", [("1", 1), ("2 bis", 2)]),
        ("preámbulo\nartículo 3º: c\nartículo 3º: d", [("3", 1), ("3", 2)]),
        (None, [("1", 1)]),
        ("", [("1", 1)]),
    ],
)
def test_article_split(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, texto string")
    assert [(r.numero, r.orden) for r in X.split_articles(df).orderBy("orden").collect()] == want


def test_article_keep_first_or_last(spark):
    df = X.split_articles(spark.createDataFrame([(1, "Art. 3 c\nArt. 3 d")], "id int, texto string"))
    assert [r.texto for r in X.one_per_number(df, "first").collect()] == ["c"]
    assert [r.texto for r in X.one_per_number(df, "last").collect()] == ["d"]


@pytest.mark.parametrize(
    ("kind", "title", "body", "want"),
    [
        ("decreto", "604/2026", "", (604, 2026)),
        ("decreto", "29/18", "", (29, 2018)),
        ("ordenanza", "x", "ORDENANZA Nº 20/2026", (20, 2026)),
        ("ordenanza", "x", "ordenanza N° 62/07", (62, 2007)),
        ("ordenanza", "x", "Ordenanza Nº 63/91", (63, 1991)),
        ("ordenanza", "x", "ORDENANZA Nº 1/2001 y ORDENANZA Nº 2/2002", (2, 2002)),
        ("resolucion", "x", "DECRETO Nº 1/2001 y DECRETO Nº 2/2002", (1, 2001)),
        ("ordenanza", "x", "nada", None),
    ],
)
def test_legal_number(spark, kind, title, body, want):
    df = spark.createDataFrame([(kind, title, body)], "k string, t string, b string")
    got = df.select(P.legal_number(F.col("k"), F.col("t"), F.col("b")).alias("n")).first()["n"]
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("$68.036.468,88", 68036468.88), ("=A= 24", 24.0), ("50%", 50.0), ("10 por ciento", 10.0)])
def test_amounts(spark, text, want):
    assert [float(a.valor) for a in one(spark, text, P.amounts)] == [want]


def test_amount_without_digits(spark):
    assert one(spark, "$.", P.amounts) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("el 31 de marzo de 1986", datetime.date(1986, 3, 31)),
        ("1/2/2003", datetime.date(2003, 2, 1)),
        ("2004-05-06", datetime.date(2004, 5, 6)),
        ("31/02/2003", None),
        ("nada", None),
    ],
)
def test_dates(spark, text, want):
    assert one(spark, text, T.parse_date) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a los veinticinco días del mes de junio del año dos mil veinticuatro", datetime.date(2024, 6, 25)),
        ("a los dieciséis días del mes de mayo del año mil novecientos ochenta y seis", datetime.date(1986, 5, 16)),
        ("a los treinta y un días del mes de enero del año dos mil", datetime.date(2000, 1, 31)),
        ("a los cien días del mes de junio del año dos mil", None),
    ],
)
def test_dates_in_words(spark, text, want):
    assert one(spark, text, T.date_in_words) == want


def test_frontmatter(spark):
    m = one(spark, "---\n# c\na: 1\na: \"2\"\nb: [x, 'y']\n---\nbody", P.frontmatter)
    assert m == {"a": '"2"', "b": "[x, 'y']"}
    assert one(spark, "no header", P.frontmatter) == {}
    assert one(spark, "no header", P.body) == "no header"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Claro: {"a": 1} fin', {"a": 1}),
        ('{"a": 1, }', {"a": 1}),
        ('{"a": [1]\n"b": 2}', {"a": [1], "b": 2}),
        ('{"a": 1, "b": [1, "x', {"a": 1, "b": [1, "x"]}),
        ("nada que hacer", json.loads(E.NEUTRAL)),
    ],
)
def test_json_repair(spark, text, want):
    df = E.repair_json(spark.createDataFrame([(text,)], "t string"), "t", "j")
    assert json.loads(df.first()["j"]) == want


def test_republications_sort_as_strings(spark):
    rows = [("k", 9, 1, "completa"), ("k", 10, 2, "completa"), ("k", 11, 3, "extracto"), ("s", 5, 4, "extracto"), ("s", 5, 5, "completa")]
    df = spark.createDataFrame(rows, "clave string, boletin int, contenido_id int, version string")
    got = {r.contenido_id: (r.es_republicacion_de, r.tambien_en) for r in W.republications(df, ["clave"]).collect()}
    assert got == {1: (None, ["10", "11"]), 2: (1, None), 3: (1, None), 5: (None, ["5"]), 4: (5, None)}


NORMS = "id long, tipo string, numero int, anio int, codigo_localidad int, estado string, notas_vigencia string"
REFS = "ref_id long, norma_origen_id long, norma_destino_id long, destino_tipo string, destino_numero int, destino_anio int, codigo_localidad int, destino_referencia string, relacion string, etiqueta string, articulos_afectados string"


def corpus(spark):
    norms = spark.createDataFrame([(1, "ordenanza", 10, 2021, 108, "vigente", None), (2, "ordenanza", 25, 2022, 108, "vigente", "modifica O3"), (5, "ordenanza", 999, None, 108, "vigente", None)], NORMS)
    refs = spark.createDataFrame(
        [
            (1, 2, None, "ordenanza", 10, 2021, 108, None, "modifica", "O2", "Art. 1 y 2 bis"),
            (2, 5, None, "ordenanza", 10, 2021, 108, None, "deroga_total", "O5", "1"),
            (3, 2, None, "ordenanza", 10, 2021, 108, None, "modifica", "O2", "1"),
            (4, 1, None, "ordenanza", 999, None, 108, None, "deroga", "O1", None),
            (5, 1, None, "ley", 1, 1990, 108, "Ley 1", "cita", "O1", None),
            (6, 1, 2, None, None, None, 108, None, "modifica", "O3", None),
        ],
        REFS,
    )
    return norms, refs


def test_cascade(spark):
    norms, refs = corpus(spark)
    out = G.reconcile(norms, refs)
    assert {r.id: r.estado for r in out["normas"].collect()} == {1: "derogada", 2: "modificada", 5: "vigente"}
    assert {(r.norma_id, r.articulo): r.estado for r in out["articulos"].collect()} == {(1, "1"): "modificado", (1, "2 bis"): "modificado"}
    sticky = G.reconcile(norms, refs, sticky_repeal=True)["articulos"]
    assert {(r.norma_id, r.articulo): r.estado for r in sticky.collect()}[1, "1"] == "derogado"
    assert {r.id: r.notas for r in out["notas"].collect()} == {1: "modifica O2 | deroga_total O5"}


def test_cascade_again_changes_nothing(spark):
    norms, refs = corpus(spark)
    first = G.reconcile(norms, refs)["normas"]
    again = G.reconcile(first, refs)["normas"]
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_tree_ends_on_cycles(spark):
    refs = spark.createDataFrame([(1, 1, 2, "cita"), (2, 2, 1, "cita"), (3, 3, 3, "cita"), (4, 2, 4, "cita")], "ref_id long, norma_origen_id long, norma_destino_id long, relacion string")
    roots = spark.createDataFrame([(1,), (3,)], "id long")
    got = {(r.root, r.ref_id): r.profundidad for r in G.reference_tree(refs, roots, "afecta_a", 5).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 4): 2, (3, 3): 1}
    assert G.reference_tree(refs, roots, "ambas", 3, limit=1).count() == 2
    with pytest.raises(ValueError):
        G.reference_tree(refs, roots, depth=6)


def test_pages_cover_all_once(spark):
    df = L.newest_first(spark.range(25).selectExpr("id", "cast(id % 3 as int) as anio", "cast(id % 5 as int) as numero"))
    seen, cursor = [], 0
    while cursor is not None:
        rows, _, cursor = L.page(df, 7, cursor)
        seen += [r.id for r in rows.collect()]
    assert sorted(seen) == list(range(25))


def test_municipality(spark):
    df = spark.createDataFrame([(108, "Saladillo", "saladillo"), (10, "Bolívar", "bolivar")], "codigo int, nombre string, slug string")
    assert L.resolve_municipality(df, "10").first().codigo == 10
    assert L.resolve_municipality(df, "BOLIVAR").first().codigo == 10
    assert L.resolve_municipality(df, "lad").first().codigo == 108
    for bad in ("", "zzz"):
        with pytest.raises(ValueError):
            L.resolve_municipality(df, bad)


def test_empty_children_are_empty_arrays(spark):
    norms = spark.createDataFrame([(1,), (2,)], "id int")
    kids = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "norma_id int, orden int, texto string")
    got = {r.id: [c.texto for c in r.kids] for r in J.full_records(norms, {"kids": (kids, "orden", ["texto"])}).collect()}
    assert got == {1: ["a", "b"], 2: []}


def test_top_k_ties_and_errors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    c = spark.createDataFrame([(3, [2.0, 0.0]), (2, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])], "id long, vector array<float>")
    assert [(r.id, r.score) for r in V.top_k(q, c, 3, 0.0).orderBy("puesto").collect()] == [(2, 1.0), (3, 1.0), (4, 0.0)]
    assert [r.id for r in V.top_k(q, c, 3, 0.5).orderBy("puesto").collect()] == [2, 3]
    assert V.top_k(q.limit(0), c).count() == 0
    with pytest.raises(Exception, match="different length"):
        V.top_k(q, spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")).collect()


def test_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    assert [(r.id, [round(x, 4) for x in r.v]) for r in V.valid_vectors(df, "v", 2).collect()] == [(1, [0.6, 0.8])]
    blob = spark.createDataFrame([(bytes(np.array([1, 2], "<f4").tobytes()),), (b"x",), (None,)], "v binary")
    assert [r.v for r in V.decode_vectors(blob, "v", 2).collect()] == [[1.0, 2.0], None, None]


def test_fusion(spark):
    rows = [(1, "a", 7, 1), (1, "a", 8, 2), (1, "b", 8, 1)]
    got = V.rank_fusion(spark.createDataFrame(rows, "query_id int, canal string, id int, puesto int")).orderBy("puesto").collect()
    assert [(r.id, r.score) for r in got] == [(8, round(1 / 62 + 1 / 61, 6)), (7, round(1 / 61, 6))]


def test_snippet(spark):
    hits = spark.createDataFrame([(1, 1)], "query_id int, id int")
    norms = spark.createDataFrame([(1, "a b c d e f VIVIENDA g Hábitat h")], "id int, texto string")
    terms = spark.createDataFrame([(1, "vivienda"), (1, "habitat")], "query_id int, term string")
    assert snippets(hits, norms, terms, width=4).first()["snippet"] == "<<VIVIENDA>> g <<Hábitat>> h"


def test_markdown_round_trip(spark, tmp_path):
    norms = spark.createDataFrame([(7, "ordenanza", 12, 2004, 3, "Azul", "Ordenanza N 12", "VISTO: x\nCONSIDERANDO: y")], "contenido_id long, tipo string, numero int, anio int, codigo_localidad int, localidad string, titulo string, texto string")
    assert markdown_rows(norms).first()["archivo"] == "ordenanza-0012-2004"
    write_markdown(norms, str(tmp_path / "md"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(markdown_rows(norms).first()["value"])
    (tmp_path / "in" / "b.md").write_bytes("---\nurl: x/contents/9\n---\n# Título ñ".encode("latin-1"))
    rows = {r.contenido_id: r for r in parse_norms(read_markdown(spark, str(tmp_path / "in"))).collect()}
    assert (rows[7].numero, rows[7].anio, rows[7].seccion_visto, rows[7].titulo) == (12, 2004, "x", "Ordenanza N 12")
    assert rows[9].titulo == "Título ñ"


def test_text_files(spark, tmp_path):
    (tmp_path / "2003").mkdir()
    (tmp_path / "2003" / "Ordenanza N° 45.txt").write_text("Título\nresumen [...]")
    r = read_text(spark, str(tmp_path)).first()
    assert (r.anio, r.numero, r.texto) == (2003, 45, "Título\nresumen [...]")


def test_page_rows(spark):
    html = '<h1>T</h1><script>var x="<p>no</p>"</script><a href="/c/1">Ordenanza N° 45</a><p>uno<p>dos'
    df = page_rows(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    got = [(r.clase, r.destino, r.texto, r.numero) for r in df.orderBy("orden").collect()]
    assert got == [("h1", "", "T", None), ("a", "/c/1", "Ordenanza N° 45", 45), ("p", "", "uno", None), ("p", "", "dos", None)]


def test_upsert_and_append(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in J.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    batch = spark.createDataFrame([(3, "y"), (3, "x"), (1, "z"), (None, "n")], "k int, v string")
    assert [tuple(r) for r in J.append_new(old, batch, "k", "v").collect()] == [(3, "x")]


LISTING = '<div class="bulletin"><p class="bulletin-title">Boletín N° 12</p><p class="bulletin-date">03/04/2020</p><form class="button_to" action="/bulletins/77"><input></form></div><div class="bulletin"><p class="bulletin-title">sin enlace</p></div>'
PANELS = '<div class="panel-content panel-decrees"><a class="content-link" href="/bulletins/7/contents/91"><div class="white-box"><p>Decreto 5</p><p class="city-and-date">Azul, 05/06/2020</p> Versión extractada</div></a></div><div class="panel-content panel-odd"><a class="content-link" href="/bulletins/7/contents/92"><p>x</p></a></div>'
DETAIL = '<div id="frontend-container"><div class="col-md-9"><h1 class="title">Ordenanza 45</h1><p class="city-and-date">Azul</p><p>uno</p><p>dos</p></div><div class="row annex"><p class="annex-name">Plano</p><a href="/download_annex/3">ver</a></div></div>'


def test_pages_of_a_crawl(spark):
    from lexmill.sources import html_rows as H

    rows = H.elements(spark.createDataFrame([(1, LISTING), (2, PANELS), (3, DETAIL), (4, PANELS), (5, None)], "page_id long, html string"))
    assert [tuple(r) for r in H.bulletins(rows).collect()] == [(1, 77, 12, "Boletín N° 12", datetime.date(2020, 4, 3))]
    items, unknown = H.contents(rows, {"decrees": "decreto"})
    assert [tuple(r) for r in items.collect()] == [(2, 7, 91, "decreto", "Decreto 5", True, datetime.date(2020, 6, 5))]
    assert {tuple(r) for r in unknown.collect()} == {(2, "odd"), (4, "odd")}
    detail = H.norm_details(rows).filter("id = 3").first()
    assert (detail.titulo, detail.numero_registro, detail.cuerpo, [tuple(a) for a in detail.anexos]) == ("Ordenanza 45", 45, "uno\n\ndos", [("Plano", "/download_annex/3")])
    links = H.page_rows(spark.createDataFrame([(1, '<a href="?page=4">4</a><a href="?page=12">x</a>')], "page_id long, html string"))
    assert H.page_count(links).first()["paginas"] == 12


def test_json_state(spark, tmp_path):
    from lexmill.sources.corpus import read_state

    (tmp_path / "a.json").write_text('[{"cid": 1, "estado": "ok"},\n {"cid": 2}]')
    (tmp_path / "b.json").write_text('{"cid": 3, "x": [1]}')
    assert sorted((r.cid, r.estado) for r in read_state(spark, str(tmp_path), "cid long, estado string").collect()) == [(1, "ok"), (2, None), (3, None)]


def test_shared_folders_are_full_uris(spark, monkeypatch):
    from lexmill.session import shared_dir

    assert shared_dir(spark, "x").startswith("file:///")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "/tmp/no-scheme/")
    assert shared_dir(spark, "x").startswith("file:///tmp/no-scheme/x-")


def test_no_shared_folder_on_a_cluster_is_an_error(spark, monkeypatch):
    from lexmill.session import shared_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        shared_dir(Session(), "x")


def test_main_text_and_boilerplate(spark):
    from lexmill.sources.html_rows import main_text

    own = "<div class='norma-content'><div>LA PLATA, 3 de mayo de 2004 VISTO el expediente 1 Y CONSIDERANDO: x Por ello, EL GOBERNADOR DE LA PROVINCIA DE BUENOS AIRES DECRETA: <p>Uno &amp; dos.</p></div> Registrar, comunicar y dar al SINDMA. FIRMANTES</div>"
    pages = [(1, f"<body><nav>n</nav>{own}<p>fuera</p></body>"), (2, "<head><title>t</title></head><body><header>h</header>a<br>b<footer>f</footer></body>"), (3, None), (4, "")]
    got = main_text(spark.createDataFrame(pages, "page_id long, html string")).select("id", P.strip_boilerplate("texto").alias("t"))
    assert {r.id: r.t for r in got.collect()} == {1: "x Uno & dos.", 2: "ab", 3: None, 4: ""}


def test_boxes_at_any_depth(spark):
    from lexmill.sources import html_rows as H

    html = '<div class="col-md-9">' + "<div>" * 30 + "<p>hondo</p>" + "</div>" * 30 + "</div><p>fuera</p>"
    rows = H.elements(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert [r.texto for r in H.with_text(H.inside(rows, H.has_class("col-md-9")).filter("etiqueta = 'p'"), rows).collect()] == ["hondo"]


def test_written_index_and_filters(spark, tmp_path):
    from lexmill.operators import search as R

    norms = spark.createDataFrame([(1, "casa verde"), (2, "casa casa roja"), (3, "campo"), (4, "la casada vive"), (5, None)], "id long, texto string")
    R.write_index(norms, {"texto": 1.0}, str(tmp_path))
    index, shape = R.read_index(spark, str(tmp_path))
    terms = R.query_terms(spark.createDataFrame([(1, "CASA"), (2, "campo verde"), (3, "")], "query_id long, query string"))
    best = lambda **k: sorted((r.query_id, r.puesto, r.id) for r in R.bm25(index, shape, terms, **k).collect())
    assert best() == [(1, 1, 2), (1, 2, 1), (2, 1, 3), (2, 2, 1)] or best() == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 3)]
    assert best(allowed=norms.filter("id <> 2"), top=1)[0] == (1, 1, 1)
    assert shape.first()[0] == 5
    asked = spark.createDataFrame([(1, "a casada v"), (2, "asad"), (3, "casa roja")], "query_id long, query string")
    got = sorted((r.query_id, r.id) for r in R.all_terms_or_phrase(norms, asked, index, shape).collect())
    assert got == [(1, 4), (2, 4), (3, 2)]


def test_narrow_repeals(spark):
    t = "Deroga la Ordenanza N° 12/1999. Derogar la Ordenanza 13/1999. Derógase toda norma y la Ordenanza 14/1999. deroga Ordenanza Nº 15/2000"
    own = lambda **k: [(r.relacion, r.numero) for r in one(spark, t, lambda c: P.mined_references(c, **k))]
    assert own() == [("deroga", 12), ("deroga", 13), ("deroga", 14), ("deroga", 15)]
    assert own(reference_mode=True) == [("deroga", 12), ("deroga", 15)]


def test_repair_of_cut_json():
    cases = {'{"a": 1': '{"a": 1}', '{"a": [1, 2, "cort': '{"a": [1, 2, "cort"]}', '{"a": "x\\': '{"a": "x"}', '{"a": {"b": tr': '{"a": {}}', '{"a": 1, "b"': '{"a": 1}', '{"a": 1, "b": ': '{"a": 1}'}
    for text, want in cases.items():
        assert json.loads(E.close_json(text)) == json.loads(want), text
    assert E.close_json("no") is None
