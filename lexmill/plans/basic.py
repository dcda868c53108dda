"""Registered queries: filters, joins, aggregates, windows and the reference graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import aggregates as A
from lexmill.operators import filters as L
from lexmill.operators import graph as G
from lexmill.operators import incremental as I
from lexmill.operators import joins as J
from lexmill.operators import paging as K
from lexmill.operators import windows as W
from lexmill.plans.tables import ARTICULOS, ASIGNADAS, CATEGORIAS, NORMAS, PARTS, REFS, articulos, asignadas, categorias, normas, part_norms, references
from lexmill.session import shared_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def inventory(spark, sf):
    from lexmill.functions.text import slugify

    return normas(spark, sf).select(F.col("codigo_localidad").alias("codigo"), F.col("localidad").alias("nombre")).distinct().withColumn("slug", slugify("nombre"))


@query("f1_municipality", f"WITH {NORMAS} SELECT id, codigo_localidad FROM normas WHERE localidad = 'src7'")
def f1(spark, sf):
    return L.of_municipality(normas(spark, sf), inventory(spark, sf), "SRC7").select("id", "codigo_localidad")


@query("f2_type_in_force", f"WITH {NORMAS} SELECT id, tipo, estado FROM normas WHERE tipo = 'ordenanza' AND estado IN ('vigente', 'modificada')")
def f2(spark, sf):
    return L.in_force(L.of_type(normas(spark, sf), "ordenanza")).select("id", "tipo", "estado")


@query("f4_year_range", f"WITH {NORMAS} SELECT id, anio, numero FROM normas WHERE anio BETWEEN 2000 AND 2010 ORDER BY anio DESC, numero DESC, id LIMIT 100")
def f4(spark, sf):
    return L.newest_first(L.year_range(normas(spark, sf), 2000, 2010)).limit(100).select("id", "anio", "numero")


@query("f5_by_category", f"WITH {NORMAS}, {ASIGNADAS} SELECT n.id, n.titulo, a.slug, a.relevancia FROM normas n JOIN asignadas a ON a.norma_id = n.id WHERE a.slug = 'nation_3'")
def f5(spark, sf):
    return L.by_category(normas(spark, sf), asignadas(spark, sf).drop("slug"), categorias(spark, sf), "nation_3").select("id", "titulo", "slug", "relevancia")


@query(
    "f6_by_entity",
    f"""WITH {NORMAS}, e AS (SELECT s_suppkey AS id, s_name AS nombre FROM supplier),
m AS (SELECT c_custkey AS norma_id, c_custkey % 10 + 1 AS entidad_id, c_custkey AS mencion_id FROM customer UNION ALL SELECT c_custkey, c_custkey % 7 + 1, c_custkey + 1000000 FROM customer),
h AS (SELECT norma_id, arg_max(nombre, mencion_id) AS entidad FROM m JOIN e ON e.id = entidad_id WHERE contains(lower(nombre), '3') GROUP BY 1)
SELECT n.id, h.entidad FROM normas n JOIN h ON h.norma_id = n.id""",
)
def f6(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    e = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"), F.lower("s_name").alias("slug"))
    m = c.selectExpr("c_custkey as norma_id", "c_custkey % 10 + 1 as entidad_id", "c_custkey as mencion_id").unionByName(c.selectExpr("c_custkey as norma_id", "c_custkey % 7 + 1 as entidad_id", "c_custkey + 1000000 as mencion_id"))
    return L.by_entity(normas(spark, sf), e, m, "3").select("id", "entidad")


@query("f7_first_annex", "SELECT page_id AS id, url FROM pages WHERE page_id % 9 = 4 ORDER BY page_id LIMIT 1")
def f7(spark, sf):
    p = table(spark, sf, "pages").selectExpr("page_id as id", "page_id % 9 as norma_id", "url as nombre", "url")
    return L.annexes(p, norm_id=4).select("id", "url")


@query("f8_pending", f"WITH {NORMAS} SELECT id FROM normas WHERE procesado_llm = 0 AND tipo = 'decreto'")
def f8(spark, sf):
    return L.pending(normas(spark, sf), kind="decreto").select("id")


@query("f9_indexable", f"WITH {ARTICULOS} SELECT id FROM articulos WHERE length(trim(texto)) > 100")
def f9(spark, sf):
    return L.indexable(articulos(spark, sf), least=100).select("id")


@query("f10_work_list", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 5)::INT END AS pages FROM customer WHERE c_custkey BETWEEN 10 AND 1000 AND c_custkey % 3 <> 0 AND (c_custkey % 4 = 0 OR c_custkey % 5 > 0) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def f10(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey as id", "case when c_custkey % 4 = 0 then null else cast(c_custkey % 5 as int) end as pages", "c_custkey % 3 = 0 as done")
    return L.work_list(c, 10, 1000, table(spark, sf, "supplier").selectExpr("s_suppkey as id"), order="pages").select("id", "pages")


@query("f11_bulletins", f"WITH {NORMAS} SELECT id, boletin FROM normas WHERE boletin BETWEEN 5 AND 9 AND procesado_llm = 0")
def f11(spark, sf):
    return L.pending(normas(spark, sf)).filter(F.col("boletin").between(5, 9)).select("id", "boletin")


@query(
    "q1_violations",
    f"""WITH {NORMAS}, b AS (SELECT * FROM normas)
SELECT 'anio' AS regla, id::VARCHAR AS clave FROM b WHERE anio < 1995 UNION ALL SELECT 'estado', id::VARCHAR FROM b WHERE estado NOT IN ('vigente', 'modificada', 'derogada')
UNION ALL SELECT 'unica', tipo || '|' || numero || '|' || anio || '|' || codigo_localidad FROM b WHERE anio IS NOT NULL GROUP BY tipo, numero, anio, codigo_localidad HAVING count(*) > 1""",
)
def q1(spark, sf):
    return L.violations(normas(spark, sf), "id", {"anio": F.col("anio") >= 1995, "estado": F.col("estado").isin("vigente", "modificada", "derogada")}, {"unica": J.KEY})


@query("q2_resets", f"WITH {NORMAS} SELECT id, CASE procesado_llm WHEN -1 THEN 0 ELSE procesado_llm END AS procesado_llm, coalesce(codigo_localidad, 108) AS codigo_localidad FROM normas")
def q2(spark, sf):
    return L.reset_errors(normas(spark, sf), 108).select("id", "procesado_llm", "codigo_localidad")


@query("l1_newest", f"WITH {NORMAS} SELECT id, anio, numero FROM normas ORDER BY anio DESC NULLS LAST, numero DESC NULLS LAST, id LIMIT 50")
def l1(spark, sf):
    return L.newest_first(normas(spark, sf)).limit(50).select("id", "anio", "numero")


@query("l2_page", f"WITH {NORMAS} SELECT id, anio, numero FROM normas ORDER BY anio DESC NULLS LAST, numero DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def l2(spark, sf):
    return L.page(L.newest_first(normas(spark, sf).select("id", "anio", "numero")), 20, 40)[0]


@query(
    "l2_rank_pages",
    f"WITH {NORMAS}, r AS (SELECT id, anio, numero, row_number() OVER (ORDER BY anio DESC NULLS LAST, numero DESC NULLS LAST, id) AS puesto, count(*) OVER () AS total FROM normas) SELECT id, anio, numero, puesto, total, CASE WHEN puesto <= total // 2 + 20 THEN total // 2 + 20 END AS siguiente FROM r WHERE puesto BETWEEN total // 2 + 1 AND total // 2 + 20 OR puesto > total - 15",
)
def l2_ranks(spark, sf):
    """A page from the middle and the last one, each read from its own ranges."""
    rows, path = normas(spark, sf).select("id", "anio", "numero"), shared_dir(spark, "ranks")
    K.write_ranks(rows, path, ranges=16)
    total = K.rank_page(spark, path, rows.schema, 0, 1).total
    out = None
    for cursor in (total // 2, total - 15):
        page = K.rank_page(spark, path, rows.schema, cursor, 20)
        own = page.rows.select("id", "anio", "numero", "puesto", F.lit(page.total).cast("long").alias("total"), F.lit(page.next_cursor).cast("long").alias("siguiente"))
        out = own if out is None else out.unionByName(own)
    return out


@query("l2_keyset", f"WITH {NORMAS} SELECT id, anio, numero FROM normas WHERE anio < 2015 OR (anio = 2015 AND (numero < 200 OR (numero = 200 AND id > 0))) OR anio IS NULL ORDER BY anio DESC NULLS LAST, numero DESC NULLS LAST, id LIMIT 20")
def l2_keyset(spark, sf):
    return L.after_key(normas(spark, sf).select("id", "anio", "numero"), 2015, 200, 0, 20)


_RESOLVED = f"""{PARTS}, {REFS}, t AS (SELECT tipo, numero, anio, codigo_localidad, min(id) AS tid FROM normas WHERE anio IS NOT NULL GROUP BY ALL),
res AS (SELECT r.* REPLACE (coalesce(r.norma_destino_id, tid) AS norma_destino_id) FROM refs r LEFT JOIN t ON r.norma_destino_id IS NULL AND t.tipo = destino_tipo AND t.numero = destino_numero AND t.anio = destino_anio AND t.codigo_localidad = r.codigo_localidad)"""


@query("n1_resolve", f"WITH {_RESOLVED} SELECT ref_id, norma_destino_id FROM res")
def n1(spark, sf):
    return J.resolve_references(references(spark, sf), part_norms(spark, sf)).select("ref_id", "norma_destino_id")


@query("n2_resolve_by_number", f"WITH {PARTS}, {REFS}, t AS (SELECT numero, anio, min(id) AS tid FROM normas WHERE anio IS NOT NULL GROUP BY ALL) SELECT ref_id, coalesce(norma_destino_id, tid) AS norma_destino_id FROM refs LEFT JOIN t ON norma_destino_id IS NULL AND t.numero = destino_numero AND t.anio = destino_anio WHERE coalesce(norma_destino_id, tid) IS NOT NULL OR destino_referencia IS NOT NULL")
def n2(spark, sf):
    return J.drop_dangling(J.resolve_references(references(spark, sf), part_norms(spark, sf), ["numero", "anio"])).select("ref_id", "norma_destino_id")


@query("n3_category_ids", f"WITH {ASIGNADAS}, {CATEGORIAS} SELECT norma_id, id AS categoria_id, relevancia FROM asignadas JOIN categorias USING (slug)")
def n3(spark, sf):
    return J.with_category_ids(asignadas(spark, sf).select("norma_id", "slug", "relevancia"), categorias(spark, sf))


@query("n4_entities", "WITH m AS (SELECT DISTINCT 'Supplier#' || lpad((c_custkey % 40)::VARCHAR, 9, '0') AS nombre, CASE WHEN c_nationkey % 2 = 0 THEN 'empresa' ELSE 'organismo' END AS tipo FROM customer), k AS (SELECT s_name AS nombre, 'empresa' AS tipo FROM supplier) SELECT nombre, tipo, EXISTS (SELECT 1 FROM k WHERE k.nombre = x.nombre AND k.tipo = x.tipo) AS conocida FROM (SELECT * FROM m UNION SELECT * FROM k) x")
def n4(spark, sf):
    known = table(spark, sf, "supplier").selectExpr("cast(s_suppkey as bigint) as id", "s_name as nombre", "'empresa' as tipo", "cast(null as string) as cuit")
    m = table(spark, sf, "customer").selectExpr("c_custkey as norma_id", "concat('Supplier#', lpad(cast(c_custkey % 40 as string), 9, '0')) as nombre", "case when c_nationkey % 2 = 0 then 'empresa' else 'organismo' end as tipo", "'parte' as rol", "cast(null as string) as cuit")
    entities, _ = J.merge_entities(known, m)
    return entities.join(known.select(F.col("id"), F.lit(True).alias("k")), "id", "left").select("nombre", "tipo", F.coalesce("k", F.lit(False)).alias("conocida"))


@query("n5_annexes", f"WITH {NORMAS} SELECT id AS norma_id, 'Anexo ' || k AS nombre, url FROM normas JOIN pages ON page_id + 100000 = contenido_id, (VALUES (1), (2)) v(k)")
def n5(spark, sf):
    p = table(spark, sf, "pages").select((F.col("page_id") + 100000).alias("cid"), F.array(*[F.struct(F.lit(f"Anexo {k}").alias("nombre"), F.col("url")) for k in (1, 2)]).alias("anexos"))
    return J.attach_annexes(normas(spark, sf), p)


@query("n6_not_labelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def n6(spark, sf):
    return J.not_in(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query(
    "n7_full_record",
    f"""WITH {NORMAS}, {ARTICULOS}, {ASIGNADAS}, a AS (SELECT norma_id, string_agg(numero || ':' || texto, '|' ORDER BY orden, numero) AS t, count(*) AS k FROM articulos GROUP BY 1),
c AS (SELECT norma_id, count(*) AS k FROM asignadas GROUP BY 1)
SELECT id, titulo, coalesce(md5(a.t), md5('')) AS articulos_md5, coalesce(a.k, 0)::INT AS n_articulos, coalesce(c.k, 0)::INT AS n_categorias FROM normas LEFT JOIN a ON a.norma_id = id LEFT JOIN c ON c.norma_id = id""",
)
def n7(spark, sf):
    full = J.full_records(normas(spark, sf).select("id", "titulo"), {"articulos": (articulos(spark, sf), "orden", ["numero", "texto"]), "categorias": (asignadas(spark, sf), "categoria_id", ["slug", "relevancia"])})
    text = F.array_join(F.transform("articulos", lambda a: F.concat_ws(":", a["numero"], a["texto"])), "|")
    return full.select("id", "titulo", F.md5(text).alias("articulos_md5"), F.size("articulos").alias("n_articulos"), F.size("categorias").alias("n_categorias"))


@query("n8_cache", "WITH k AS (SELECT doc_id, sha256('m|formal|50|' || text) AS clave FROM documents) SELECT doc_id, clave, EXISTS (SELECT 1 FROM k c WHERE c.doc_id % 2 = 0 AND c.clave = k.clave) AS hit FROM k")
def n8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cache = d.filter("doc_id % 2 = 0").select(J.cache_key("text", "m", "formal", 50).alias("clave"), F.col("text").alias("resumen")).dropDuplicates(["clave"])
    return J.cached(d, cache, "text", "m").select("doc_id", "clave", "hit")


@query("n9_parents", f"WITH {CATEGORIAS} SELECT c.id, c.nombre, p.nombre AS parent_nombre FROM categorias c LEFT JOIN categorias p ON p.id = c.parent_id")
def n9(spark, sf):
    return J.with_parent(categorias(spark, sf)).select("id", "nombre", "parent_nombre")


@query("n10_natural_key", f"WITH {NORMAS}, h AS (SELECT * FROM normas WHERE tipo = 'ordenanza' AND numero = 4 AND anio = 1993) SELECT id, (SELECT count(DISTINCT codigo_localidad) FROM h)::INT AS municipios, (SELECT count(DISTINCT codigo_localidad) FROM h) > 1 AS ambigua FROM h")
def n10(spark, sf):
    return J.by_natural_key(normas(spark, sf), "ordenanza", 4, 1993).select("id", "municipios", "ambigua")


@query("s6_append_new", f"WITH {NORMAS}, b AS (SELECT contenido_id, boletin, row_number() OVER (PARTITION BY contenido_id % 700 ORDER BY boletin, contenido_id) AS k, contenido_id % 700 AS clave FROM normas) SELECT clave, contenido_id FROM b WHERE k = 1 AND clave NOT IN (SELECT doc_id FROM labels)")
def s6(spark, sf):
    rows = normas(spark, sf).selectExpr("contenido_id % 700 as clave", "contenido_id", "struct(boletin, contenido_id) as orden")
    return J.append_new(table(spark, sf, "labels").selectExpr("doc_id as clave"), rows, "clave", "orden").select("clave", "contenido_id")


@query("s7_upsert", "SELECT doc_id, coalesce(l.quality, -1) AS q FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels) d LEFT JOIN labels l USING (doc_id) UNION ALL SELECT NULL, count(*)::INT FROM labels")
def s7(spark, sf):
    """Two rows of each key in the batch, of which the later holds, and rows without a key, which is one key."""
    old = table(spark, sf, "documents").filter("doc_id % 2 = 0").selectExpr("doc_id", "-1 as q", "0l as v").unionByName(spark.range(1).selectExpr("cast(null as long) as doc_id", "-1 as q", "0l as v"))
    new = table(spark, sf, "labels").selectExpr("doc_id", "quality as q", "2l as v")
    none = new.selectExpr("cast(null as long) as doc_id", "cast(row_number() over (order by doc_id) as int) as q", "row_number() over (order by doc_id) as v")
    batch = new.unionByName(new.selectExpr("doc_id", "7 as q", "1l as v")).unionByName(none)
    return J.upsert(old, batch, ["doc_id"], "v").select("doc_id", "q")


@query("u1_two_directions", f"WITH {_RESOLVED} SELECT r.norma_origen_id AS norma_id, 'afecta_a' AS direccion, r.norma_destino_id AS otra_id, n.titulo AS otra_titulo, relacion, ref_id FROM res r JOIN normas o ON o.id = r.norma_origen_id LEFT JOIN normas n ON n.id = r.norma_destino_id UNION ALL SELECT r.norma_destino_id, 'afectada_por', r.norma_origen_id, n.titulo, relacion, ref_id FROM res r JOIN normas d ON d.id = r.norma_destino_id JOIN normas n ON n.id = r.norma_origen_id")
def u1(spark, sf):
    n = part_norms(spark, sf)
    return J.two_directions(n, J.resolve_references(references(spark, sf), n)).select("norma_id", "direccion", "otra_id", "otra_titulo", "relacion", "ref_id")


@query("u3_others", f"WITH {NORMAS} SELECT DISTINCT codigo_localidad FROM normas WHERE codigo_localidad <> 7")
def u3(spark, sf):
    return normas(spark, sf).select("codigo_localidad").distinct().filter("codigo_localidad <> 7")


@query("a1_corpus_stats", f"WITH {NORMAS}, {ARTICULOS} SELECT 'tipo' AS grupo, tipo AS clave, count(*) AS n FROM normas GROUP BY 2 UNION ALL SELECT 'estado', estado, count(*) FROM normas GROUP BY 2 UNION ALL SELECT 'procesado', CASE procesado_llm WHEN 0 THEN 'pendiente' WHEN 1 THEN 'procesado' WHEN 2 THEN 'extracto oficial' ELSE 'error' END, count(*) FROM normas GROUP BY 2 UNION ALL SELECT 'total', 'normas', count(*) FROM normas UNION ALL SELECT 'hijos', 'articulos', count(*) FROM articulos WHERE norma_id IN (SELECT id FROM normas)")
def a1(spark, sf):
    return A.corpus_stats(normas(spark, sf), articulos(spark, sf))


@query("a2_coverage", f"WITH {NORMAS} SELECT count(*) AS total, count(*) - count(anio) AS sin_anio, count(texto) AS con_texto, count(anio) AS con_anio FROM normas")
def a2(spark, sf):
    return A.coverage(normas(spark, sf), ["texto", "anio"])


@query("a2_top_years", f"WITH {NORMAS} SELECT anio, count(*) AS n FROM normas WHERE anio IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 20")
def a2_years(spark, sf):
    return A.top_years(normas(spark, sf))


@query("a2_municipalities", f"WITH {NORMAS} SELECT codigo_localidad, localidad, count(*) AS n FROM normas GROUP BY 1, 2")
def a2_cities(spark, sf):
    return A.by_municipality(normas(spark, sf))


@query("a3_progress", f"WITH {NORMAS} SELECT count(*) AS total, count(*) FILTER (procesado_llm IN (1, 2)) AS procesadas, count(*) FILTER (procesado_llm NOT IN (1, 2)) AS pendientes, round(100.0 * count(*) FILTER (procesado_llm IN (1, 2)) / count(*), 2) AS porcentaje FROM normas")
def a3(spark, sf):
    return A.progress(normas(spark, sf))


@query("a3_categories", f"WITH {CATEGORIAS}, {ASIGNADAS} SELECT nombre, count(*) AS n FROM asignadas JOIN categorias c ON c.id = categoria_id GROUP BY 1 ORDER BY n DESC, nombre LIMIT 10")
def a3_categories(spark, sf):
    return A.top_categories(asignadas(spark, sf), categorias(spark, sf))


@query("a3_years", f"WITH {NORMAS} SELECT anio, count(*) AS n FROM normas GROUP BY 1 ORDER BY anio DESC NULLS FIRST LIMIT 20")
def a3_years(spark, sf):
    return A.latest_years(normas(spark, sf))


@query("a4_totals", f"WITH {NORMAS} SELECT codigo_localidad, localidad, count(*) FILTER (tipo = 'ordenanza') AS ordenanzas, count(*) FILTER (tipo = 'decreto') AS decretos, count(*) FILTER (procesado_llm IN (1, 2)) AS enriquecidas, count(*) FILTER (procesado_llm = 0) AS pendientes FROM normas GROUP BY GROUPING SETS ((codigo_localidad, localidad), ())")
def a4(spark, sf):
    return A.municipality_totals(normas(spark, sf))


@query("a5_completion", f"WITH {NORMAS} SELECT codigo_localidad, count(*) AS total, count(*) FILTER (procesado_llm IN (1, 2)) AS hechas, round(count(*) FILTER (procesado_llm IN (1, 2)) / count(*), 4) AS razon, count(*) FILTER (procesado_llm IN (1, 2)) = count(*) AS completa FROM normas GROUP BY 1")
def a5(spark, sf):
    return A.completion(normas(spark, sf))


_DISTRICTS = f"WITH {NORMAS}, d AS (SELECT *, CASE WHEN codigo_localidad = 4 THEN 1 ELSE procesado_llm END AS p FROM normas WHERE tipo = 'ordenanza'), g AS (SELECT codigo_localidad, localidad, count(*) AS total, count(*) FILTER (p = 1) AS hechas, count(*) FILTER (p <> 1) AS pendientes FROM d GROUP BY 1, 2)"


def _district_norms(spark, sf):
    """Norms of which one municipality is all done."""
    return normas(spark, sf).withColumn("procesado_llm", F.when(F.col("codigo_localidad") == 4, 1).otherwise(F.col("procesado_llm")))


@query("a5_districts", f"{_DISTRICTS} SELECT count(*) AS distritos, count(*) FILTER (pendientes = 0) AS cerrados, round(100.0 * count(*) FILTER (pendientes = 0) / count(*), 1) AS porcentaje_cerrados, count(*) FILTER (pendientes > 0) AS con_pendientes FROM g")
def a5_districts(spark, sf):
    return A.district_summary(_district_norms(spark, sf))


@query("a5_pending", f"{_DISTRICTS} SELECT *, round(100.0 * hechas / total, 1) AS porcentaje FROM g WHERE pendientes > 0")
def a5_pending(spark, sf):
    return A.pending_districts(_district_norms(spark, sf))


@query(
    "a6_states",
    f"""WITH {NORMAS}, {ARTICULOS} SELECT 'ordenanzas' AS serie, procesado_llm::VARCHAR AS valor, count(*) AS n FROM normas WHERE tipo = 'ordenanza' GROUP BY 2 UNION ALL SELECT 'normas', estado, count(*) FROM normas GROUP BY 2
UNION ALL SELECT 'articulos', CASE WHEN orden % 3 = 0 THEN 'modificado' ELSE 'vigente' END, count(*) FROM articulos GROUP BY 2 UNION ALL SELECT 'total', 'articulos', count(*) FROM articulos UNION ALL SELECT 'total', 'referencias', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)""",
)
def a6_states(spark, sf):
    a = articulos(spark, sf).withColumn("estado", F.when(F.col("orden") % 3 == 0, "modificado").otherwise("vigente"))
    return A.snapshot_states(normas(spark, sf), a, references(spark, sf))


@query("a6_snapshot", f"WITH {NORMAS} SELECT count(*) AS total, round(100.0 * count(*) FILTER (procesado_llm IN (1, 2)) / count(*), 2) AS porcentaje, count(*) FILTER (tipo = 'ordenanza') AS ordenanzas, round(100.0 * count(*) FILTER (procesado_llm IN (1, 2) AND tipo = 'ordenanza') / count(*) FILTER (tipo = 'ordenanza'), 2) AS porcentaje_ordenanzas, count(DISTINCT codigo_localidad) AS municipios FROM normas")
def a6(spark, sf):
    return A.snapshot(normas(spark, sf))


@query("a7_embedding_coverage", f"WITH {NORMAS} SELECT codigo_localidad, count(*) AS total, count(vec_id) AS con_vector, round(100.0 * count(vec_id) / count(*), 2) AS porcentaje FROM normas LEFT JOIN embeddings ON vec_id = id GROUP BY 1")
def a7(spark, sf):
    return A.embedding_coverage(normas(spark, sf), table(spark, sf, "embeddings").selectExpr("vec_id as id"))


@query("a8_relations", f"WITH {PARTS}, {REFS} SELECT relacion, count(*) AS n FROM refs WHERE norma_origen_id IN (SELECT id FROM normas WHERE codigo_localidad = 2) GROUP BY 1")
def a8(spark, sf):
    return A.relation_counts(references(spark, sf), part_norms(spark, sf).filter("codigo_localidad = 2"))


@query("a9_category_counts", f"WITH {CATEGORIAS}, {ASIGNADAS} SELECT c.id, c.parent_id, c.nombre, count(norma_id) AS n FROM categorias c LEFT JOIN asignadas ON categoria_id = c.id GROUP BY ALL")
def a9(spark, sf):
    return A.category_counts(categorias(spark, sf), asignadas(spark, sf), True).select("id", "parent_id", "nombre", "n")


@query("a10_category_years", f"WITH {NORMAS}, {CATEGORIAS}, {ASIGNADAS} SELECT c.nombre AS categoria, p.nombre AS parent, anio, count(*) AS n, list_sort(list(numero)) AS numeros FROM asignadas a JOIN normas ON id = norma_id JOIN categorias c ON c.id = categoria_id LEFT JOIN categorias p ON p.id = c.parent_id GROUP BY 1, 2, 3")
def a10(spark, sf):
    return A.category_years(normas(spark, sf), asignadas(spark, sf), J.with_parent(categorias(spark, sf)))


@query("a11_crawl_status", "SELECT n_nationkey AS ciudad_id, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total FROM nation LEFT JOIN (SELECT c_nationkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey) ON c_nationkey = n_nationkey GROUP BY 1")
def a11(spark, sf):
    items = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).selectExpr("c_nationkey as ciudad_id", "o_orderstatus as estado")
    return A.crawl_status(items, table(spark, sf, "nation").selectExpr("n_nationkey as ciudad_id"), ["F", "O", "P"])


@query("a12_batch_totals", "SELECT sum(l_linenumber)::BIGINT AS boletines, sum(l_linenumber % 3)::BIGINT AS normas, sum(l_partkey % 5)::BIGINT AS descargas, count(*) FILTER (l_returnflag = 'R') AS fallos, round(avg(l_partkey % 100), 4) AS media, round(avg(l_partkey % 100) * 12, 4) AS eta FROM lineitem")
def a12(spark, sf):
    return A.batch_totals(table(spark, sf, "lineitem").selectExpr("l_linenumber as boletines", "l_linenumber % 3 as normas", "l_partkey % 5 as descargas", "cast(l_returnflag = 'R' as int) as fallos", "l_partkey % 100 as segundos"), 12)


@query("a13_compare_extractors", "SELECT count(*) AS n, 0.5 AS solape, sum(toxic + 1 - quality)::BIGINT AS dif_referencias, round(avg(quality), 4) AS ms_a, round(avg(toxic), 4) AS ms_b FROM labels")
def a13(spark, sf):
    t = table(spark, sf, "labels")
    a = t.select(F.col("doc_id").alias("id"), F.array(F.lit("x"), F.lit("y")).alias("categorias"), F.col("quality").alias("referencias"), F.col("quality").alias("ms"))
    b = t.select(F.col("doc_id").alias("id"), F.array(F.lit("y"), F.lit("z")).alias("categorias"), (F.col("toxic") + 1).alias("referencias"), F.col("toxic").alias("ms"))
    return A.compare_extractors(a, b)


@query("a14_latency", "SELECT count(value) AS n, round(avg(value), 4) AS media, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(count(value) * 1000.0 / sum(value), 4) AS por_segundo FROM events")
def a14(spark, sf):
    return A.latency_report(table(spark, sf, "events"), "value")


_KEYWORDS = """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(strip_accents(text)), '\\b([a-z]{4,})\\b', 1)) AS w FROM documents),
c AS (SELECT id, w, count(*) AS n FROM w WHERE w NOT IN ({stop}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, w) AS k FROM c)
SELECT id, list(w ORDER BY k) AS palabras FROM r WHERE k <= 8 GROUP BY 1"""


@query("a15_keywords", _KEYWORDS.replace("{stop}", ", ".join(f"'{w}'" for w in A.STOP_WORDS)))
def a15(spark, sf):
    return A.keywords(normas(spark, sf))


@query("a16_first_per_id", "SELECT doc_id AS id, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' ELSE 'documents' END AS fuente FROM documents d LEFT JOIN labels l USING (doc_id)")
def a16(spark, sf):
    out = lambda t: table(spark, sf, t).select(F.col("doc_id").alias("id"), F.lit(t).alias("fuente"), F.lit(1).alias("puesto"))
    return W.first_per_id(out("labels"), out("documents")).select("id", "fuente")


@query("a17_types_years", f"WITH {NORMAS} SELECT list_sort(list(DISTINCT tipo)) AS tipos, list_sort(list(DISTINCT anio) FILTER (anio IS NOT NULL)) AS anios FROM normas")
def a17(spark, sf):
    return A.distinct_types_years(normas(spark, sf))


@query(
    "w1_republications",
    """WITH o AS (SELECT CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS clave, (o_orderkey % 12)::INT AS boletin, o_orderkey AS contenido_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'completa' ELSE 'extracto' END AS version FROM orders),
r AS (SELECT *, row_number() OVER w AS k, first_value(contenido_id) OVER w AS f, first_value(boletin) OVER w AS fb FROM o WINDOW w AS (PARTITION BY clave ORDER BY boletin, CASE version WHEN 'completa' THEN 0 ELSE 1 END, contenido_id)),
g AS (SELECT clave, list_sort(list(DISTINCT boletin::VARCHAR) FILTER (boletin <> fb)) AS others, list_sort(list(contenido_id)) AS ids, any_value(fb) AS fb FROM r WHERE k > 1 GROUP BY 1)
SELECT contenido_id, CASE WHEN k > 1 AND clave IS NOT NULL THEN f END AS es_republicacion_de, CASE WHEN k = 1 AND g.clave IS NOT NULL THEN CASE WHEN len(others) > 0 THEN others ELSE [g.fb::VARCHAR] END END AS tambien_en, CASE WHEN k = 1 THEN ids END AS ids_repetidos FROM r LEFT JOIN g USING (clave)""",
)
def w1(spark, sf):
    o = table(spark, sf, "orders").selectExpr("case when o_custkey % 10 > 0 then o_custkey end as clave", "cast(o_orderkey % 12 as int) as boletin", "o_orderkey as contenido_id", "case when o_orderpriority like '1%' then 'completa' else 'extracto' end as version")
    return W.republications(o, ["clave"]).select("contenido_id", "es_republicacion_de", "tambien_en", "ids_repetidos")


_SEV = "CASE relacion WHEN 'modifica' THEN 1 WHEN 'modifica_parcial' THEN 1 WHEN 'sustituye' THEN 1 WHEN 'deroga_parcial' THEN 2 WHEN 'deroga' THEN 3 WHEN 'deroga_total' THEN 3 ELSE 0 END"
_STATE = "CASE estado WHEN 'modificada' THEN 1 WHEN 'derogada_parcial' THEN 2 WHEN 'derogada' THEN 3 ELSE 0 END"
_NAME = "CASE {x} WHEN 0 THEN 'vigente' WHEN 1 THEN 'modificada' WHEN 2 THEN 'derogada_parcial' ELSE 'derogada' END"
_ARTS = "(SELECT *, unnest(list_distinct(regexp_extract_all(lower(articulos_afectados), '(\\d+(?:\\s*bis)?)'))) AS articulo FROM res WHERE norma_destino_id IS NOT NULL)"


def cascade(spark, sf):
    return G.reconcile(part_norms(spark, sf), references(spark, sf))


@query("w2_article_states", f"WITH {_RESOLVED}, a AS (SELECT *, {_SEV} AS s, row_number() OVER (PARTITION BY norma_destino_id, articulo ORDER BY ref_id DESC) AS k FROM {_ARTS} WHERE {_SEV} > 0) SELECT norma_destino_id AS norma_id, articulo, CASE WHEN s >= 2 THEN 'derogado' ELSE 'modificado' END AS estado, norma_origen_id AS modificado_por FROM a WHERE k = 1")
def w2(spark, sf):
    return cascade(spark, sf)["articulos"]


_STATES = f"""{_RESOLVED}, m AS (SELECT norma_destino_id AS id, max({_SEV}) AS s FROM res WHERE norma_destino_id IS NOT NULL GROUP BY 1),
final AS (SELECT n.id, codigo_localidad, {_NAME.replace('{x}', f'greatest({_STATE}, coalesce(s, 0))')} AS estado FROM normas n LEFT JOIN m USING (id))"""


@query("w3_norm_states", f"WITH {_STATES} SELECT id, estado FROM final")
def w3(spark, sf):
    return cascade(spark, sf)["normas"].select("id", "estado")


_REPORT = f"""{_RESOLVED}, e AS (SELECT ref_id, norma_destino_id AS norma_id, relacion, etiqueta, {_SEV} AS s, {_STATE} AS st, notas_vigencia FROM res JOIN normas ON id = norma_destino_id WHERE {_SEV} > 0),
p AS (SELECT *, greatest(st, coalesce(max(s) OVER (PARTITION BY norma_id ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b FROM e)"""


@query("w4_notes", f"WITH {_REPORT}, f AS (SELECT norma_id, etiqueta, min(ref_id) AS r, arg_min(relacion, ref_id) AS relacion, any_value(coalesce(notas_vigencia, '')) AS old FROM p WHERE s >= b GROUP BY 1, 2), g AS (SELECT norma_id, max(old) AS old, string_agg(relacion || ' ' || etiqueta, ' | ' ORDER BY r) AS t FROM f WHERE NOT contains(old, etiqueta) GROUP BY 1) SELECT norma_id AS id, CASE WHEN old <> '' THEN old || ' | ' || t ELSE t END AS notas FROM g")
def w4(spark, sf):
    return cascade(spark, sf)["notas"]


@query("w5_report", f"WITH {_REPORT} SELECT ref_id, norma_id, relacion, {_NAME.replace('{x}', 'b')} AS antes, {_NAME.replace('{x}', 'greatest(b, s)')} AS despues FROM p")
def w5(spark, sf):
    return cascade(spark, sf)["informe"].select("ref_id", "norma_id", "relacion", "antes", "despues")


@query("w6_capped", f"WITH {NORMAS}, r AS (SELECT id, codigo_localidad, numero, row_number() OVER (PARTITION BY codigo_localidad ORDER BY numero, id) AS k FROM normas) SELECT id, codigo_localidad FROM (SELECT * FROM r WHERE k <= 3 ORDER BY codigo_localidad, k LIMIT 20)")
def w6(spark, sf):
    return W.capped_candidates(normas(spark, sf).withColumn("puesto", F.col("numero")), 3, 20).select("id", "codigo_localidad")


@query("w7_priority", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS prioridad FROM events")
def w7(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "case event_id % 4 when 1 then 'Ley' when 2 then 'Resolucion' when 3 then 'Decreto' else 'Otro' end as tipo", "user_id as page", "event_id as posicion")
    return W.page_priority(e).select("event_id", "prioridad")


@query("w8_top_categories", "WITH s AS (SELECT l_orderkey AS norma_id, l_partkey::VARCHAR AS slug, max(round(l_discount * 6, 4)) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY norma_id ORDER BY score DESC, slug) AS puesto FROM s) SELECT norma_id, slug, puesto::INT AS puesto FROM r WHERE puesto = 1 OR (puesto <= 3 AND score > 0.3)")
def w8(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("norma_id"), F.col("l_partkey").cast("string").alias("slug")).agg(F.max(F.round(F.col("l_discount") * 6, 4)).alias("score"))
    return W.top_categories(s).select("norma_id", "slug", "puesto")


@query(
    "g1_reference_tree",
    f"""WITH RECURSIVE {_RESOLVED}, e AS (SELECT ref_id, 'afecta_a' AS direccion, norma_origen_id AS a, norma_destino_id AS b FROM res WHERE norma_destino_id IS NOT NULL),
f1 AS (SELECT n.id AS root, e.*, 1 AS d FROM normas n JOIN e ON e.a = n.id WHERE n.id % 50 = 0),
r2 AS (SELECT DISTINCT root, b AS node FROM f1 WHERE b <> root), f2 AS (SELECT root, e.*, 2 AS d FROM r2 JOIN e ON e.a = node)
SELECT root, ref_id, direccion, min(d)::INT AS profundidad FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) GROUP BY ALL""",
)
def g1(spark, sf):
    n = part_norms(spark, sf)
    refs = J.resolve_references(references(spark, sf), n)
    return G.reference_tree(refs, n.filter("id % 50 = 0"), "afecta_a", 2).select("root", "ref_id", "direccion", "profundidad")


@query("g2_reconcile", f"WITH {_STATES} SELECT codigo_localidad, estado, count(*) AS n FROM final GROUP BY 1, 2")
def g2(spark, sf):
    return G.state_summary(cascade(spark, sf)["normas"], "codigo_localidad")


_NOTES = """f AS (SELECT norma_id, etiqueta, min(ref_id) AS r, arg_min(relacion, ref_id) AS relacion, any_value(coalesce(notas_vigencia, '')) AS old FROM p WHERE s >= b GROUP BY 1, 2),
g AS (SELECT norma_id, max(old) AS old, string_agg(relacion || ' ' || etiqueta, ' | ' ORDER BY r) AS t FROM f WHERE NOT contains(old, etiqueta) GROUP BY 1)"""


@query(
    "g2_incremental",
    f"""WITH {_REPORT}, {_NOTES}, m AS (SELECT norma_destino_id AS id, max({_SEV}) AS s FROM res WHERE norma_destino_id IS NOT NULL GROUP BY 1)
SELECT n.id, {_NAME.replace('{x}', f'greatest({_STATE}, coalesce(m.s, 0))')} AS estado, CASE WHEN g.old <> '' THEN g.old || ' | ' || t ELSE t END AS notas FROM normas n LEFT JOIN m USING (id) LEFT JOIN g ON g.norma_id = n.id""",
)
def g2_incremental(spark, sf):
    """References in three batches out of order, norms in two, one of them after all references: as in one run."""
    path, n, r = shared_dir(spark, "cascade"), part_norms(spark, sf), references(spark, sf)
    I.add_norms(n.filter("id % 3 > 0"), path)
    for part in (2, 0, 1):
        I.add_references(r.filter(F.col("ref_id") % 3 == part), path)
    I.add_norms(n.filter("id % 3 = 0"), path)
    out = I.reconciled(spark, path)
    return out["normas"].join(out["notas"], "id", "left")
