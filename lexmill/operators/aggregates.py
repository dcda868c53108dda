"""Counts and coverage over norms, crawls and extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import all_found, fold

LABELS = {0: "pendiente", 1: "procesado", 2: "extracto oficial", -1: "error"}


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 part / whole, with a whole of 0 read as 1."""
    return F.round(part * 100.0 / F.greatest(F.lit(1), whole), digits)


def corpus_stats(norms: DataFrame, articles: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """(grupo, clave, n): norms by type, state and labelled processing code, and the child rows of these norms; one scan of norms."""
    code = F.col("procesado_llm")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v)]), code), F.lit("otro"))
    keys = F.array(*[F.struct(F.lit(g).alias("grupo"), c.alias("clave")) for g, c in (("tipo", F.col("tipo")), ("estado", F.col("estado")), ("procesado", label), ("total", F.lit("normas")))])
    out = norms.select(F.explode(keys).alias("k")).groupBy("k.grupo", "k.clave").agg(F.count(F.lit(1)).alias("n"))
    for name, rows, col in (("articulos", articles, "norma_id"), ("referencias", refs, "norma_origen_id")):
        if rows is not None:
            own = rows.join(norms.select(F.col("id").alias(col)), col, "left_semi")
            out = out.unionByName(own.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hijos").alias("grupo"), F.lit(name).alias("clave"), "n"))
    return out


def coverage(norms: DataFrame, columns: list[str]) -> DataFrame:
    """(total, sin_anio, con_<column>...): rows, rows of unknown year, and rows where each column is known."""
    return norms.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("anio").isNull()).alias("sin_anio"), *[F.count(c).alias(f"con_{c}") for c in columns])


def top_years(norms: DataFrame, most: int = 20) -> DataFrame:
    return norms.filter("anio is not null").groupBy("anio").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("anio")).limit(most)


def by_municipality(norms: DataFrame) -> DataFrame:
    return norms.groupBy("codigo_localidad", "localidad").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "codigo_localidad")


def progress(norms: DataFrame) -> DataFrame:
    done = F.count_if(F.col("procesado_llm").isin(1, 2))
    return norms.agg(F.count(F.lit(1)).alias("total"), done.alias("procesadas"), (F.count(F.lit(1)) - done).alias("pendientes"), percent(done, F.count(F.lit(1))).alias("porcentaje"))


def top_categories(assigned: DataFrame, categories: DataFrame, most: int = 10) -> DataFrame:
    """(nombre, n) of the categories with most norms, equal counts in order of names."""
    rows = assigned.join(categories.select(F.col("id").alias("categoria_id"), "nombre"), "categoria_id")
    return rows.groupBy("nombre").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "nombre").limit(most)


def latest_years(norms: DataFrame, most: int = 20) -> DataFrame:
    """(anio, n) of the latest years; the unknown year comes first."""
    return norms.groupBy("anio").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_first("anio")).limit(most)


def municipality_totals(norms: DataFrame) -> DataFrame:
    """Per municipality and in total (null keys): ordinances, decrees, enriched, pending."""
    sums = [F.count_if(F.col("tipo") == "ordenanza").alias("ordenanzas"), F.count_if(F.col("tipo") == "decreto").alias("decretos"), F.count_if(F.col("procesado_llm").isin(1, 2)).alias("enriquecidas"), F.count_if(F.coalesce("procesado_llm", F.lit(0)) == 0).alias("pendientes")]
    return norms.cube("codigo_localidad", "localidad").agg(F.grouping_id().alias("_g"), *sums).filter("_g in (0, 3)").drop("_g")


def completion(norms: DataFrame) -> DataFrame:
    """Municipalities with work left or none: (codigo_localidad, total, hechas, razon, completa), least done first."""
    done = F.count_if(F.col("procesado_llm").isin(1, 2))
    rows = norms.groupBy("codigo_localidad").agg(F.count(F.lit(1)).alias("total"), done.alias("hechas"))
    return rows.withColumn("razon", F.round(F.col("hechas") / F.col("total"), 4)).withColumn("completa", F.col("hechas") == F.col("total")).orderBy("razon", "codigo_localidad")


def pending_districts(norms: DataFrame, kind: str = "ordenanza") -> DataFrame:
    """(codigo_localidad, localidad, total, hechas, pendientes, porcentaje) of municipalities whose norms of a kind aren't all enriched, most pending first."""
    done, left = F.count_if(F.col("procesado_llm") == 1), F.count_if(F.col("procesado_llm") != 1)
    rows = norms.filter(F.col("tipo") == kind).groupBy("codigo_localidad", "localidad").agg(F.count(F.lit(1)).alias("total"), done.alias("hechas"), left.alias("pendientes"))
    return rows.filter("pendientes > 0").withColumn("porcentaje", F.round(100.0 * F.col("hechas") / F.col("total"), 1)).orderBy(F.desc("pendientes"), "codigo_localidad")


def district_summary(norms: DataFrame, kind: str = "ordenanza") -> DataFrame:
    """One row: districts with norms of the kind, those without pending ones, their percent, and those with."""
    each = norms.filter(F.col("tipo") == kind).groupBy("codigo_localidad").agg(F.count_if(F.col("procesado_llm") != 1).alias("p"))
    closed, total = F.count_if(F.col("p") == 0), F.count(F.lit(1))
    return each.agg(total.alias("distritos"), closed.alias("cerrados"), F.round(100.0 * closed / F.greatest(total, F.lit(1)), 1).alias("porcentaje_cerrados"), (total - closed).alias("con_pendientes"))


def snapshot_states(norms: DataFrame, articles: DataFrame, refs: DataFrame) -> DataFrame:
    """(serie, valor, n): the counts of a snapshot line — ordinances by processing code, norms and articles by state, and totals."""
    by = lambda rows, column, name: rows.groupBy(F.col(column).cast("string").alias("valor")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("serie"), "valor", "n")
    total = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("serie"), F.lit(name).alias("valor"), "n")
    parts = [by(norms.filter("tipo = 'ordenanza'"), "procesado_llm", "ordenanzas"), by(norms, "estado", "normas"), by(articles, "estado", "articulos"), total(articles, "articulos"), total(refs, "referencias")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot(norms: DataFrame) -> DataFrame:
    """One line: enriched share overall and of ordinances."""
    done, ordinance = F.col("procesado_llm").isin(1, 2), F.col("tipo") == "ordenanza"
    return norms.agg(
        F.count(F.lit(1)).alias("total"),
        percent(F.count_if(done), F.count(F.lit(1))).alias("porcentaje"),
        F.count_if(ordinance).alias("ordenanzas"),
        percent(F.count_if(done & ordinance), F.count_if(ordinance)).alias("porcentaje_ordenanzas"),
        F.countDistinct("codigo_localidad").alias("municipios"),
    )


def embedding_coverage(norms: DataFrame, embedded: DataFrame) -> DataFrame:
    """Per municipality: norms, those with a vector, percent."""
    marked = norms.join(embedded.select("id").distinct().withColumn("_e", F.lit(1)), "id", "left")
    return marked.groupBy("codigo_localidad").agg(F.count(F.lit(1)).alias("total"), F.count("_e").alias("con_vector"), percent(F.count("_e"), F.count(F.lit(1))).alias("porcentaje"))


def relation_counts(refs: DataFrame, norms: DataFrame | None = None) -> DataFrame:
    rows = refs if norms is None else refs.join(norms.select(F.col("id").alias("norma_origen_id")), "norma_origen_id", "left_semi")
    return rows.groupBy("relacion").agg(F.count(F.lit(1)).alias("n"))


def category_counts(categories: DataFrame, assigned: DataFrame, with_empty: bool = False) -> DataFrame:
    """(id, parent_id, nombre, n) in order of the hierarchy: a parent before its children."""
    n = assigned.groupBy(F.col("categoria_id").alias("id")).agg(F.count("norma_id").alias("n"))
    out = categories.join(n, "id", "left" if with_empty else "inner").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.orderBy(F.coalesce("parent_id", "id"), F.col("parent_id").isNotNull(), "id")


def category_years(norms: DataFrame, assigned: DataFrame, categories: DataFrame) -> DataFrame:
    """(categoria, parent, anio, n, numeros): norms per category and year with their numbers in order."""
    rows = assigned.join(norms.select(F.col("id").alias("norma_id"), "anio", "numero"), "norma_id").join(categories.select(F.col("id").alias("categoria_id"), "nombre", "parent_nombre"), "categoria_id")
    return rows.groupBy(F.col("nombre").alias("categoria"), F.col("parent_nombre").alias("parent"), "anio").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("numero")).alias("numeros"))


def crawl_status(items: DataFrame, inventory: DataFrame, states: list[str]) -> DataFrame:
    """Every city of the inventory with its items per state and in total."""
    counts = items.groupBy("ciudad_id").pivot("estado", states).count()
    out = inventory.join(counts, "ciudad_id", "left").fillna(0, subset=states)
    return out.withColumn("total", sum((F.col(s) for s in states), F.lit(0)))


def batch_totals(runs: DataFrame, left: int) -> DataFrame:
    """Sums over finished cities, mean duration, and the seconds that ``left`` more take."""
    return runs.agg(*[F.sum(c).alias(c) for c in ("boletines", "normas", "descargas", "fallos")], F.round(F.avg("segundos"), 4).alias("media"), F.round(F.avg("segundos") * left, 4).alias("eta"))


def compare_extractors(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over norms in both: share of a's categories that b has, count differences, mean times. Tables: (id, categorias, referencias, ms)."""
    j = a.alias("a").join(b.alias("b"), "id")
    shared, mine = F.sum(F.size(F.array_intersect("a.categorias", "b.categorias"))), F.sum(F.size("a.categorias"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(shared / F.greatest(F.lit(1), mine), 4).alias("solape"), F.sum(F.col("b.referencias") - F.col("a.referencias")).alias("dif_referencias"), F.round(F.avg("a.ms"), 4).alias("ms_a"), F.round(F.avg("b.ms"), 4).alias("ms_b"))


#: Spanish stop words. Words are folded before they are compared, so those with an accent never match.
STOP_WORDS = (
    "el", "la", "de", "que", "y", "a", "en", "un", "ser", "se", "no", "haber",
    "por", "con", "su", "para", "como", "estar", "tener", "le", "lo", "todo",
    "pero", "más", "hacer", "o", "poder", "decir", "este", "ir", "otro", "ese",
    "la", "si", "me", "ya", "ver", "porque", "dar", "cuando", "él", "muy",
    "sin", "vez", "mucho", "saber", "qué", "sobre", "mi", "alguno", "mismo",
    "yo", "también", "hasta", "año", "dos", "querer", "entre", "así", "primero",
    "desde", "grande", "eso", "ni", "nos", "llegar", "pasar", "tiempo", "ella",
    "sí", "día", "uno", "bien", "poco", "deber", "entonces", "poner", "cosa",
    "tanto", "hombre", "parecer", "nuestro", "tan", "donde", "ahora", "parte",
    "después", "vida", "quedar", "siempre", "creer", "hablar", "llevar", "dejar",
    "nada", "cada", "seguir", "menos", "nuevo", "encontrar", "algo", "solo",
)
KEYWORD = r"(?<![a-z0-9_])([a-z]{4,})(?![a-z0-9_])"


def keywords(norms: DataFrame, id_col: str = "id", text_col: str = "texto", most: int = 8, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, palabras): the most frequent folded words of four letters a to z and more that aren't stop words, ties in order of the word."""
    words = norms.select(F.col(id_col).alias("id"), F.explode(all_found(fold(F.col(text_col)), KEYWORD)).alias("w")).filter(~F.col("w").isin(*stop))
    counted = words.groupBy("id", "w").count()
    w = Window.partitionBy("id").orderBy(F.desc("count"), "w")
    best = counted.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    return best.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "w"))), lambda x: x["w"]).alias("palabras"))


def distinct_types_years(norms: DataFrame) -> DataFrame:
    return norms.agg(F.array_sort(F.collect_set("tipo")).alias("tipos"), F.array_sort(F.collect_set("anio")).alias("anios"))


def retrieval_report(ranked: DataFrame, cases: DataFrame, text_col: str = "texto", most: int = 10) -> DataFrame:
    """(casos, con_acierto, tasa): cases (query_id, palabras) with a word of theirs in one of the ranked texts (query_id, puesto, texto)."""
    hits = ranked.filter(F.col("puesto") <= most).join(cases, "query_id").withColumn("_t", fold(text_col))
    hit = hits.groupBy("query_id").agg(F.max(F.exists("palabras", lambda w: F.contains(F.col("_t"), fold(w)))).alias("hit"))
    return cases.select("query_id").join(hit, "query_id", "left").agg(F.count(F.lit(1)).alias("casos"), F.count_if("hit").alias("con_acierto"), F.round(F.avg(F.coalesce(F.col("hit"), F.lit(False)).cast("int")), 4).alias("tasa"))


def latency_report(timings: DataFrame, c: str = "ms") -> DataFrame:
    """(n, media, p50, p95, por_segundo) of latencies in milliseconds."""
    return timings.agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("media"), F.round(F.percentile(c, 0.5), 4).alias("p50"), F.round(F.percentile(c, 0.95), 4).alias("p95"), F.round(F.count(c) * 1000.0 / F.sum(c), 4).alias("por_segundo"))
