"""Ordered work: republication dedup, the in-force cascade, capped candidates, classified categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Severity of relations and the state each gives.
SEVERITY = {"modifica": 1, "modifica_parcial": 1, "sustituye": 1, "deroga_parcial": 2, "deroga": 3, "deroga_total": 3}
STATE = {0: "vigente", 1: "modificada", 2: "derogada_parcial", 3: "derogada"}


def severity(c):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (k, v)]), c), F.lit(0))


def state_severity(c):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in STATE.items() for x in (v, k)]), c), F.lit(0))


def state_name(c):
    return F.element_at(F.create_map(*[F.lit(x) for k, v in STATE.items() for x in (k, v)]), c)


def republications(records: DataFrame, key: list[str]) -> DataFrame:
    """``records`` with es_republicacion_de, tambien_en and ids_repetidos.

    Of a key, the first by bulletin, complete before extract, then content id is primary; the others name it. The
    primary carries the other bulletins, distinct and sorted as strings (its own, if all are in one), and the others' ids.
    Records with a null in their key (no file) are republications of nothing.
    """
    keyed = F.lit(True)
    for c in key:
        keyed = keyed & F.col(c).isNotNull()
    alone = records.filter(~keyed).withColumns({"es_republicacion_de": F.lit(None).cast(records.schema["contenido_id"].dataType), "tambien_en": F.lit(None).cast("array<string>"), "ids_repetidos": F.lit(None).cast(T.ArrayType(records.schema["contenido_id"].dataType))})
    records = records.filter(keyed)
    w = Window.partitionBy(*key).orderBy("boletin", F.when(F.col("version") == "completa", 0).otherwise(1), "contenido_id")
    ranked = records.withColumn("_k", F.row_number().over(w)).withColumn("_first", F.first("contenido_id").over(w)).withColumn("_bulletin", F.first("boletin").over(w))
    other = ranked.filter("_k > 1").groupBy(*key).agg(
        F.sort_array(F.collect_set(F.when(F.col("boletin") != F.col("_bulletin"), F.col("boletin").cast("string")))).alias("_others"),
        F.sort_array(F.collect_list("contenido_id")).alias("_ids"),
    )
    joined = ranked.join(other, key, "left")
    primary = F.col("_k") == 1
    also = F.when(F.size("_others") > 0, F.col("_others")).when(F.col("_ids").isNotNull(), F.array(F.col("_bulletin").cast("string")))
    found = joined.select(*records.columns, F.when(~primary, F.col("_first")).alias("es_republicacion_de"), F.when(primary, also).alias("tambien_en"), F.when(primary, F.col("_ids")).alias("ids_repetidos"))
    return found.unionByName(alone)


def article_states(refs: DataFrame, sticky_repeal: bool = False) -> DataFrame:
    """(norma_id, articulo, estado, modificado_por) by the last reference that names the article; or, if sticky, the last repeal before all else."""
    s = severity(F.col("relacion"))
    rows = refs.select("ref_id", "norma_origen_id", F.col("norma_destino_id").alias("norma_id"), s.alias("s"), F.explode("articulos").alias("articulo")).filter("s > 0")
    order = [F.col("s") >= 2, F.col("ref_id")] if sticky_repeal else [F.col("ref_id")]
    last = rows.groupBy("norma_id", "articulo").agg(F.max(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], "s", "norma_origen_id")).alias("m"))
    return last.select("norma_id", "articulo", F.when(F.col("m.s") >= 2, "derogado").otherwise("modificado").alias("estado"), F.col("m.norma_origen_id").alias("modificado_por"))


def norm_states(norms: DataFrame, refs: DataFrame) -> DataFrame:
    """Norms with the state of the strongest effect on them, never weaker than the stored one."""
    most = refs.filter("norma_destino_id is not null").groupBy(F.col("norma_destino_id").alias("id")).agg(F.max(severity(F.col("relacion"))).alias("_s"))
    joined = norms.join(most, "id", "left")
    return joined.withColumn("estado", state_name(F.greatest(state_severity(F.col("estado")), F.coalesce("_s", F.lit(0))))).drop("_s")


def relation_report(norms: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, norma_id, relacion, etiqueta, antes, despues): each effect in order of references, with the state before and after it."""
    s = severity(F.col("relacion"))
    effects = refs.filter(F.col("norma_destino_id").isNotNull() & (s > 0)).withColumn("_s", s)
    # the state before a reference follows from where each severity first occurs: three minima a norm, however many references it has
    firsts = effects.groupBy("norma_destino_id").agg(*[F.min(F.when(F.col("_s") == k, F.col("ref_id"))).alias(f"_f{k}") for k in (1, 2, 3)])
    stored = norms.select(F.col("id").alias("norma_destino_id"), state_severity(F.col("estado")).alias("_stored"))
    joined = effects.join(stored.join(firsts, "norma_destino_id"), "norma_destino_id")
    prior = F.greatest(F.col("_stored"), *[F.when(F.col(f"_f{k}") < F.col("ref_id"), k).otherwise(0) for k in (1, 2, 3)])
    return joined.select("ref_id", F.col("norma_destino_id").alias("norma_id"), "relacion", "etiqueta", state_name(prior).alias("antes"), state_name(F.greatest(prior, F.col("_s"))).alias("despues"), (F.col("_s") >= prior).alias("anotada"))


def validity_notes(norms: DataFrame, report: DataFrame) -> DataFrame:
    """(id, notas): each origin's first note that no stronger state blocks, after the stored notes and unless they have it, joined by ' | ' in order."""
    first = report.filter("anotada").groupBy("norma_id", "etiqueta").agg(F.min(F.struct("ref_id", "relacion")).alias("m"))
    joined = first.join(norms.select(F.col("id").alias("norma_id"), F.coalesce("notas_vigencia", F.lit("")).alias("_old")), "norma_id").filter(~F.contains("_old", "etiqueta"))
    notes = joined.groupBy("norma_id").agg(F.max("_old").alias("_old"), F.array_sort(F.collect_list(F.struct("m.ref_id", F.concat_ws(" ", "m.relacion", "etiqueta").alias("n")))).alias("_n"))
    text = F.array_join(F.transform("_n", lambda x: x["n"]), " | ")
    return notes.select(F.col("norma_id").alias("id"), F.when(F.col("_old") != "", F.concat_ws(" | ", "_old", text)).otherwise(text).alias("notas"))


def capped_candidates(ranked: DataFrame, per_group: int, total: int, group: str = "codigo_localidad", rank: str = "puesto") -> DataFrame:
    """The best ``per_group`` of each group by rank, then ``total`` at most in order of groups."""
    w = Window.partitionBy(group).orderBy(rank, "id")
    return ranked.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_group).orderBy(group, "_k").limit(total).drop("_k")


def page_priority(cards: DataFrame) -> DataFrame:
    """Cards page by page; in a page laws, resolutions, decrees, others; then as they stood."""
    rank = F.when(F.col("tipo") == "Ley", 0).when(F.col("tipo") == "Resolucion", 1).when(F.col("tipo") == "Decreto", 2).otherwise(3)
    return cards.withColumn("prioridad", rank).orderBy("page", "prioridad", "posicion")


def top_categories(scores: DataFrame, least: float = 0.3, most: int = 3) -> DataFrame:
    """A norm's best three categories over ``least``, or its best one if none is."""
    w = Window.partitionBy("norma_id").orderBy(F.desc("score"), "slug")
    ranked = scores.withColumn("puesto", F.row_number().over(w))
    return ranked.filter((F.col("puesto") == 1) | ((F.col("puesto") <= most) & (F.col("score") > least)))


def first_per_id(*outputs: DataFrame) -> DataFrame:
    """The union of search outputs, the first record of each id in order of the outputs and their ``puesto``."""
    rows = None
    for k, df in enumerate(outputs):
        own = df.withColumn("_from", F.lit(k))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("_from", "puesto")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_from")
