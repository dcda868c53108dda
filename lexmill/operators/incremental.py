"""The in-force cascade batch by batch: mergeable effects per target, kept in buckets; any split into batches gives one run's result.

A reference's target is a norm's id, or the natural key that it names, resolved or not. Of each target, label and severity the
first reference is kept (the first of each severity follows: the three minima that decide what a later one finds), and of
each article the last one. Both merge by minimum and maximum, so a batch reads and writes only the buckets of its own targets.
Norms are looked up by id and by key when results are asked for: a norm that comes late, or one of smaller id for a
key, finds what waits for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.parse import affected_articles
from lexmill.operators.joins import KEY
from lexmill.operators.windows import severity, state_name, state_severity
from lexmill.sources.units import BUCKET, BUCKETS, read_parts, replace_parts, state, upsert_buckets


def _by_id(c: str) -> Column:
    return F.concat(F.lit("i:"), F.col(c).cast("string"))


def _by_key(*columns: str) -> Column:
    """Null if a part of the key is."""
    return F.concat(F.lit("k:"), *[x for c in columns for x in (F.lit("|"), F.col(c).cast("string"))])


def _merge(spark: SparkSession, rows: DataFrame, path: str, keys: list[str], best: Column) -> None:
    """Put a batch's rows of each key together with the stored ones of its buckets; ``best`` is an aggregate of structs."""
    rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64("target"), F.lit(BUCKETS)).cast("int"))
    touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]
    if not touched:
        return
    both = rows.unionByName(read_parts(spark, path, "filas", touched)) if state(spark, path) else rows
    merged = both.groupBy(BUCKET, *keys).agg(best.alias("m")).select(BUCKET, *keys, "m.*").select(*rows.columns)
    replace_parts(spark, {"filas": merged}, path, BUCKET, touched=touched)


def add_references(refs: DataFrame, path: str) -> None:
    """Merge a batch of references (as ``reconcile`` takes them) into the effects below ``path``."""
    spark = refs.sparkSession
    target = F.coalesce(_by_id("norma_destino_id"), _by_key("destino_tipo", "destino_numero", "destino_anio", "codigo_localidad"))
    rows = refs.withColumn("target", target).withColumn("s", severity(F.col("relacion"))).filter("target is not null and s > 0")
    _merge(spark, rows.select("target", "s", "etiqueta", "ref_id", "relacion"), f"{path}/efectos", ["target", "s", "etiqueta"], F.min(F.struct("ref_id", "relacion")))
    articles = rows.select("target", F.explode(F.array_distinct(affected_articles("articulos_afectados"))).alias("articulo"), "ref_id", "s", "norma_origen_id")
    _merge(spark, articles, f"{path}/articulos", ["target", "articulo"], F.max(F.struct("ref_id", "s", "norma_origen_id")))


def add_norms(norms: DataFrame, path: str, order: str = "id") -> None:
    """Put norms in place of stored ones of their ids."""
    upsert_buckets(norms.sparkSession, norms.select("id", *KEY, "estado", "notas_vigencia", *([order] if order != "id" else [])), f"{path}/normas", ["id"], order)


def reconciled(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``normas`` (id, estado), ``notas`` (id, notas) and ``articulos`` (norma_id, articulo, estado, modificado_por) of all batches so far."""
    norms = read_parts(spark, f"{path}/normas", "filas")
    first = norms.dropna(subset=KEY).groupBy(*KEY).agg(F.min("id").alias("id"))
    targets = norms.select("id", _by_id("id").alias("target")).unionByName(first.select("id", _by_key(*KEY).alias("target")))

    def stored(name: str, schema: str) -> DataFrame:
        rows = read_parts(spark, f"{path}/{name}", "filas") if state(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
        return targets.join(rows, "target")

    effects = stored("efectos", "target string, s int, etiqueta string, ref_id long, relacion string")
    minima = effects.groupBy("id").agg(*[F.min(F.when(F.col("s") == k, F.col("ref_id"))).alias(f"f{k}") for k in (1, 2, 3)])
    known = norms.select("id", state_severity(F.col("estado")).alias("now"), F.coalesce("notas_vigencia", F.lit("")).alias("old")).join(minima, "id", "left")
    strongest = F.greatest("now", *[F.when(F.col(f"f{k}").isNotNull(), k).otherwise(0) for k in (1, 2, 3)])
    # a first reference of its label and severity is noted unless a stronger state held already
    open_ = effects.join(known, "id").filter("s >= now").filter(" and ".join(f"(s >= {k} or f{k} is null or f{k} > ref_id)" for k in (2, 3)))
    noted = open_.groupBy("id", "etiqueta").agg(F.min(F.struct("ref_id", "relacion")).alias("m"), F.first("old").alias("old")).filter(~F.contains("old", "etiqueta"))
    lists = noted.groupBy("id").agg(F.first("old").alias("old"), F.array_sort(F.collect_list(F.struct("m.ref_id", F.concat_ws(" ", "m.relacion", "etiqueta").alias("n")))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: x["n"]), " | ")
    articles = stored("articulos", "target string, articulo string, ref_id long, s int, norma_origen_id long")
    last = articles.withColumn("k", F.row_number().over(Window.partitionBy("id", "articulo").orderBy(F.desc("ref_id")))).filter("k = 1")
    return {
        "normas": known.select("id", state_name(strongest).alias("estado")),
        "notas": lists.select("id", F.when(F.col("old") != "", F.concat_ws(" | ", "old", text)).otherwise(text).alias("notas")),
        "articulos": last.select(F.col("id").alias("norma_id"), "articulo", F.when(F.col("s") >= 2, "derogado").otherwise("modificado").alias("estado"), F.col("norma_origen_id").alias("modificado_por")),
    }
