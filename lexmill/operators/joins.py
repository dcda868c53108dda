"""Joins: references to norms, entities, annexes, caches, records with their children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tipo", "numero", "anio", "codigo_localidad"]


def resolve_references(refs: DataFrame, norms: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``refs`` with ``norma_destino_id``, set where it's null from the norm of least id with the reference's ``destino_*`` key.

    Keys with a null never match, and are kept out of the join, so they pile up in no partition.
    """
    targets = norms.dropna(subset=keys).groupBy(*keys).agg(F.min("id").alias("_id"))
    on = [f"destino_{k}" if k != "codigo_localidad" else k for k in keys]
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    open_ = F.col("norma_destino_id").isNull() & known
    found = refs.filter(open_).join(targets.select(*[F.col(k).alias(c) for k, c in zip(keys, on, strict=True)], "_id"), on, "left")
    found = found.withColumn("norma_destino_id", F.col("_id")).select(*refs.columns)
    return refs.filter(~open_).unionByName(found)


def drop_dangling(refs: DataFrame) -> DataFrame:
    """References with a local norm or an outside text."""
    return refs.filter(F.col("norma_destino_id").isNotNull() | F.col("destino_referencia").isNotNull())


def with_category_ids(assigned: DataFrame, categories: DataFrame) -> DataFrame:
    """Slugs become ids; unknown slugs go."""
    return assigned.join(categories.select("slug", F.col("id").alias("categoria_id")), "slug").drop("slug")


def merge_entities(known: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links): mentions matched by (nombre, tipo); new ones get a hashed id; a missing tax id is filled in; links are unique by norm, entity and role."""
    fresh = mentions.groupBy("nombre", "tipo").agg(F.min("cuit").alias("_cuit"))
    both = known.join(fresh, ["nombre", "tipo"], "full_outer")
    entities = both.select(F.coalesce("id", F.xxhash64("nombre", "tipo")).alias("id"), "nombre", "tipo", F.coalesce("cuit", "_cuit").alias("cuit"))
    links = mentions.join(entities.select(F.col("id").alias("entidad_id"), "nombre", "tipo"), ["nombre", "tipo"]).select("norma_id", "entidad_id", "rol").distinct()
    return entities, links


def attach_annexes(norms: DataFrame, contents: DataFrame) -> DataFrame:
    """(norma_id, nombre, url) from crawl rows (cid, anexos) by content id."""
    rows = contents.select("cid", F.explode("anexos").alias("a"))
    return rows.join(norms.select(F.col("id").alias("norma_id"), F.col("contenido_id").alias("cid")), "cid").select("norma_id", "a.nombre", "a.url")


def not_in(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a partner in ``done``; nulls there don't matter."""
    return rows.join(done.select(key).dropna().distinct(), key, "left_anti")


def children(rows: DataFrame, parent: str, name: str, order: str, fields: list[str]) -> DataFrame:
    """(parent, name): each parent's child rows as an array of structs in order."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v"))))
    return rows.groupBy(parent).agg(F.transform(packed, lambda x: x["v"]).alias(name))


def full_records(norms: DataFrame, parts: dict[str, tuple[DataFrame, str, list[str]]], id_col: str = "id", parent: str = "norma_id") -> DataFrame:
    """Norms with an array for each child table, given as name: (rows, order column, fields); an empty array where there are none."""
    out = norms
    for name, (rows, order, fields) in parts.items():
        own = children(rows, parent, name, order, fields).withColumnRenamed(parent, id_col)
        out = out.join(own, id_col, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def response_documents(norms: DataFrame, parts: dict[str, tuple[DataFrame, str, list[str]]], fields: list[str], id_col: str = "id", parent: str = "norma_id") -> DataFrame:
    """(id, documento): each norm's ``fields`` and child tables (as in ``full_records``) as one JSON object; no children give an empty array."""
    return full_records(norms, parts, id_col, parent).select(id_col, F.to_json(F.struct(*fields, *parts), {"ignoreNullFields": "false"}).alias("documento"))


def cache_key(text: str, model: str, style: str, length: int):
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(style), F.lit(str(length)), F.col(text)), 256)


def cached(requests: DataFrame, cache: DataFrame, text_col: str, model: str, style: str = "formal", length: int = 50) -> DataFrame:
    """``requests`` with ``clave``, the cached ``resumen`` or null, and ``hit``."""
    keyed = requests.withColumn("clave", cache_key(text_col, model, style, length))
    return keyed.join(cache.select("clave", "resumen"), "clave", "left").withColumn("hit", F.col("resumen").isNotNull())


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key (a null is a key too) the row of greatest ``order``; rows without one come before all others."""
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(c) for c in rows.columns if c not in keys])
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those with their keys; of a key's several new rows the one of greatest
    ``order``. Without an order a key may stand once in ``new``, else that is an error."""
    once = newest(new, keys, order) if order else new
    if not order and not new.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("a key stands several times in a batch without an order")
    taken = once.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return old.join(taken, same, "left_anti").unionByName(once.select(*old.columns))


def append_new(known: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``batch`` whose key isn't known yet, the first of each key; rows without a key go."""
    first = Window.partitionBy(key).orderBy(order)
    once = batch.filter(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    return not_in(once, known, key)


def with_parent(categories: DataFrame) -> DataFrame:
    up = categories.select(F.col("id").alias("parent_id"), F.col("nombre").alias("parent_nombre"))
    return categories.join(up, "parent_id", "left")


def by_natural_key(norms: DataFrame, kind: str, number: int, year: int) -> DataFrame:
    """Norms of a key, each with how many municipalities have one (``ambigua`` if over one)."""
    hits = norms.filter((F.col("tipo") == kind) & (F.col("numero") == number) & (F.col("anio") == year))
    n = F.size(F.collect_set("codigo_localidad").over(Window.partitionBy("tipo", "numero", "anio")))
    return hits.withColumn("municipios", n).withColumn("ambigua", F.col("municipios") > 1)


def two_directions(norms: DataFrame, refs: DataFrame) -> DataFrame:
    """(norma_id, direccion, otra_id, otra_titulo, relacion, ref_id): outgoing references, outside ones too, and incoming ones."""
    title = norms.select(F.col("id").alias("otra_id"), F.col("titulo").alias("otra_titulo"))
    ids = norms.select(F.col("id").alias("norma_id"))
    out = refs.select(F.col("norma_origen_id").alias("norma_id"), F.lit("afecta_a").alias("direccion"), F.col("norma_destino_id").alias("otra_id"), "relacion", "ref_id")
    back = refs.filter("norma_destino_id is not null").select(F.col("norma_destino_id").alias("norma_id"), F.lit("afectada_por").alias("direccion"), F.col("norma_origen_id").alias("otra_id"), "relacion", "ref_id")
    return out.join(ids, "norma_id").join(title, "otra_id", "left").unionByName(back.join(ids, "norma_id").join(title, "otra_id"))
