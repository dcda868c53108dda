"""Filters, listings, paging, pending selections, and the audit of constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import fold, slugify

IN_FORCE = ("vigente", "modificada")


def resolve_municipality(inventory: DataFrame, wanted: str) -> DataFrame:
    """The one row of (codigo, nombre, slug) that ``wanted`` means: exact id, else exact slug or name without accents, else a part of either.

    Raises ValueError for an empty or unknown one.
    """
    if not str(wanted or "").strip():
        raise ValueError("a municipality is needed")
    w = F.lit(str(wanted).strip())
    rank = (
        F.when(F.col("codigo").cast("string") == w, 1)
        .when((F.col("slug") == slugify(w)) | (fold("nombre") == fold(w)), 2)
        .when(F.contains("slug", slugify(w)) | F.contains(fold("nombre"), fold(w)), 3)
    )
    best = inventory.withColumn("_r", rank).filter("_r is not null").orderBy("_r", "codigo").limit(1).drop("_r")
    if best.isEmpty():
        raise ValueError(f"no municipality is like {wanted!r}")
    return best


def of_municipality(norms: DataFrame, inventory: DataFrame, wanted: str | None, code_col: str = "codigo_localidad") -> DataFrame:
    """All norms, or those of one municipality."""
    if wanted is None:
        return norms
    return norms.filter(F.col(code_col) == resolve_municipality(inventory, wanted).first()["codigo"])


def of_type(norms: DataFrame, kind: str = "todos") -> DataFrame:
    return norms if kind == "todos" else norms.filter(F.col("tipo") == kind)


def in_force(norms: DataFrame) -> DataFrame:
    return norms.filter(F.col("estado").isin(*IN_FORCE))


def year_range(norms: DataFrame, since: int, until: int) -> DataFrame:
    """Norms of known year in the range, ends included."""
    if since > until:
        raise ValueError("the range ends before it begins")
    return norms.filter(F.col("anio").between(since, until))


def dossier_years(norms: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """As ``year_range``, but a norm of unknown year stays."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("anio").isNull() | (F.col("anio") >= since))
    if until is not None:
        keep = keep & (F.col("anio").isNull() | (F.col("anio") <= until))
    return norms.filter(keep)


def by_category(norms: DataFrame, assigned: DataFrame, categories: DataFrame, slug: str, year: int | None = None) -> DataFrame:
    """Norms of a category with the assignment's relevance."""
    wanted = categories.filter(F.col("slug") == slug).select(F.col("id").alias("categoria_id"), "slug")
    out = norms.join(assigned.join(wanted, "categoria_id").select("norma_id", "slug", "relevancia"), F.col("id") == F.col("norma_id")).drop("norma_id")
    return out if year is None else out.filter(F.col("anio") == year)


def by_entity(norms: DataFrame, entities: DataFrame, mentions: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Norms that mention an entity whose name or slug has ``name`` in it, in any case; the last mention of each norm."""
    e = entities.filter(F.contains(F.lower("nombre"), F.lit(name.lower())) | F.contains("slug", F.lit(name.lower())))
    e = e if kind is None else e.filter(F.col("tipo") == kind)
    hits = mentions.join(e.select(F.col("id").alias("entidad_id"), "nombre"), "entidad_id").groupBy("norma_id").agg(F.max(F.struct("mencion_id", "nombre")).alias("m"))
    return norms.join(hits, F.col("id") == F.col("norma_id")).select(norms["*"], F.col("m.nombre").alias("entidad"))


def annexes(all_: DataFrame, annex_id: int | None = None, norm_id: int | None = None, name: str | None = None) -> DataFrame:
    """An annex by id, or a norm's whose name has ``name`` in it, or a norm's first."""
    if annex_id is None and norm_id is None:
        raise ValueError("an annex or a norm is needed")
    if annex_id is not None:
        return all_.filter(F.col("id") == annex_id)
    own = all_.filter(F.col("norma_id") == norm_id)
    return own.filter(F.contains(F.lower("nombre"), F.lit(name.lower()))) if name else own.orderBy("id").limit(1)


def pending(norms: DataFrame, state_col: str = "procesado_llm", kind: str = "todos", limit: int | None = None) -> DataFrame:
    """Rows not processed yet, in order of id."""
    out = of_type(norms.filter(F.coalesce(F.col(state_col), F.lit(0)) == 0), kind)
    return out if limit is None else out.orderBy("id").limit(limit)


def indexable(rows: DataFrame, text_col: str = "texto", least: int = 5) -> DataFrame:
    return rows.filter(F.length(F.trim(text_col)) > least)


def work_list(cities: DataFrame, since: int, until: int, omit: DataFrame | None = None, with_done: bool = False, order: str = "id") -> DataFrame:
    """Cities in an id range that aren't omitted, finished or empty, in order of id or of pages (unknown ones last)."""
    out = cities.filter(F.col("id").between(since, until))
    out = out if omit is None else out.join(omit.select("id").distinct(), "id", "left_anti")
    if not with_done:
        out = out.filter(~F.coalesce("done", F.lit(False)) & (F.coalesce("pages", F.lit(9999)) > 0))
    return out.orderBy("id") if order == "id" else out.orderBy(F.coalesce("pages", F.lit(9999)), "id")


def newest_first(norms: DataFrame, *more: str) -> DataFrame:
    return norms.orderBy(F.desc_nulls_last("anio"), F.desc_nulls_last("numero"), "id", *more)


def page(ranked: DataFrame, limit: int = 20, cursor: int = 0) -> tuple[DataFrame, bool, int | None]:
    """(items, whether there are more, the next cursor) of rows that are already in a total order."""
    if limit < 1 or cursor < 0:
        raise ValueError("limit or cursor is out of bounds")
    more = ranked.offset(cursor).limit(limit + 1).count() > limit
    return ranked.offset(cursor).limit(limit), more, cursor + limit if more else None


def after_key(norms: DataFrame, year: int | None, number: int | None, last_id: int, limit: int) -> DataFrame:
    """The page after a known last row (keyset form, for deep pages), newest first."""
    y, n = F.coalesce("anio", F.lit(-1)), F.coalesce("numero", F.lit(-1))
    y0, n0 = F.lit(-1 if year is None else year), F.lit(-1 if number is None else number)
    rest = norms.filter((y < y0) | ((y == y0) & ((n < n0) | ((n == n0) & (F.col("id") > last_id)))))
    return newest_first(rest).limit(limit)


def violations(table: DataFrame, id_col: str, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(regla, clave) for each row that breaks a rule, in one scan, and for each key that isn't unique. A rule that is null holds."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    out = table.select(F.explode(broken).alias("regla"), F.col(id_col).cast("string").alias("clave"))
    for name, keys in (unique or {}).items():
        twice = table.dropna(subset=keys).groupBy(*keys).count().filter("count > 1")
        out = out.unionByName(twice.select(F.lit(name).alias("regla"), F.concat_ws("|", *keys).alias("clave")))
    return out


def reset_errors(norms: DataFrame, default_code: int) -> DataFrame:
    """Failed rows wait again; a missing municipality becomes the default one."""
    return norms.withColumn("procesado_llm", F.when(F.col("procesado_llm") == -1, 0).otherwise(F.col("procesado_llm"))).fillna({"codigo_localidad": default_code})
