"""The reference graph: trees around norms, and the in-force cascade over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.parse import affected_articles
from lexmill.operators.joins import resolve_references
from lexmill.operators.windows import article_states, norm_states, relation_report, validity_notes
from lexmill.session import save


def reference_tree(refs: DataFrame, roots: DataFrame, direction: str = "ambas", depth: int = 1, limit: int | None = None) -> DataFrame:
    """(root, ref_id, direccion, desde, hasta, relacion, profundidad): references reached within ``depth`` steps of each root.

    Breadth first, for all roots at once; a norm is expanded once per root, so cycles end; a reference stands once per
    root and direction, at its least depth. ``limit`` keeps a root's first by depth, reference and direction.
    """
    if direction not in ("ambas", "afecta_a", "afectada_por") or not 1 <= depth <= 5:
        raise ValueError("direction or depth is out of bounds")
    out = refs.filter("norma_destino_id is not null").select("ref_id", "relacion", F.col("norma_origen_id").alias("src"), F.col("norma_destino_id").alias("dst"))
    edges = None
    if direction != "afectada_por":
        edges = out.select("ref_id", "relacion", F.lit("afecta_a").alias("direccion"), F.col("src").alias("desde"), F.col("dst").alias("hasta"))
    if direction != "afecta_a":
        back = out.select("ref_id", "relacion", F.lit("afectada_por").alias("direccion"), F.col("dst").alias("desde"), F.col("src").alias("hasta"))
        edges = back if edges is None else edges.unionByName(back)
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("desde")).distinct()
    seen, found = frontier, None
    for level in range(1, depth + 1):
        step = save(frontier.join(edges, "desde").withColumn("profundidad", F.lit(level)), "tree")
        found = step if found is None else found.unionByName(step)
        if level < depth:
            reached = step.select("root", F.col("hasta").alias("desde")).distinct()
            frontier = save(reached.join(seen, ["root", "desde"], "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    rows = found.groupBy("root", "ref_id", "direccion").agg(F.min(F.struct("profundidad", "desde", "hasta", "relacion")).alias("m")).select("root", "ref_id", "direccion", "m.desde", "m.hasta", "m.relacion", "m.profundidad")
    if limit is None:
        return rows
    order = Window.partitionBy("root").orderBy("profundidad", "ref_id", "direccion")
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).drop("_k")


def reconcile(norms: DataFrame, refs: DataFrame, sticky_repeal: bool = False) -> dict[str, DataFrame]:
    """The cascade: references resolved, states of norms and articles, the report of each effect, notes. A second run changes nothing.

    ``refs``: ref_id, norma_origen_id, norma_destino_id or the destino_* key with codigo_localidad, relacion, etiqueta,
    articulos_afectados (free text).
    """
    resolved = resolve_references(refs, norms)
    named = resolved.withColumn("articulos", affected_articles("articulos_afectados"))
    report = relation_report(norms, named)
    return {
        "referencias": resolved,
        "normas": norm_states(norms, named),
        "articulos": article_states(named.filter("norma_destino_id is not null"), sticky_repeal),
        "informe": report,
        "notas": validity_notes(norms, report),
    }


def state_summary(norms: DataFrame, *by: str) -> DataFrame:
    return norms.groupBy(*by, "estado").agg(F.count(F.lit(1)).alias("n"))
