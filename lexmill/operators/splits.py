"""One-to-many splits: articles of norms and child rows of extractions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.extraction import embedded_articles
from lexmill.functions.text import all_found, strip
from lexmill.session import ship_package

_MARK = r"(?:art[ií]culo|art\.)\s*(\d+)\s*[º°]?\s*(bis|ter|quater|quinquies)?"


def split_articles(norms: DataFrame, id_col: str = "id", text_col: str = "texto", only: str = "1", cut: int = 250) -> DataFrame:
    """(id, numero, orden, texto, resumen): from each line that opens with 'artículo n' or 'art. n' to the next.

    The abstract is the first line, with the second if the first has under 40 characters, cut. A norm without a mark
    is one article ``only``, with an abstract of 180 characters.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.filter(F.split(t, rf"(?imu)(?=^[ \t]*{_MARK})"), lambda x: x.rlike(rf"(?iu)^\s*{_MARK}"))
    rows = norms.select(F.col(id_col).alias("id"), t.alias("_t"), F.posexplode_outer(parts).alias("_k", "_part"))
    number = F.concat_ws(" ", F.regexp_extract("_part", rf"(?iu)^\s*{_MARK}", 1), F.nullif(F.lower(F.regexp_extract("_part", rf"(?iu)^\s*{_MARK}", 2)), F.lit("")))
    text = strip(F.regexp_replace("_part", rf"(?iu)^\s*{_MARK}\s*[:.\-–]*\s*", ""))
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    abstract = F.substring(F.when(F.length(first) < 40, F.concat_ws(" ", first, F.get(lines, F.lit(1)))).otherwise(first), 1, cut)
    none = F.col("_part").isNull()
    return rows.select(
        "id",
        F.when(none, only).otherwise(number).alias("numero"),
        (F.coalesce("_k", F.lit(0)) + 1).alias("orden"),
        F.when(none, strip("_t")).otherwise(text).alias("texto"),
        F.when(none, F.substring(strip("_t"), 1, 180)).otherwise(abstract).alias("resumen"),
    )


def strict_articles(norms: DataFrame, id_col: str = "id", text_col: str = "texto") -> DataFrame:
    """(id, numero, texto) of 'ARTÍCULO n°:' up to the next, to DADA EN LA SALA or to the end; empty ones are left out."""
    p = r"(?isu)ART[IÍ]CULO\s+(\d+)\s*[º°]\s*:\s*(.*?)(?=ART[IÍ]CULO\s+\d+\s*[º°]\s*:|DADA\s+EN\s+LA\s+SALA|\z)"
    rows = F.arrays_zip(all_found(F.col(text_col), p, 1).alias("numero"), all_found(F.col(text_col), p, 2).alias("texto"))
    return norms.select(F.col(id_col).alias("id"), F.inline(rows)).withColumn("texto", strip("texto")).filter("texto <> ''")


def article_contexts(norms: DataFrame, id_col: str = "id", text_col: str = "texto", before: int = 100, after: int = 200) -> DataFrame:
    """(id, numero, contexto): the characters around each article number that the text names; else its first 500 as article 1."""
    ship_package(norms.sparkSession)
    mark = r"(?i)\b(?:art[ií]culos?|arts?\.)\s*(\d+)"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(mark)
        for batch in batches:
            at, numbers, contexts = [], [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                t = t or ""
                hits = [(m[1], t[max(0, m.start() - before) : m.end() + after]) for m in pattern.finditer(t)] or [("1", t[:500])]
                at += [k] * len(hits)
                numbers += [n for n, _ in hits]
                contexts += [c for _, c in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.string()), pa.array(contexts, pa.string())], ["id", "numero", "contexto"])

    kind = norms.schema[id_col].dataType.simpleString()
    return norms.select(id_col, text_col).mapInArrow(read, f"id {kind}, numero string, contexto string")


def one_per_number(articles: DataFrame, keep: str = "first", norm_col: str = "id", number_col: str = "numero", order_col: str = "orden") -> DataFrame:
    """One article of each number in a norm: the first or the last."""
    order = F.col(order_col).asc() if keep == "first" else F.col(order_col).desc()
    w = Window.partitionBy(norm_col, number_col).orderBy(order)
    return articles.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def article_list(norms: DataFrame, id_col: str = "id", text_col: str = "texto") -> DataFrame:
    """(id, numero, contexto, estado): the articles of a JSON object in the text, under norma.articulos; texts without such a
    list give ``article_contexts``, without a state."""
    rows = norms.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), embedded_articles(text_col).alias("_listed"))
    listed = rows.filter(F.col("_listed").isNotNull()).select("id", F.explode("_listed").alias("_a")).select("id", "_a.numero", F.col("_a.contenido").alias("contexto"), "_a.estado")
    rest = article_contexts(rows.filter(F.col("_listed").isNull()), "id", "_text").withColumn("estado", F.lit(None).cast("string"))
    return listed.unionByName(rest)


def fan_out(extractions: DataFrame, id_col: str = "id", parsed_col: str = "e") -> dict[str, DataFrame]:
    """A parsed response's own row (``normas``) and its child tables, each array's rows with the norm's id and place (orden).

    Amounts need a value and a concept (their currency is ARS and they are no percentages unless said), annexes a number;
    references keep their numbers to be resolved, categories their slugs. Rows that are no response (null) give nothing.
    """
    e = F.col(parsed_col)
    good = extractions.filter(e.isNotNull()).select(F.col(id_col).alias("norma_id"), e.alias("_e"))
    lists = ("articulos", "entidades", "categorias", "referencias", "montos_detallados", "anexos")
    single = [f for f in extractions.schema[parsed_col].dataType.names if f not in lists]
    out = {"normas": good.select("norma_id", *[F.col(f"_e.{f}").alias(f) for f in single])}
    for name in lists:
        rows = good.select("norma_id", F.posexplode(f"_e.{name}").alias("_k", "_row")).select("norma_id", (F.col("_k") + 1).alias("orden"), "_row.*")
        out[name] = rows
    amounts = out["montos_detallados"].filter("valor is not null and concepto <> ''")
    out["montos_detallados"] = amounts.withColumns({"moneda": F.coalesce(F.nullif("moneda", F.lit("")), F.lit("ARS")), "es_porcentaje": F.coalesce("es_porcentaje", F.lit(False))})
    out["anexos"] = out["anexos"].filter("numero is not null")
    return out
