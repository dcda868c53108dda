"""Sources and sinks: Markdown and text corpora, JSON state, inventories, partitioned tables, CSV and Markdown output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.parse import body, content_id, considerando, frontmatter, legal_number, meta, norm_defaults, official_extract, title, visto
from lexmill.functions.text import found, parse_date, safe_int, slugify


def decoded(content):
    """Bytes as text: UTF-8 if valid, else Latin-1."""
    utf8 = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else F.decode(content, "UTF-8")
    return F.coalesce(utf8, F.decode(content, "ISO-8859-1"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, texto) of all .md files below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(F.col("content")).alias("texto"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, anio, numero, texto) of .txt files in folders named by year, with the number after N° in the file's name."""
    return text_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path))


def text_rows(files: DataFrame) -> DataFrame:
    """(path, anio, numero, texto) of text files given as (path, content)."""
    p = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    return files.select(p.alias("path"), F.regexp_extract(p, r"/(\d{4})/[^/]*$", 1).try_cast("int").alias("anio"), F.regexp_extract(p, r"[N][°º]\s*(\d+)[^/]*$", 1).try_cast("int").alias("numero"), decoded(F.col("content")).alias("texto"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold one array or object each."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def inventory(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(codigo, slug, ordenanzas, decretos) from paths .../<id>-<slug>/<ordenanzas|decretos>/<file>."""
    p = r"/0*(\d+)-([^/]+)/(ordenanzas|decretos)/[^/]+$"
    rows = paths.select(F.regexp_extract(path_col, p, 1).try_cast("int").alias("codigo"), F.regexp_extract(path_col, p, 2).alias("slug"), F.regexp_extract(path_col, p, 3).alias("k")).filter("codigo is not null")
    return rows.groupBy("codigo", "slug").agg(F.count_if(F.col("k") == "ordenanzas").alias("ordenanzas"), F.count_if(F.col("k") == "decretos").alias("decretos"))


def parse_norms(files: DataFrame) -> DataFrame:
    """Norm rows of (path, texto): front matter, number, sections, extracts; files without a content id go."""
    m = F.col("_m")
    rows = files.withColumn("_m", frontmatter("texto")).withColumn("_b", body("texto")).withColumn("contenido_id", content_id(m)).filter("contenido_id is not null")
    d = norm_defaults(m)
    rows = rows.withColumn("tipo", d["tipo"]).withColumn("version", d["version"])
    heading = F.coalesce(found(F.col("_b"), r"(?m)^#[ \t]+(.*?)[ \t]*$"), F.lit(""))
    rows = rows.withColumn("_n", legal_number(F.col("tipo"), heading, F.col("_b")))
    rows = rows.withColumn("numero", F.coalesce(safe_int(meta(m, "numero")), F.col("_n.numero"))).withColumn("anio", F.coalesce(safe_int(meta(m, "anio")), F.col("_n.anio")))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    extract = F.when(F.col("version") == "extracto", official_extract("_b"))
    return rows.select(
        "contenido_id",
        "tipo",
        "numero",
        "anio",
        safe_int(meta(m, "municipio_id")).alias("codigo_localidad"),
        meta(m, "municipio").alias("localidad"),
        parse_date(F.coalesce(meta(m, "fecha"), F.lit(""))).alias("fecha"),
        safe_int(meta(m, "boletin")).alias("boletin"),
        "version",
        title(F.col("_b"), F.col("tipo"), F.col("numero"), F.col("anio"), stem).alias("titulo"),
        visto("_b").alias("seccion_visto"),
        considerando("_b").alias("seccion_considerando"),
        F.trim("_b").alias("texto_completo"),
        d["estado"].alias("estado"),
        extract.alias("summary"),
        F.when(extract.isNotNull(), 2).otherwise(0).alias("procesado_llm"),
        d["url"].alias("url"),
    )


def replace_partitions(norms: DataFrame, path: str, by: str = "codigo_localidad") -> None:
    """Write norms by municipality; the municipalities that the rows have are replaced whole, others stay."""
    norms.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def markdown_rows(norms: DataFrame) -> DataFrame:
    """(localidad_slug, archivo, value): each norm as front matter, heading and body, with its file's name."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    text = F.concat_ws("\n", F.lit("---"), line("tipo", "tipo"), line("municipio", "localidad"), line("municipio_id", "codigo_localidad"), line("numero", "numero"), line("anio", "anio"), line("contenido_id", "contenido_id"), F.lit("---"), F.concat(F.lit("# "), F.col("titulo")), F.lit(""), F.coalesce("texto", F.lit("")))
    name = F.concat_ws("-", "tipo", F.lpad(F.coalesce(F.col("numero").cast("string"), F.lit("sn")), 4, "0"), F.coalesce(F.col("anio").cast("string"), F.lit("sa")))
    return norms.select(slugify("localidad").alias("localidad_slug"), name.alias("archivo"), text.alias("value"))


def write_markdown(norms: DataFrame, path: str) -> None:
    """One folder per municipality and file name, each with the text of its norms."""
    markdown_rows(norms).write.mode("overwrite").partitionBy("localidad_slug", "archivo").option("lineSep", "\n").text(path)


def vector_table(cache: DataFrame, articles: DataFrame, norms: DataFrame, model: str) -> DataFrame:
    """(id, norma_id, titulo, vector): cached vectors of a model, from JSON, with their articles and norms."""
    v = cache.filter(F.col("modelo") == model).select(F.col("articulo_id").alias("id"), F.from_json("vector", "array<double>").alias("vector"))
    return v.join(articles.select("id", "norma_id"), "id").join(norms.select(F.col("id").alias("norma_id"), "titulo"), "norma_id")
