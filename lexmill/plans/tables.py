"""Norm-like tables derived from the given ones, as expressions that Spark and DuckDB both read, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.session import table

_DOCS = {
    "id": "doc_id",
    "codigo_localidad": "cast(substr(source, 4) as int)",
    "localidad": "source",
    "tipo": "case when doc_id % 3 = 0 then 'ordenanza' else 'decreto' end",
    "numero": "cast(doc_id % 400 + 1 as int)",
    "anio": "case when doc_id % 13 = 0 then null else cast(1990 + doc_id % 35 as int) end",
    "boletin": "cast(doc_id % 40 as int)",
    "contenido_id": "doc_id + 100000",
    "version": "case when doc_id % 6 = 0 then 'extracto' else 'completa' end",
    "estado": "case doc_id % 7 when 0 then 'modificada' when 1 then 'derogada' when 2 then 'derogada_parcial' else 'vigente' end",
    "procesado_llm": "cast(case doc_id % 4 when 3 then -1 else doc_id % 4 end as int)",
    "titulo": "concat(case when doc_id % 3 = 0 then 'Ordenanza' else 'Decreto' end, ' N ', cast(doc_id % 400 + 1 as varchar(20)), case when doc_id % 13 = 0 then '' else concat('/', cast(1990 + doc_id % 35 as varchar(20))) end)",
    "texto": "text",
}
_PARTS = {
    "id": "p_partkey",
    "tipo": "case when p_partkey % 3 = 0 then 'ordenanza' else 'decreto' end",
    "numero": "cast(p_partkey % 50 + 1 as int)",
    "anio": "case when p_partkey % 11 = 0 then null else cast(2000 + p_partkey % 5 as int) end",
    "codigo_localidad": "cast(p_size % 4 as int)",
    "estado": "case p_partkey % 9 when 0 then 'modificada' when 1 then 'derogada' else 'vigente' end",
    "titulo": "p_name",
    "notas_vigencia": "case when p_partkey % 10 = 0 then 'modifica Ord. 3' else null end",
}
_REFS = {
    "ref_id": "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber",
    "norma_origen_id": "l_orderkey % 500 + 1",
    "norma_destino_id": "case when l_linenumber % 2 = 0 then l_partkey else null end",
    "destino_tipo": "case when l_partkey % 3 = 0 then 'ordenanza' else 'decreto' end",
    "destino_numero": "cast(l_partkey % 50 + 1 as int)",
    "destino_anio": "case when l_partkey % 7 = 0 then null else cast(2000 + l_partkey % 5 as int) end",
    "codigo_localidad": "cast(l_orderkey % 4 as int)",
    "destino_referencia": "case when l_partkey % 5 = 0 then 'externa' else null end",
    "relacion": "case l_linenumber when 1 then 'modifica' when 2 then 'modifica_parcial' when 3 then 'deroga_parcial' when 4 then 'deroga_total' when 5 then 'cita' when 6 then 'reglamenta' else 'sustituye' end",
    "etiqueta": "concat('Ord. ', cast(l_orderkey % 500 + 1 as varchar(20)))",
    "articulos_afectados": "concat('Arts. ', cast(l_partkey % 5 + 1 as varchar(20)), ' y ', cast(l_linenumber as varchar(20)), ' bis')",
}


def _spark(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(x.replace("varchar(20)", "string")).alias(k) for k, x in columns.items()])


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{x} AS {k}" for k, x in columns.items()) + f" FROM {source}"


def normas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(table(spark, sf_dir, "documents"), _DOCS)


def part_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(table(spark, sf_dir, "part"), _PARTS)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").distinct(), _REFS)


NORMAS = "normas AS (" + _sql(_DOCS, "documents") + ")"
PARTS = "normas AS (" + _sql(_PARTS, "part") + ")"
REFS = "refs AS (" + _sql(_REFS, "(SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem)") + ")"


def articulos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as ordered children: norma_id, id, numero, orden, texto."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("norma_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") + 1).cast("string").alias("numero"), F.col("turn").cast("int").alias("orden"), F.col("text").alias("texto"))


ARTICULOS = "articulos AS (SELECT conv_id AS norma_id, conv_id * 1000 + turn AS id, (turn + 1)::VARCHAR AS numero, turn::INT AS orden, text AS texto FROM conversations)"


def categorias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as parents and nations as their children: id, parent_id, slug, nombre."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lower("r_name").alias("slug"), F.col("r_name").alias("nombre"))
    return top.unionByName(n.select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("nombre")))


def asignadas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as assignments of documents to nations: norma_id, categoria_id, slug, relevancia."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.select(F.col("c_custkey").alias("norma_id"), F.col("c_nationkey").cast("long").alias("categoria_id"), F.expr("cast(c_custkey % 10 as double) / 10").alias("relevancia"))
    return rows.filter("categoria_id % 6 <> 5").join(n.select(F.col("n_nationkey").cast("long").alias("categoria_id"), F.lower("n_name").alias("slug")), "categoria_id")


CATEGORIAS = "categorias AS (SELECT (r_regionkey + 1000)::BIGINT AS id, NULL::BIGINT AS parent_id, lower(r_name) AS slug, r_name AS nombre FROM region UNION ALL SELECT n_nationkey::BIGINT, (n_regionkey + 1000)::BIGINT, lower(n_name), n_name FROM nation)"
ASIGNADAS = "asignadas AS (SELECT c_custkey AS norma_id, c_nationkey::BIGINT AS categoria_id, (c_custkey % 10)::DOUBLE / 10 AS relevancia, lower(n_name) AS slug FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey % 6 <> 5)"
