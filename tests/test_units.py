"""Tables that change together, upserts in buckets, rank pages and the incremental cascade, against plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import incremental as I
from lexmill.operators import paging as K
from lexmill.operators.graph import reconcile
from lexmill.sources import units as Q


def norms_of(spark, rows):
    return spark.createDataFrame(rows, "id long, codigo_localidad int, v string")


def test_unit_is_replaced_with_its_children(spark, tmp_path):
    path = str(tmp_path)
    n = norms_of(spark, [(1, 1, "a"), (2, 2, "b"), (3, 2, "c"), (4, None, "d")])
    kids = spark.createDataFrame([(10, 1, 1), (20, 2, 2), (40, 4, None)], "id long, norma_id long, codigo_localidad int")
    Q.replace_parts(spark, {"normas": n, "hijos": kids}, path)
    rows = lambda name, **k: sorted(tuple(r) for r in Q.read_parts(spark, path, name, **k).select("id").collect())
    assert rows("normas") == [(1,), (2,), (3,), (4,)] and rows("hijos", only=[2, None]) == [(20,), (40,)]
    old = Q.state(spark, path)
    Q.write_parts({"normas": norms_of(spark, [(9, 2, "z")])}, path, "codigo_localidad")  # a writer that dies before its commit
    assert Q.state(spark, path) == old and rows("normas") == [(1,), (2,), (3,), (4,)]
    Q.replace_parts(spark, {"normas": norms_of(spark, [(5, 2, "n")]), "hijos": kids.limit(0)}, path)
    assert rows("normas") == [(1,), (4,), (5,)] and rows("hijos") == [(10,), (40,)]
    now = Q.state(spark, path)["parts"]
    assert {k for k in now if now[k] != old["parts"][k]} == {"2"}  # other parts stay where they were
    with pytest.raises(ValueError):
        Q.replace_parts(spark, {"normas": norms_of(spark, [(5, 2, "n")]), "hijos": kids.filter("id = 10")}, path)
    with pytest.raises(ValueError):
        Q.replace_parts(spark, {"normas": n}, path)
    with pytest.raises(ValueError):
        Q.read_parts(spark, f"{path}/none", "normas")


def test_upsert_in_buckets(spark, tmp_path):
    rng, path, expected = random.Random(3), str(tmp_path), {}
    for batch in range(3):
        rows = [(rng.choice([None, *range(30)]), rng.choice([None, rng.randint(0, 99)]), f"{batch}-{k}") for k in range(40)]
        for k, o, v in rows:
            key = (o is not None, o or 0)
            if k not in expected or key > expected[k][0]:
                expected[k] = (key, {v})
            elif key == expected[k][0]:
                expected[k][1].add(v)
        Q.upsert_buckets(spark, spark.createDataFrame(rows, "k int, o int, v string"), path, ["k"], "o")
    got = {r.k: r.v for r in Q.read_parts(spark, path, "filas").collect()}
    assert set(got) == set(expected) and all(got[k] in expected[k][1] for k in got)


def test_rank_pages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 2000, 2001, 2002]), rng.choice([None, 1, 2])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, anio int, numero int")
    K.write_ranks(df, str(tmp_path), ranges=10)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, -(r[2] or 0), r[0]))
    for cursor, limit in ((0, 7), (143, 20), (290, 20), (299, 1), (0, 300)):
        page = K.rank_page(spark, str(tmp_path), df.schema, cursor, limit)
        got = sorted(page.rows.collect(), key=lambda r: r.puesto)
        assert [(r.id, r.puesto) for r in got] == [(r[0], k + 1) for k, r in enumerate(order)][cursor : cursor + limit]
        assert page.total == 300 and page.next_cursor == (cursor + limit if cursor + limit < 300 else None)
        assert limit > 20 or len(page.ranges) <= 3  # rows read are those of the page's ranges
    assert K.rank_page(spark, str(tmp_path), df.schema, 900, 5).rows.count() == 0
    K.write_ranks(df.limit(0), f"{tmp_path}/none", ranges=3)
    assert K.rank_page(spark, f"{tmp_path}/none", df.schema).total == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_give_one_runs_result(spark, tmp_path, seed):
    rng = random.Random(seed)
    norms = [(i, rng.choice(["ordenanza", "decreto"]), rng.choice([None, 1, 2, 3]), rng.choice([2000, 2001]), rng.choice([1, 2]), rng.choice(["vigente", "modificada", "derogada_parcial"]), rng.choice([None, "modifica L2"])) for i in range(30)]
    relations = ["modifica", "sustituye", "deroga_parcial", "deroga_total", "cita"]
    refs = [(k, rng.randrange(30), rng.choice([None, None, rng.randrange(30)]), rng.choice(["ordenanza", "decreto"]), rng.choice([None, 1, 2, 3]), rng.choice([2000, 2001]), rng.choice([1, 2]), rng.choice(relations), f"L{rng.randrange(5)}", rng.choice([None, "arts. 1 y 2", "3 bis"])) for k in range(120)]
    n = spark.createDataFrame(norms, "id long, tipo string, numero int, anio int, codigo_localidad int, estado string, notas_vigencia string")
    r = spark.createDataFrame(refs, "ref_id long, norma_origen_id long, norma_destino_id long, destino_tipo string, destino_numero int, destino_anio int, codigo_localidad int, relacion string, etiqueta string, articulos_afectados string").withColumn("destino_referencia", F.lit(None).cast("string"))
    whole, path = reconcile(n, r), str(tmp_path)
    I.add_references(r.filter(F.col("ref_id") % 2 == seed % 2), path)
    I.add_norms(n.filter("id >= 15"), path)
    I.add_references(r.filter(F.col("ref_id") % 2 != seed % 2), path)
    I.add_references(r.limit(0), path)
    I.add_norms(n.filter("id < 15"), path)
    got = I.reconciled(spark, path)
    key = lambda df, *c: sorted(tuple(map(str, x)) for x in df.select(*c).collect())
    assert key(got["normas"], "id", "estado") == key(whole["normas"], "id", "estado")
    assert key(got["notas"], "id", "notas") == key(whole["notas"], "id", "notas")
    assert key(got["articulos"], "norma_id", "articulo", "estado", "modificado_por") == key(whole["articulos"], "norma_id", "articulo", "estado", "modificado_por")
