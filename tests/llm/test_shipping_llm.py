"""Public functions of the subpackage ship the package to workers that don't have it."""

from shipping import run_alone


def test_functions_alone():
    run_alone(
        {
            "components": """
                from lexmill.llm.components import components
                assert components(spark.createDataFrame([(1, 2)], "a long, b long")).count() == 2
            """,
            "train_quality": """
                from lexmill.llm.quality import train_quality
                docs = spark.createDataFrame([(k, "good text" if k % 2 else "bad words") for k in range(40)], "doc_id long, text string")
                assert not isinstance(train_quality(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")), float)
            """,
            "jump_columns": """
                from lexmill.llm.sharding import jump_columns
                assert spark.range(3).select(jump_columns(F.col("id"), 4).alias("p")).count() == 3 and spark.range(3).select(jump_columns(F.col("id"), 4).alias("p")).collect()
            """,
            "candidates": """
                from lexmill.llm.near_dedup import near_duplicates
                assert near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).filter("component = 1").count() == 2
            """,
            "runs": """
                from lexmill.llm.periodic_runs import find_runs
                assert find_runs(spark.createDataFrame([("a " * 9,)], "text string")).first().periodic.runs[0].length == 9
            """,
            "licences": """
                from lexmill.llm.license_scan import scan_licenses
                assert len(scan_licenses(spark.createDataFrame([("MIT License",)], "text string")).first().licenses.matches) == 1
            """,
            "vectors": """
                from lexmill.llm.vector_codes import compress_vectors
                assert compress_vectors(spark.createDataFrame([(1, [1.0] * 8)], "vec_id long, embedding array<float>"))[0].count() == 1
            """,
        }
    )
