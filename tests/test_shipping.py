"""Public functions ship the package to workers that don't have it."""

from shipping import run_alone


def test_functions_alone():
    run_alone(
        {
            "repair_json": """
                from lexmill.functions.extraction import repair_json
                assert repair_json(spark.createDataFrame([('{"a": 1',)], "t string"), "t", "j").first().j == '{"a":1}'
            """,
            "article_contexts": """
                from lexmill.operators.splits import article_contexts
                assert article_contexts(spark.createDataFrame([(1, "art. 3")], "id long, texto string")).first().numero == "3"
            """,
            "elements": """
                from lexmill.sources.html_rows import page_rows
                assert page_rows(spark.createDataFrame([(1, "<p>a")], "page_id long, html string")).count() == 1
            """,
            "main_text": """
                from lexmill.sources.html_rows import main_text
                assert main_text(spark.createDataFrame([(1, "<p>a")], "page_id long, html string")).first().texto == "a"
            """,
            "all_neighbours": """
                from lexmill.operators.neighbours import all_neighbours
                assert all_neighbours(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "id long, vector array<float>")).count() == 2
            """,
            "top_k": """
                from lexmill.operators.vectors import decode_vectors, test_encoder, embed, top_k
                v = embed(spark.createDataFrame([(1, "a"), (2, "b")], "id long, texto string"), None, test_encoder(4))
                assert top_k(v.withColumnRenamed("id", "query_id"), v, 1, -1.0).count() == 2
                assert decode_vectors(spark.createDataFrame([(bytearray(8),)], "b binary"), "b", 2).first().b == [0.0, 0.0]
            """,
            "index": """
                from lexmill.operators import search as R
                path = tempfile.mkdtemp(prefix="spark-")
                R.write_index(spark.createDataFrame([(1, "casa roja")], "id long, texto string"), {"texto": 1.0}, path)
                q = spark.createDataFrame([(1, "casa roja")], "query_id long, query string")
                assert R.phrase_hits(R.read_index(spark, path)[0], R.read_terms(spark, path), q).count() == 1
            """,
        }
    )


def test_positions_alone():
    run_alone(
        {
            "phrases": """
                from lexmill.operators import search as R
                rows = spark.createDataFrame([("casa", 1, [[0]])], "term string, id long, positions array<array<int>>")
                q = spark.createDataFrame([(1, "casa")], "query_id long, query string")
                known = spark.createDataFrame([("casa", 1)], "term string, df long")
                assert R.phrase_hits(rows, known, q).first().lugares == [0]
                assert R.cover_rank(rows, R.query_terms(q), [1.0]).count() == 1
            """,
        }
    )
