import pytest
from pyspark.sql import functions as F

from corpusloom import sql_functions
from corpusloom.functions import chunks as C
from corpusloom.operators.ingest import semantic_chunks


def test_sql_chunkers_equal_the_column_functions(spark):
    sql_functions.register(spark)
    texts = ["intro\n# A\na\n## B\nb\n### C\nc\n# D\n" + "d" * 60, "plain " * 30, "kurz", "  \xa0 x "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    docs.createOrReplaceTempView("docs")
    for name, make in (("chunk_headers", C.chunk_by_headers), ("chunk_windows", C.chunk_fixed)):
        got = spark.sql(f"SELECT d.id, c.chunk_index, c.content FROM docs d, LATERAL {name}(d.text, 40, 5) c")
        want = docs.select("id", F.posexplode(make(F.col("text"), 40, 5)).alias("chunk_index", "content"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_semantic_chunks_in_sql_equal_the_column_function(spark):
    sql_functions.register(spark)
    words = lambda n, end="": " ".join(f"w{i}" for i in range(n)) + end
    texts = [
        "kurz", "", "  ", None, words(700), words(90, ". ") * 9, words(120) + "\n \n" + words(90) + "\n\n" + words(300),
        "intro\n# One\n" + words(100) + "\n# Two\n" + words(150) + "\n## Three\n" + words(5),
        "a\nSOME HEADING HERE\n" + words(80) + "\nOTHER HEADING HERE\n" + words(900), "x" * 3000, "\n1. Aa\nb\n2. Bb\n" + "\xa0y" * 900,
        "Title here:\n" + words(99) + "\nNext part:\n" + words(120) + "\U0001f600 " * 300, ". " * 900, " \n" * 900, "!" * 1300 + "\n\n\u2003",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    docs.createOrReplaceTempView("docs")
    for target, overlap in ((1200, 150), (300, 0), (40, 60)):
        got = spark.sql(f"SELECT d.id, c.* FROM docs d, LATERAL chunk_semantic(d.text, {target}, {overlap}, true) c")
        want = semantic_chunks(docs, "id", "text", target, overlap).select("id", "chunk_index", "chunk_type", "content")
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.sql("SELECT * FROM chunk_semantic('a b')").columns == ["chunk_index", "content"]
    for bad in ("1", "'a', id", "'a', 0", "'a', 5, -1"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT * FROM docs, LATERAL chunk_semantic({bad})").collect()
