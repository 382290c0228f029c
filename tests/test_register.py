"""Functions by name in SQL."""

from corvane.functions.register import register


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("""SELECT slug(' Ça va_bien! '), query_terms("What is the two-factor login's état?"), freshness(DATE '2026-06-30', DATE '2026-06-30'),
        freshness(NULL, DATE '2026-06-30'), cosine(array(1D, 0D), array(2D, 0D))""").head()
    assert list(row) == ["ça-va-bien", ["two-factor", "login's", "état"], 1.0, 0.3, 1.0]
    got = spark.sql("SELECT d.id, c.ordinal, c.heading_path FROM VALUES (1, '# A\nsome words'), (2, NULL) AS d(id, t), LATERAL chunk_markdown(d.t) AS c").collect()
    assert [tuple(r) for r in got] == [(1, 0, "A")]
