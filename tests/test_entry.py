"""Driver contract: flagship runs, every query has an oracle, names match."""

import __spark_entry__ as se


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["doc_id", "lang", "source", "n_chars"]
    assert df.count() >= 0


def test_every_reference_query_has_oracle():
    from corpusforge.plans.oracle import ORACLE
    from corpusforge.plans.queries import QUERIES
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(se.queries()) and set(ORACLE) <= set(se.oracle_sql())
    assert set(se.oracle_sql()) <= set(se.queries())


def test_reference_query_names():
    from corpusforge.plans.queries import QUERIES
    for name in QUERIES:
        assert "pipeline" not in name and not name.startswith("op")
