"""Every registered query of these operators: against its SQL where it has any, and over whole tables."""

import compare
import pytest

from assaybook.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLE:
        rows, diff = compare.check(spark, compare.duck(sf), name, QUERIES[name], ORACLE[name], sf)
        assert not diff and rows > 0
    else:
        df = QUERIES[name](spark, sf)
        assert df.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
