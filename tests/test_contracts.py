"""Contract rules from schemas and the defaults of new rows."""

import uuid

from pyspark.sql import functions as F

from parlance.operators import contracts as K
from parlance.sources.tables import DOMAIN_SCHEMAS


def test_required_columns_of_every_table_are_rules(spark):
    names = {t: {n for n, _ in K.schema_rules(s)} for t, s in DOMAIN_SCHEMAS.items()}
    assert names["messages"] == {f"{c}: not null" for c in ("id", "session_id", "role", "content", "created_at")}
    assert "sku: not null" not in names["products"] and "price: not null" in names["products"]


def test_defaults_fill_nulls_only_and_repeat_alike(spark):
    rows = [(1, None, None, None), (2, "mine", "archived", 5)]
    df = spark.createDataFrame(rows, "n long, id string, status string, other int")
    fill = lambda: K.apply_insert_defaults(df, "documents", F.lit(9), F.concat(F.lit("d/"), F.col("n").cast("string")))
    got = {r.n: (r.id, r.status, r.other) for r in fill().collect()}
    assert got == {1: (str(uuid.uuid5(uuid.NAMESPACE_DNS, "d/1")), "active", None), 2: ("mine", "archived", 5)}
    assert fill().collect() == fill().collect()
    for table in DOMAIN_SCHEMAS:
        if table != "sales_pipelines":
            assert "id" in K.insert_defaults(F.lit(0), F.lit("k"))[table]
