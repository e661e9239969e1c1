import __spark_entry__
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq


def test_no_minor_variant_equals_sql(spark, tmp_path):
    """Groups that agree have no minor variants: no errors are known, among no cells."""
    rows = pa.array([np.full(64, -0.2, np.float32)] * 30, pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(30), "embedding": rows, "label": pa.array(np.arange(30) % 2, pa.int32())}), tmp_path / "embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
        want = con.execute(__spark_entry__.oracle_sql()["minor_variant_error"]).fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()["minor_variant_error"](spark, str(tmp_path)).collect()] == want
