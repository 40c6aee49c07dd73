import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return s


def compare(spark, name, query, sql, sf_dir=SF):
    """Rows of a query and of its SQL, columns by name, floats to nine digits."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(near(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = sorted((tuple(near(r[names.index(c)]) for c in sorted(names)) for r in res.fetchall()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want, name
