"""Row-local derivations and a fitted encoder applied to a file stream."""

import tempfile

from pyspark.sql import functions as F

from fitframe.functions import date_parts
from fitframe.operators.encode import LabelEncoder
from fitframe.streaming import read_stream, score_stream, write_stream
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    path = f"{SF_SMALL}/orders*.parquet"
    batch = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    enc = LabelEncoder(["o_orderpriority"], ["prio_code"]).fit(batch)

    def derive(df):
        p = date_parts("o_orderdate")
        return df.select("o_orderkey", "o_orderpriority", p["year"].alias("year"), p["weekday"].alias("wd"))

    stream = read_stream(spark, path, batch.schema)
    scored = score_stream(stream, derive, enc.transform)
    out = tempfile.mkdtemp(prefix="ff-stream-out-")
    q = write_stream(scored, out + "/t", out + "/ck")
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/t")
    want = enc.transform(derive(batch))
    cols = ["o_orderkey", "year", "wd", "prio_code"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.count() == batch.count()
    assert got.where(F.col("prio_code").isNull()).count() == 0
