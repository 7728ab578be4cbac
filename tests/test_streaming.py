"""Stateless operators apply unchanged to a file stream."""

import os
import shutil
import tempfile

from tabsense.operators import filters, normalize
from tabsense.plans.queries import FILTER_STATE
from tests.conftest import SF_SMALL


def test_filters_on_stream(spark):
    batch = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    src = tempfile.mkdtemp(prefix="tabsense-stream-")
    shutil.copy(f"{SF_SMALL}/lineitem.parquet", os.path.join(src, "part-0.parquet"))
    stream = spark.readStream.schema(batch.schema).parquet(src)
    out = normalize.normalize_table(filters.filter_conjunction(stream, FILTER_STATE))
    q = out.writeStream.format("memory").queryName("tabsense_stream_test").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT count(*) AS n FROM tabsense_stream_test").first()["n"]
    finally:
        q.stop()
    assert got == filters.filter_conjunction(batch, FILTER_STATE).count()
