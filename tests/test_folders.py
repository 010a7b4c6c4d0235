"""Streams over tables that are folders of files."""

import os

from harness import canonical, spark_table

from lectern.plans import registry


def test_streams_read_folders(spark, root, folder):
    for name, order in (("conversations", ["conv_id", "turn"]), ("events", ["ts"]), ("pages", ["page_id"])):
        source = spark.read.parquet(os.path.join(root, f"{name}.parquet"))
        source.repartitionByRange(3, *order).write.parquet(os.path.join(folder, f"{name}.parquet"))
    for name in ("stream_session_state", "stream_dedup_merge", "stream_article_merge"):
        query = registry.queries()[name]
        assert spark_table(query(spark, folder)) == spark_table(query(spark, root)), canonical(name)
