"""Annotations that are landed as JSON lines and read back."""

import os

from gazette.plans import ingest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_landed_annotations_are_compressed_and_whole(spark):
    landed = ingest.raw_annotations(spark, FOLDER)
    files = landed.inputFiles()
    assert files and all(f.endswith(".json.gz") for f in files)
    assert landed.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()
