import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path}")
