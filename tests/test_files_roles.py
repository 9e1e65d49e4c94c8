"""Header sniffing, dataset dispatch and applied roles."""

import pytest

from affinis.operators import ingest
from affinis.sources import files
from conftest import rows


@pytest.mark.parametrize("first,header", [
    ("reviewerID,asin,overall,unixReviewTime", True), ("user_id,item_id,rating,timestamp", True),
    ("who,what,stars", True), ("A2SUAM1J3GNN3B,0439893577,5.0,1367193600", False), ("1,2,3,4", False),
])
def test_header_by_names_not_ids(spark, tmp_dir, first, header):
    path = f"{tmp_dir}/f.csv"
    with open(path, "w") as f:
        f.write(first + "\nB1,B2,4.0,1367193600\n")
    assert files.has_header(spark, path) is header


def test_headerless_alphanumeric_ids_are_data(spark, tmp_dir):
    with open(f"{tmp_dir}/reviews.csv", "w") as f:
        f.write("A2SUAM1J3GNN3B,0439893577,5.0,1367193600\nA3,B9,4.0,1367193601\n")
    with open(f"{tmp_dir}/aaa.csv", "w") as f:
        f.write("x,y,1.0,5\n")
    got = files.load_dataset(spark, "ecommerce", "amazon", _nested(spark, tmp_dir))
    assert rows(got, "user_id", "item_id", "rating") == [("A2SUAM1J3GNN3B", "0439893577", 5.0), ("A3", "B9", 4.0)]
    with pytest.raises(ValueError):
        files.load_dataset(spark, "no", "such", tmp_dir)


def _nested(spark, tmp_dir):
    """Copies of the CSV files at root/ecommerce/amazon."""
    import os
    root = f"{tmp_dir}/root/ecommerce/amazon"
    os.makedirs(root)
    for name in ("reviews.csv", "aaa.csv"):
        with open(f"{tmp_dir}/{name}") as f, open(f"{root}/{name}", "w") as g:
            g.write(f.read())
    return f"{tmp_dir}/root"


def test_missing_folder_and_roles(spark, tmp_dir):
    assert files.list_files(spark, f"{tmp_dir}/none", "*.csv") == []
    df = spark.createDataFrame([("x", "y", 1.0)], "customer string, product string, score double")
    assert ingest.apply_roles(df, ingest.map_columns(df)).columns == ["user_id", "item_id", "rating"]
