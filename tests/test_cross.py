"""That no rows are left out."""

from cborlake.operators import conformance


def test_cross_has_every_implementation(spark):
    vectors = spark.range(3).selectExpr("CAST(id AS string) AS id")
    many = spark.range(1_200).selectExpr("concat('impl', id) AS name", "array('dcbor') AS profiles")
    assert conformance.cross(vectors, many, "dcbor").select("id", "adapter").distinct().count() == 3 * 1_200
