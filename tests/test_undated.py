"""References whose record has no instant of arrival."""


def test_references_without_an_instant(spark):
    from memloom.operators import references as ref

    refs = spark.createDataFrame([("f", "t", r, k, None) for r, k in (("r1", "gone"), ("r2", "nowhere"), ("r3", "there"))], "ref_field string, target string, record_id string, key string, at long")
    tgts = spark.createDataFrame([("t", "gone", 5, True, None), ("t", "there", 5, False, None)], "target string, key string, seen long, gone boolean, purged long")
    out = {(r.record_id, r.ref_key, r.at, r.reason) for r in ref.orphans([refs], [tgts]).collect()}
    assert out == {("r1", "gone", None, "removed"), ("r2", "nowhere", None, "absent")}
