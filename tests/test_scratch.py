import os

from thicket import scratch


def test_stored_dropped_cleared(spark):
    a, b = scratch.stored(spark.range(5)), scratch.stored(spark.range(3))
    assert a.count() == 5 and os.path.isdir(a._thicket_path)
    scratch.drop(a)
    assert not os.path.exists(a._thicket_path)
    assert scratch.folder(spark) in b._thicket_path
    scratch.clear(spark)
    assert not os.path.exists(b._thicket_path)
    df = spark.createDataFrame([(1, 2)], "A int, `b.c` int")
    assert scratch.without(df, "a").columns == ["b.c"]
