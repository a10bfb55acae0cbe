"""Tables that operators share."""

from knotwork import session


def test_written_once_and_again_when_cleared(spark):
    calls = []

    def make(scratch):
        calls.append(1)
        return scratch.put(spark.range(5))

    first = session.shared_table(spark, "t", make)
    assert session.shared_table(spark, "t", make) is first and len(calls) == 1
    session._delete(spark, first._knotwork_path)
    assert session.shared_table(spark, "t", make).count() == 5 and len(calls) == 2


def test_counts_while_writing(spark):
    from pyspark.sql import functions as F

    out, n = session.Scratch(spark, "t").put_counted(spark.range(7), n=F.count(F.lit(1)), big=F.count_if(F.col("id") > 4))
    assert out.count() == 7 and n == {"n": 7, "big": 2}
    _, n = session.Scratch(spark, "t").put_counted(spark.range(0), n=F.count(F.lit(1)))
    assert n == {"n": 0}
