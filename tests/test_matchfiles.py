"""Binary match files: round trips, byte layout, damaged files, failed writes."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from terraloom.sources.matchfiles import SCHEMA, read_matches, write_matches


def matches(spark, n, files=3):
    point = lambda s: F.struct((F.col("id") + s).cast("float").alias("x"), (F.col("id") / 4).cast("float").alias("y"), F.col("id").cast("int").alias("ix"), (-F.col("id")).cast("int").alias("iy"),
        F.lit(0.5).cast("float").alias("orientation"), F.lit(2.0).cast("float").alias("scale"), F.lit(9.0).cast("float").alias("interest"), (F.col("id") % 2 == 0).alias("polarity"),
        (F.lit(4_000_000_000) + F.col("id")).alias("octave"), F.col("id").alias("level"), F.transform(F.sequence(F.lit(0), (F.col("id") % 5).cast("int")), lambda x: x.cast("float")).alias("descriptor"))
    return spark.range(n).select(F.format_string("p%s.match", F.col("id") % files).alias("file"), F.floor(F.col("id") / files).alias("k"), point(0).alias("left"), point(7).alias("right"))


def rows(df):
    return sorted((r.file, r.k, r.left.asDict(), r.right.asDict()) for r in df.collect())


def test_round_trip(spark, tmp_path):
    df = matches(spark, 20_000)
    write_matches(df, str(tmp_path / "m"))
    back = read_matches(spark, f"file://{tmp_path}/m")
    assert sorted(os.listdir(tmp_path / "m")) == ["_temporary", "p0.match", "p1.match", "p2.match"]
    assert rows(back) == rows(df)
    assert rows(read_matches(spark, str(tmp_path / "m" / "p1.match"))) == [r for r in rows(df) if r[0] == "p1.match"]
    assert [f.simpleString() for f in back.schema] == [f.simpleString() for f in spark.createDataFrame([], SCHEMA).schema]


def test_layout(spark, tmp_path):
    one = spark.sql("SELECT 'a' AS file, 0 AS k, named_struct('x', 1.5, 'y', 2.5) AS left, named_struct('x', 3.5, 'descriptor', array(8.0, null)) AS right, 1 AS other")
    write_matches(one, str(tmp_path / "m"))
    left = struct.pack("<ffiifffBIIQ", 1.5, 2.5, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    right = struct.pack("<ffiifffBIIQff", 3.5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 8.0, 0)
    assert (tmp_path / "m" / "a").read_bytes() == struct.pack("<QQ", 1, 1) + left + right


@pytest.mark.parametrize(("cut", "message"), [(3, "ends within a record"), (None, "of the left image")])
def test_damaged_files_raise(spark, tmp_path, cut, message):
    write_matches(matches(spark, 10, 1), str(tmp_path / "m"))
    path = tmp_path / "m" / "p0.match"
    data = path.read_bytes()
    path.write_bytes(data[:-cut] if cut else struct.pack("<Q", 9) + data[8:])
    with pytest.raises(Exception, match=message):
        read_matches(spark, str(path)).count()


def test_writes_that_fail_leave_nothing(spark, tmp_path):
    df = matches(spark, 30)
    path = str(tmp_path / "m")
    write_matches(df, path)
    before = rows(read_matches(spark, path))
    with pytest.raises(Exception, match="there already"):
        write_matches(df, path)
    with pytest.raises(Exception, match="needs a file name"):
        write_matches(df.withColumn("right", F.when(F.col("k") != 4, F.col("right"))), path)
    with pytest.raises(Exception, match="several tasks"):
        df.repartition(4, "k").sortWithinPartitions("file").write.format("match_files").mode("append").save(path)
    assert rows(read_matches(spark, path)) == before
    assert os.listdir(tmp_path / "m" / "_temporary") == []


def test_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "m")
    write_matches(matches(spark, 30), path)
    write_matches(matches(spark, 4, 1), path, mode="overwrite")
    assert rows(read_matches(spark, path)) == rows(matches(spark, 4, 1))
    write_matches(matches(spark, 4).limit(0), path, mode="overwrite")
    assert read_matches(spark, path).count() == 0


def test_records_over_the_ends_of_chunks_and_batches():
    import io

    import numpy as np
    import pyarrow as pa

    from terraloom.sources import matchfiles as M

    points = pa.array([{"x": float(i), "level": i, "polarity": i % 2 == 1, "descriptor": [float(j) for j in range(i % 7)] if i % 3 else None} for i in range(500)], M._POINT)
    data, starts = M._packed(points)
    assert starts[-1] == len(data) == sum(M.HEAD.size + 4 * (i % 7 if i % 3 else 0) for i in range(500))

    class Drops(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 61))

    cursor = M._Cursor(Drops(data.tobytes()), "a")
    back = pa.concat_arrays([M._points(*cursor.take(n)) for n in (1, 0, 250, 249)])
    assert back.field("level").to_pylist() == list(range(500)) and back.field("polarity").to_pylist() == [i % 2 == 1 for i in range(500)]
    assert back.field("descriptor").to_pylist() == [[float(j) for j in range(i % 7)] if i % 3 else [] for i in range(500)]
    assert np.array_equal(M._packed(back)[0], data)
    with pytest.raises(ValueError, match="ends within a record"):
        cursor.take(1)
