"""Releases: a changed byte, a changed row and rows that may not be published are found."""

import pytest
from pyspark.sql import functions as F

from weft.sources import release


def totals(raw):
    return raw["cases"].groupBy("kind").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def names(raw):
    return raw["cases"].select("kind", F.lower("kind").alias("low"))


AGGREGATES = {"totals": totals, "names": names}


def cases(spark, rows=None):
    return spark.createDataFrame(rows or [(1, "A", 3), (2, "A", 4), (3, "B", 5), (4, None, 6), (5, "A", None)], "id long, kind string, points long")


def published(spark, tmp_path):
    path = str(tmp_path / "release")
    release.publish(spark, path, {"cases": cases(spark)}, AGGREGATES)
    return path


def test_untouched_release_holds(spark, tmp_path):
    path = published(spark, tmp_path)
    release.verify(spark, path, ["cases"], AGGREGATES)
    assert release.changed_files(spark, path).isEmpty() and release.differences(spark, path, ["cases"], AGGREGATES).isEmpty()
    with pytest.raises(FileExistsError):
        release.publish(spark, path, {"cases": cases(spark)}, AGGREGATES)


def test_changed_byte_is_found(spark, tmp_path):
    path = published(spark, tmp_path)
    file = sorted((tmp_path / "release" / "raw" / "cases").glob("part-*"))[0]
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(bytes(data))
    (file.parent / f".{file.name}.crc").unlink()  # the file system's own checksum would refuse the file first
    assert [tuple(r) for r in release.changed_files(spark, path).collect()] == [(f"raw/cases/{file.name}", "changed")]
    with pytest.raises(ValueError, match="files differ"):
        release.verify(spark, path, ["cases"], AGGREGATES)


def test_lost_and_added_files_are_found(spark, tmp_path):
    path = published(spark, tmp_path)
    folder = tmp_path / "release" / "aggregates" / "totals"
    file = sorted(folder.glob("part-*"))[0]
    file.rename(folder / "other.parquet")
    got = sorted(map(tuple, release.changed_files(spark, path).collect()))
    assert got == sorted([(f"aggregates/totals/{file.name}", "missing"), ("aggregates/totals/other.parquet", "unknown")])


def test_changed_row_is_found_though_the_manifest_fits(spark, tmp_path):
    path = published(spark, tmp_path)
    changed = cases(spark, [(1, "A", 3), (2, "A", 9), (3, "B", 5), (4, None, 6), (5, "A", None)])
    changed.write.mode("overwrite").parquet(f"{path}/raw/cases")
    release.seal(spark, path)
    assert release.changed_files(spark, path).isEmpty()
    got = sorted(map(tuple, release.differences(spark, path, ["cases"], AGGREGATES).collect()))
    assert got == [("totals", "published", '{"kind":"A","n":3,"points":7}', 1), ("totals", "recomputed", '{"kind":"A","n":3,"points":12}', 1)]
    with pytest.raises(ValueError, match="aggregates differ"):
        release.verify(spark, path, ["cases"], AGGREGATES)


def test_repeats_are_counted(spark, tmp_path):
    path = published(spark, tmp_path)
    cases(spark, [(1, "A", 3), (3, "B", 5), (4, None, 6), (5, "A", 4)]).write.mode("overwrite").parquet(f"{path}/raw/cases")
    got = sorted(map(tuple, release.differences(spark, path, ["cases"], {"names": names}).collect()))
    assert got == [("names", "published", '{"kind":"A","low":"a"}', 1)]


@pytest.mark.parametrize("bad", ["token = abcdefghijkl1234", "at 192.168.1.7", "see /root/x", "https://elsewhere.example/a"])
def test_private_rows_are_refused(spark, tmp_path, bad):
    path = str(tmp_path / "release")
    with pytest.raises(ValueError, match="may not be published"):
        release.publish(spark, path, {"cases": cases(spark, [(1, bad, 1), (2, "https://docs.example/b", 1)])}, AGGREGATES, ["docs.example"])
    assert not (tmp_path / "release").exists()


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "release")
    release.publish(spark, path, {"cases": cases(spark).filter("false")}, AGGREGATES)
    release.verify(spark, path, ["cases"], AGGREGATES)
