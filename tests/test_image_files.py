"""Image files of a folder: names and sizes without contents, first bytes where name and size pass."""

import pytest

from assaybook.sources import image_files
from assaybook.sources.image_files import BEGINNINGS, file_manifest, list_files

HEADS = {"jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff\xe0", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF89a", "webp": b"RIFF1234WEBP"}


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "inner").mkdir()
    for ending, head in HEADS.items():
        (tmp_path / f"good.{ending}").write_bytes(head + b"...")
        (tmp_path / "inner" / f"UP.{ending.upper()}").write_bytes(head)
        (tmp_path / f"bad.{ending}").write_bytes(b"<html>")
        (tmp_path / f"short.{ending}").write_bytes(head[:2])
        (tmp_path / f"large.{ending}").write_bytes(head + b"x" * 5000)
    (tmp_path / "other.gif").write_bytes(b"GIF87a")
    (tmp_path / "riff.webp").write_bytes(b"RIFF1234WAVE")
    (tmp_path / "page.html").write_bytes(HEADS["png"])
    (tmp_path / "noending").write_bytes(HEADS["png"])
    (tmp_path / "a b%20+ü.png").write_bytes(HEADS["png"])
    return str(tmp_path)


def test_manifest(spark, folder):
    got = {r.stored_name: r.reject_reason for r in file_manifest(spark, folder, 1000).collect()}
    want = {"other.gif": None, "riff.webp": "wrong_content", "page.html": "not_an_image", "noending": "not_an_image", "a b%20+ü.png": None}
    for ending in BEGINNINGS:
        want |= {f"good.{ending}": None, f"UP.{ending.upper()}": None, f"large.{ending}": "too_large"}
        want |= dict.fromkeys([f"bad.{ending}", f"short.{ending}"], "wrong_content")
    assert got == want
    assert {r.reject_reason for r in file_manifest(spark, folder).filter("stored_name like 'large%'").collect()} == {None}
    assert all(r.accepted == (r.reject_reason is None) for r in file_manifest(spark, folder, 1000).collect())


def test_listing_opens_nothing(spark, folder):
    listed = list_files(spark, folder)
    plan = scans(listed)
    assert "content" not in plan.split("ReadSchema")[-1]
    sizes = {r.stored_name: r.bytes for r in listed.collect()}
    assert sizes["good.gif"] == 9
    assert "LessThanOrEqual(length,1000)" in scans(file_manifest(spark, folder, 1000))


def test_patterns():
    assert "[jJ][pP][gG]" in image_files.IMAGE_NAMES


def test_manifest_joins_nothing(spark, folder):
    plan = scans(file_manifest(spark, folder, 1000))
    assert "Join" not in plan and "Exchange" not in plan


def test_tasks_list_the_folder(spark, folder, tmp_path):
    """The driver holds no list of files: it is stored by tasks, and equals what Spark's reader lists."""
    (tmp_path / "inner" / "deep").mkdir()
    (tmp_path / "inner" / "deep" / "last.png").write_bytes(HEADS["png"])
    for hidden in (".dot.png", "_under.png", "now.png._COPYING_", "empty.png"):
        (tmp_path / hidden).write_bytes(b"" if hidden == "empty.png" else HEADS["png"])
    (tmp_path / "_a=b.png").write_bytes(HEADS["png"])
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "in.png").write_bytes(HEADS["png"])
    (tmp_path / "nowhere.png").symlink_to(tmp_path / "missing.png")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for path in (folder, f"file://{folder}/"):
        assert rows(list_files(spark, path)) == rows(image_files._named(image_files._read(spark, folder)))
        assert len(rows(list_files(spark, path))) == 32
    for df in (list_files(spark, folder), file_manifest(spark, folder, 1000)):
        assert "binaryFile" not in scans(df) and "Format: BinaryFile" not in scans(df) and "Format: Parquet" in scans(df)
    # one file or a pattern is left to Spark's reader
    assert [r.stored_name for r in list_files(spark, f"{folder}/good.gif").collect()] == ["good.gif"]
    assert list_files(spark, f"{folder}/good.*").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        list_files(spark, f"{folder}/none")


def test_missing_files_of_a_listed_folder(spark, folder):
    """The driver lists nothing; the listing meets the image rows in a join."""
    from assaybook.sources.images import missing_files

    names = ["good.gif", "gone.gif", "inner/UP.GIF", "UP.GIF", "", None, "a b%20+ü.png", "gone.gif"]
    images = spark.createDataFrame(list(enumerate(names)), "id long, stored_name string")
    lost = missing_files(images, list_files(spark, folder))
    assert sorted(r.id for r in lost.collect()) == [1, 7]
    assert "BinaryFile" not in scans(lost)


def test_an_empty_folder(spark, tmp_path):
    assert list_files(spark, str(tmp_path)).count() == 0 and file_manifest(spark, str(tmp_path), 10).count() == 0
