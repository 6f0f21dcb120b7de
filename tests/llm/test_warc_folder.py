"""Archives lie where Spark resolves their folder, with and without a scheme."""

from pathlib import Path

from barloom.llm import warc


def test_folder_is_resolved_by_spark(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "one"), (2, "http://b/", "two")], "page_id long, url string, html string")
    assert warc._qualified(spark, "/x").startswith("file:/") and warc._qualified(spark, "/x").endswith("/x")
    for name, path in (("plain", str(tmp_path / "plain")), ("uri", f"file:{tmp_path}/uri"), ("gap", str(tmp_path / "a b%20c"))):
        manifest = warc.write_warc(pages, path)
        assert list(Path(path.removeprefix("file:")).glob("*.warc.gz")), name
        assert sorted(r.page_id for r in warc.read_warc(manifest, path).collect()) == [1, 2]
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://shared/")
    try:
        conf.set("fs.viewfs.mounttable.shared.link./work", f"file:{tmp_path}")
        assert warc._qualified(spark, "/work/x") == "viewfs://shared/work/x"
    finally:
        conf.set("fs.defaultFS", before)
