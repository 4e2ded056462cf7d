"""File sources and sinks by round trips."""

import hashlib

from clauselake.sources import files


def test_csv_and_pages(spark, tmp_path):
    (tmp_path / "labels.csv").write_bytes(b'file,url,label,notes,source\r\na.html,https://Shop.example/pay?x=1,legit,"says ""hi"", twice",\r\n,,,,\r\nb.html,http://x.test,phishing,"two\r\nlines",demo\r\n')
    rows = {r.file: r for r in files.labelled_pages(spark, str(tmp_path / "labels.csv")).collect()}
    assert set(rows) == {"a.html", "b.html"}
    a = rows["a.html"]
    assert (a.hostname, a.protocol, a.path, a.source, a.notes) == ("shop.example", "https:", "/pay", "synthetic", 'says "hi", twice')
    assert rows["b.html"].notes.replace("\r\n", "\n") == "two\nlines"
    kept = files.without_demo(files.labelled_pages(spark, str(tmp_path / "labels.csv")))
    assert [r.file for r in kept.collect()] == ["a.html"]


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([("ü\n", 1, None), (None, 0, "k")], "text string, label int, kind string")
    files.write_json_lines(rows, str(tmp_path / "x"))
    back = files.json_lines(spark, str(tmp_path / "x"), "text string, label int, kind string")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert files.usable_texts(back).count() == 2 and files.usable_texts(back, 10).where("kind is null").count() == 1


def test_credentials(spark, tmp_path):
    (tmp_path / "auth").write_text("# comment\nann: $2b$10:x/y \n\n:nobody\nbob\nann:second\n eve :z\n")
    assert {r.user: r.hash for r in files.credentials(spark, str(tmp_path / "auth")).collect()} == {"ann": "second", "eve": "z"}
    users = spark.createDataFrame([("a", "b:c")], "user string, hash string")
    files.write_credentials(users, str(tmp_path / "out"))
    assert files.credentials(spark, str(tmp_path / "out")).collect() == users.collect()


def test_manifest_and_whole_files(spark, tmp_path):
    for name, content in (("m1/lib.js", b"shared"), ("m2/lib.js", b"shared"), ("m2/w.bin", b"\0" * 9)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = files.manifest(spark, str(tmp_path))
    assert {(r.bundle, r.file, r.bytes, r.shared) for r in found.collect()} == {("m1", "lib.js", 6, False), ("m2", "lib.js", 6, True), ("m2", "w.bin", 9, False)}
    assert {r.sha256 for r in found.where("bytes = 9").collect()} == {hashlib.sha256(b"\0" * 9).hexdigest()}
    assert {r.bundle: r.bytes for r in files.bundle_sizes(found).collect()} == {"m1": 6, "m2": 15}
    (tmp_path / "m1" / "page.html").write_text("<p>\nhi")
    assert {r.file: r.html for r in files.whole_files(spark, str(tmp_path / "m1" / "page.html")).collect()} == {"page.html": "<p>\nhi"}


def test_markdown(spark):
    arms = spark.createDataFrame([("rules", 6, 0, 8, 0, 1.0, 1.0, 1.0, 0.0)], "arm string, tp long, fp long, tn long, fn long, precision double, recall double, f1 double, fpr double")
    assert files.markdown(arms).split("\n")[2] == "| rules | 6 | 0 | 8 | 0 | 100.0% | 100.0% | 100.0% | 0.0% |"
