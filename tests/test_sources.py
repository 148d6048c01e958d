import json

import pytest
from pyspark.sql import functions as F

from fitspark.sources import boards
from fitspark.sources.documents import read_documents
from fitspark.sources.files import docx_bytes, write_files

LONG = "work " * 100
ANSWERS = {
    "https://boards-api.greenhouse.io/v1/boards/acme/jobs/1?content=true": json.dumps({"title": "Engineer", "location": {"name": "Pune"}, "content": "&lt;p&gt;Build &amp;amp; run&lt;/p&gt;"}),
    "https://x.wd1.com/none": "",
    "https://acme.myworkdayjobs.com/wday/cxs/acme/site/job/a/b_1": json.dumps({"jobPostingInfo": {"title": "Analyst", "location": "Oslo", "jobDescription": "<p>Count</p>"}}),
    "https://boards.greenhouse.io/acme/jobs/2": f'<script type="application/ld+json">{{"@type": "JobPosting", "description": "<p>{LONG}</p>"}}</script>',
    "https://page.example/job": f'<html><script type="application/ld+json">{{"description": "{LONG}"}}</script></html>',
    "https://page.example/short": '<script type="application/ld+json">{"description": "short"}</script>',
    "https://docs.google.com/document/d/abc/export?format=txt": "The role\nDo it",
    "https://docs.google.com/document/d/private/export?format=txt": "<!doctype html><html><body>Sign in</body></html>",
}
JOBS = [
    ("g1", "https://boards.greenhouse.io/acme/jobs/1"),
    ("g2", "https://boards.greenhouse.io/acme/jobs/2"),
    ("g3", "https://boards.greenhouse.io/acme/jobs/3"),
    ("w1", "https://acme.myworkdayjobs.com/en/site/job/a/b_1"),
    ("p1", "https://page.example/job"),
    ("p2", "https://page.example/short"),
    ("p3", "https://page.example/gone"),
    ("d1", "https://docs.google.com/document/d/abc/edit"),
    ("d2", "https://docs.google.com/document/d/private/edit"),
    (None, None),
]


def test_a_manifest_is_fetched_without_a_network(spark, tmp_path):
    manifest = spark.createDataFrame(JOBS, "slug string, url string")
    got = boards.fetch(manifest, transport=boards.StoredTransport(ANSWERS), size=2)
    assert got.rdd.getNumPartitions() == 5
    rows = {r.slug: r for r in boards.markdown(boards.texts(got), role=F.lit("Role"), org=F.lit("Org")).collect()}
    assert rows.keys() == {s for s, _ in JOBS if s}
    assert rows["g1"].text == "# Engineer\n_Location: Pune_\n\nBuild & run" and rows["g1"].method == "board"
    assert rows["g1"].markdown.startswith("# Role — Org\nSource: https://boards.greenhouse.io/acme/jobs/1\n\n# Engineer")
    assert rows["g2"].text == LONG.strip() and rows["g2"].method == "page"
    assert rows["w1"].text.startswith("# Analyst\n_Location: Oslo_") and rows["w1"].text.endswith("Count")
    assert rows["p1"].text == LONG.strip() and rows["d1"].text == "The role\nDo it"
    assert {s: r.error is None for s, r in rows.items()} == {"g1": True, "g2": True, "g3": False, "w1": True, "p1": True, "p2": False, "p3": False, "d1": True, "d2": False}
    assert "nothing is stored" in rows["g3"].error and rows["p2"].error == "no posting found" and "not shared" in rows["d2"].error
    assert rows["d2"].text is None and rows["d2"].markdown is None


def test_filters_choose_before_anything_is_fetched(spark, tmp_path):
    log = str(tmp_path / "asked")

    class Counting(boards.StoredTransport):
        """Notes each address that is asked for."""

        def get(self, address):
            with open(log, "a") as f:
                f.write(address + "\n")
            return self.answers[address]

    manifest = spark.createDataFrame(JOBS, "slug string, url string")
    got = boards.fetch(manifest, transport=Counting(ANSWERS))
    assert [r.slug for r in got.where("board = 'greenhouse' and slug in ('g1', 'w1') and length(body) > 5").collect()] == ["g1"]
    assert open(log).read().splitlines() == ["https://boards-api.greenhouse.io/v1/boards/acme/jobs/1?content=true"]
    assert got.where("slug = 'none'").count() == 0


def test_errors_are_tried_again_and_stay_with_their_job(spark, tmp_path, monkeypatch):
    class Flaky:
        def __init__(self, path):
            self.path = path

        def get(self, address):
            with open(self.path, "a+") as f:
                f.write("x")
                f.seek(0)
                if len(f.read()) < 3:
                    raise TimeoutError("slow")
            return "text"

    manifest = spark.createDataFrame([("d", "https://docs.google.com/document/d/abc/edit")], "slug string, url string")
    row = boards.texts(boards.fetch(manifest, transport=Flaky(str(tmp_path / "n")), pause=0.01)).first()
    assert (row.text, row.error) == ("text", None)
    monkeypatch.setattr(boards, "MANIFEST_JOBS", 1)
    with pytest.raises(ValueError, match="more than 1 jobs"):
        boards.fetch(spark.createDataFrame(JOBS, "slug string, url string"))


def test_files_are_read_back_as_they_were_written(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a", "docx", "Line <1> & é\nlast \U0001f600"), ("a", "txt", "Zeile ü\nzwei"), ("b c", "docx", None), ("c", "txt", "")]
    df = spark.createDataFrame(rows, "name string, kind string, text string").repartition(3)
    write_files(df, path)
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.text for r in read_documents(spark, path).collect()}
    got.setdefault("c.txt", "")  # the reader leaves out empty files
    assert got == {"a.docx": rows[0][2], "a.txt": rows[1][2], "b c.docx": "", "c.txt": ""}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.docx", "a.txt", "b c.docx", "c.txt"]
    assert docx_bytes("x\x00y") == docx_bytes("x\x00y")


@pytest.mark.parametrize("bad", [("a", "pdf", "x"), ("../a", "txt", "x"), (None, "txt", "x"), ("ok", "txt", "again"), ("there", "txt", "x")])
def test_a_write_that_fails_leaves_the_folder_as_it_was(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    schema = "name string, kind string, text string"
    write_files(spark.createDataFrame([("there", "txt", "first")], schema), path)
    with pytest.raises(Exception):
        write_files(spark.createDataFrame([("ok", "txt", "x"), bad], schema).repartition(2), path)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["there.txt"] and (tmp_path / "out" / "there.txt").read_text() == "first"
    write_files(spark.createDataFrame([("new", "txt", "x")], schema), path, overwrite=True)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["new.txt"]
