from __future__ import annotations

import os
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfolio.plans.samples import docx_bytes, zip_bytes
from tallyfolio.sources.archives import expand_archives
from tallyfolio.sources.decode_helper import DecodeLimits, Helper
from tallyfolio.sources.decoders import decode_docx, decode_text
from tallyfolio.sources import archives, files
from tallyfolio.sources.files import list_folders, read_folder, read_listed
from tallyfolio.sources.intake import read_documents, read_uploads

LONG_NAME = "l" * 97 + ".txt"
DOCX = docx_bytes("First <b>line</b> & more\nSecond line")
FILES = {
    "a.TXT": b"Hello <b>big</b> world!", "bad.txt": b"\xff\xfeoops", "empty.txt": b"", "_u.txt": b"under", ".h.txt": b"dot",
    "b c.txt": b"blank name", "é.txt": "naïve".encode(), "d.docx": DOCX, "e.xyz": b"what", "noext": b"x", "f.pdf": b"%PDF",
    "g.doc": b"\xd0\xcf", "broken.docx": b"PK no", "broken.zip": b"no archive", LONG_NAME: b"long",
    "flat.zip": zip_bytes([("x.txt", b"in zip"), ("y.docx", DOCX)]),
    "nested.zip": zip_bytes([("sub/", b""), ("sub/d.docx", DOCX)]), "upper.zip": zip_bytes([("A.TXT", b"upper")]),
    "mixed.ZIP": zip_bytes([("m.txt", b"good"), ("n.xyz", b"bad"), ("inner.zip", zip_bytes([])), ("b c.txt", b"same")]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("uploads")
    for name, content in FILES.items():
        (path / name).write_bytes(content)
    return str(path)


@pytest.fixture(scope="module")
def documents(spark, folder):
    files = read_folder(spark, folder, list_folders(spark, [folder])).withColumn("request_id", F.lit(1))
    return {(row.archive, row.name): row for row in read_documents(files).collect()}


def test_no_file_is_lost(spark, folder):
    files = read_folder(spark, folder, list_folders(spark, [folder])).collect()
    assert sorted(row.name for row in files) == sorted(FILES)
    assert {row.name: bytes(row.content) for row in files if row.name in ("_u.txt", ".h.txt", "empty.txt")} == {
        "_u.txt": b"under", ".h.txt": b"dot", "empty.txt": b""}
    assert {row.status for row in files} == {None, "unsupported"}


def test_files_in_subfolders(spark, tmp_path):
    for place, content in (("x.txt", b"top"), ("a/x.txt", b""), ("a/b/x.txt", b"deep"), ("a/_SUCCESS", b"")):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(content)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        files = read_folder(spark, folder, list_folders(spark, [folder]))
        assert sorted((r.name, bytes(r.content)) for r in files.collect()) == [
            ("_SUCCESS", b""), ("x.txt", b""), ("x.txt", b"deep"), ("x.txt", b"top")]


def test_without_a_listing_nothing_is_missing(spark, folder):
    assert {row.name for row in read_folder(spark, folder).select("name").collect()} == set(FILES)


def test_one_name_and_time_in_two_folders_are_two_files(spark, tmp_path):
    for place in ("a/cv.txt", "b/cv.txt"):
        (tmp_path / place).parent.mkdir()
        (tmp_path / place).write_bytes(place.encode())
        os.utime(tmp_path / place, (1_700_000_000, 1_700_000_000))
    rows = read_documents(read_folder(spark, str(tmp_path)).withColumn("request_id", F.lit(1))).collect()
    assert len({row.unique_id for row in rows}) == 2 and {row.source_seq for row in rows} == {1_700_000_000_000_000}


def test_too_large_and_vanished_files_have_a_status(spark, tmp_path, monkeypatch):
    (tmp_path / "big.txt").write_bytes(b"x" * 50)
    (tmp_path / "small.txt").write_bytes(b"y")
    (tmp_path / "gone.txt").write_bytes(b"z")
    listing = list_folders(spark, [str(tmp_path)])
    (tmp_path / "gone.txt").unlink()
    monkeypatch.setattr(files, "MAX_LENGTH", 10)
    got = {row.name: (row.content and bytes(row.content), row.status) for row in read_listed(listing).collect()}
    assert got == {"big.txt": (None, "too_large"), "small.txt": (b"y", None), "gone.txt": (None, "vanished")}


def test_what_is_no_readable_file_costs_one_row_only(spark, tmp_path):
    """A folder where a file should be, a pipe, links in a circle and to nowhere: a row with a status each."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "good.txt").write_bytes(b"good")
    (tmp_path / "linked.txt").symlink_to(tmp_path / "a" / "good.txt")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    (tmp_path / "nowhere.txt").symlink_to(tmp_path / "none")
    os.mkfifo(tmp_path / "pipe.txt")
    listing = list_folders(spark, [str(tmp_path), str(tmp_path / "a" / "good.txt"), str(tmp_path / "none")])
    got = sorted((r.path, r.content and bytes(r.content), r.status) for r in read_listed(listing).collect())
    assert got == [("", None, "unreadable"), ("a/good.txt", b"good", None), ("a/up", None, "unreadable"), ("linked.txt", b"good", None),
                   ("nowhere.txt", None, "unreadable"), ("pipe.txt", None, "unreadable")]
    foreign = spark.createDataFrame([(str(tmp_path), path, path.split("/")[-1], 1, 1) for path in ("a", "a/good.txt", "pipe.txt", "a/gone.txt")],
                                    "folder string, path string, name string, length long, source_seq long")
    named = foreign.withColumn("name", F.concat("name", F.lit(".txt")))
    assert {r.path: r.status for r in read_listed(named).collect()} == {"a": "unreadable", "a/good.txt": None, "pipe.txt": "unreadable", "a/gone.txt": "vanished"}


def test_files_that_refuse_to_be_read_have_a_status(tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_bytes(b"x")

    class Refusing:
        def get_file_info(self, path):
            raise PermissionError(path)
    monkeypatch.setattr(files, "file_system", lambda folder: (Refusing(), str(tmp_path)))
    Refusing.open_input_file = Refusing.get_file_info
    assert files._content("any", "a.txt") == (None, "unreadable")
    refused = pd.concat(files._one_level(iter([pd.DataFrame({"folder": ["any"], "path": ["b/c"]})])))
    assert [(r.path, r.status) for r in refused.itertuples()] == [("b/c", "unreadable")]


def test_a_large_folder_is_listed_in_chunks(tmp_path, monkeypatch):
    """Entries leave as they are found: no list of the whole folder is made."""
    for n in range(250):
        (tmp_path / f"{n}.txt").write_bytes(b"")
    monkeypatch.setattr(files, "_ROWS", 40)
    taken, real = [], files._local_entries

    def counted(path):
        for entry in real(path):
            taken.append(entry)
            yield entry
    monkeypatch.setattr(files, "_local_entries", counted)
    chunks = files._one_level(iter([pd.DataFrame({"folder": [str(tmp_path)], "path": [""]})]))
    assert len(next(chunks)) == 40 == len(taken) and sum(map(len, chunks)) == 210


def test_a_listing_can_carry_the_media_type(spark, tmp_path):
    (tmp_path / "noext").write_bytes(zip_bytes([("a.txt", b"in")]))
    listing = list_folders(spark, [str(tmp_path)]).withColumn("media_type", F.lit("application/zip"))
    rows = read_documents(read_listed(listing).withColumn("request_id", F.lit(1))).collect()
    assert [(row.archive, row.name, row.content) for row in rows] == [("noext", "a.txt", "in")]


def test_many_archives_of_one_name_are_dealt_out(spark):
    packed = zip_bytes([("a.txt", b"x")])
    rows = spark.range(4000).select(F.col("id").alias("request_id"), F.lit(1).alias("source_seq"), F.lit("resumes.zip").alias("name"), F.lit(packed).alias("content"))
    members = expand_archives(rows, ["request_id", "source_seq"])
    assert "hashpartitioning(request_id" in members._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = [r["count"] for r in members.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(counts) == 8 and max(counts) < 1000


def test_listed_archives_equal_those_read_whole(spark, folder):
    listing = list_folders(spark, [folder]).withColumn("request_id", F.lit(1))
    key = lambda r: (r.archive, r.member, r.name, r.unique_id, r.status, r.content, r.error)
    whole = sorted((key(r) for r in read_documents(read_listed(listing)).collect()), key=str)
    assert sorted((key(r) for r in read_documents(read_uploads(listing)).collect()), key=str) == whole


def test_an_archive_above_the_size_of_a_value_is_expanded_by_several_tasks(spark, tmp_path, monkeypatch):
    """A sparse archive of more than two gigabytes: a hole, then members, of which each range is a row for a task."""
    with open(tmp_path / "big.zip", "wb") as file:
        file.seek((2 << 30) + 12345)
        with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            for n in range(60):
                archive.writestr(f"{n}.txt", f"text {n}")
            archive.writestr("sub/", b"")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(zip_bytes([]))
    listing = list_folders(spark, [str(tmp_path)]).withColumn("request_id", F.lit(1))
    assert {r.name: r.status for r in read_listed(listing).collect()}["big.zip"] == "too_large"
    assert len(pd.concat(archives._directory(iter([pd.DataFrame({"folder": [str(tmp_path)], "path": ["big.zip"]})])))) == 1
    ranges = pd.DataFrame([(str(tmp_path), "big.zip", a, min(a + 6, 60), None) for a in range(0, 61, 7)], columns=["folder", "path", "first", "last", "error"])
    monkeypatch.setattr(archives, "_directory", lambda batches: (
        ranges if path == "big.zip" else pd.DataFrame([(folder, path, None, None, "BadZipFile")] if path == "broken.zip" else [], columns=ranges.columns)
        for batch in batches for folder, path in zip(batch["folder"], batch["path"])))
    members = archives.expand_listed(listing, ["request_id", "path"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = members.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.member, r.name, bytes(r.content)) for r in rows if r.archive == "big.zip") == [(n, f"{n}.txt", f"text {n}".encode()) for n in range(60)]
    assert len({r.task for r in rows if r.archive == "big.zip"}) > 3
    assert [(r.archive, r.member, r.error) for r in rows if r.archive != "big.zip"] == [("broken.zip", None, "BadZipFile")]


def test_ranges_follow_bytes_and_members(tmp_path, monkeypatch):
    data = os.urandom(1000)
    (tmp_path / "a.zip").write_bytes(zip_bytes([(f"{n}.txt", data) for n in range(10)]))
    frame = pd.DataFrame({"folder": [str(tmp_path)], "path": ["a.zip"]})
    for name, value, wanted in (("RANGE", 2500, [(0, 2), (3, 5), (6, 8), (9, 9)]), ("MEMBERS", 4, [(0, 3), (4, 7), (8, 9)])):
        with monkeypatch.context() as patch:
            patch.setattr(archives, name, value)
            found = pd.concat(archives._directory(iter([frame])))
            assert list(zip(found["first"], found["last"])) == wanted


def test_media_type_makes_an_archive(spark):
    rows = spark.createDataFrame([(1, 1, "noext", zip_bytes([("a.txt", b"in")]), "application/zip")],
                                 "request_id int, source_seq long, name string, content binary, media_type string")
    assert [(r.archive, r.name, r.content) for r in read_documents(rows).collect()] == [("noext", "a.txt", "in")]


def test_contents_of_unsupported_files_are_not_read(spark, folder):
    rows = {row.name: row.content for row in read_folder(spark, folder).collect()}
    assert rows["e.xyz"] is None and rows["noext"] is None and rows["a.TXT"] == FILES["a.TXT"]


@pytest.mark.parametrize("archive, name, status, content", [
    (None, "a.TXT", "ok", "Hello big world"), (None, "bad.txt", "unreadable", None), (None, "empty.txt", "ok", ""),
    (None, "_u.txt", "ok", "under"), (None, "b c.txt", "ok", "blank name"), (None, "é.txt", "ok", "na ve"),
    (None, "d.docx", "ok", "First line more Second line"), (None, "e.xyz", "unsupported", None),
    (None, "noext", "unsupported", None), (None, "g.doc", "no_decoder", None), (None, "broken.docx", "unreadable", None),
    ("broken.zip", "broken.zip", "unreadable", None), (None, LONG_NAME, "ok", "long"),
    ("flat.zip", "x.txt", "ok", "in zip"), ("flat.zip", "y.docx", "ok", "First line more Second line"),
    ("nested.zip", "sub/d.docx", "ok", "First line more Second line"), ("upper.zip", "A.TXT", "unsupported", None),
    ("mixed.ZIP", "m.txt", "ok", "good"), ("mixed.ZIP", "n.xyz", "unsupported", None),
    ("mixed.ZIP", "inner.zip", "unsupported", None), ("mixed.ZIP", "b c.txt", "ok", "same"),
])
def test_each_file(documents, archive, name, status, content):
    row = documents[(archive, name)]
    assert (row.status, row.content) == (status, content)
    assert row.file_path == f"{row.unique_id}_{name}"
    assert (row.error is not None) == (status == "unreadable")


def test_every_upload_gives_a_row(documents):
    names = {name for archive, name in documents if archive is None} | {archive for archive, _ in documents if archive}
    assert names == set(FILES)
    assert len({row.unique_id for row in documents.values()}) == len(documents)


def test_user_decoder(spark):
    rows = spark.createDataFrame([(1, 1, "f.pdf", b"%PDF"), (1, 2, "g.doc", b"xx"), (1, 3, "t.txt", b"plain")],
                                 "request_id int, source_seq long, name string, content binary")
    decoders = {"pdf": lambda data: f"pages {len(data)}", "doc": lambda data: 1 / 0}
    got = {row.name: (row.status, row.content) for row in read_documents(rows, decoders).collect()}
    assert got == {"f.pdf": ("ok", "pages 4"), "g.doc": ("unreadable", None), "t.txt": ("ok", "plain")}
    none = {row.name: row.status for row in read_documents(rows, {}).collect()}
    assert none == {"f.pdf": "no_decoder", "g.doc": "no_decoder", "t.txt": "ok"}


def test_a_decoder_that_hangs_dies_or_swells_costs_its_own_row(spark):
    def odd(data):
        if data == b"hang":
            time.sleep(3600)
        if data == b"exit":
            os._exit(7)
        if data == b"kill":
            os.kill(os.getpid(), 9)
        if data == b"swell":
            return "x" * (3 << 30)
        return 5 if data == b"number" else data.decode()
    contents = [b"a", b"hang", b"b", b"exit", b"c", b"kill", b"d", b"swell", b"e", b"\xff", b"f"]
    rows = spark.createDataFrame([(1, n, f"{n}.pdf", c) for n, c in enumerate(contents)], "request_id int, source_seq long, name string, content binary").coalesce(1)
    began = time.monotonic()
    got = {r.name[:-4]: r for r in read_documents(rows, {"pdf": odd}, DecodeLimits(seconds=1, memory=1 << 30)).collect()}
    assert time.monotonic() - began < 60
    errors = {contents[int(n)]: r.error.split(":")[0] for n, r in got.items() if r.status == "unreadable"}
    assert errors == {b"hang": "TimeoutError", b"exit": "ChildProcessError", b"kill": "ChildProcessError", b"swell": "MemoryError", b"\xff": "UnicodeDecodeError"}
    assert "".join(r.content for _, r in sorted(got.items(), key=lambda x: int(x[0])) if r.status == "ok") == "abcdef"


def test_helpers_end_with_their_task():
    helper = Helper({"t": lambda data: data.decode()}, DecodeLimits())
    assert helper.decode("t", b"x") == ("x", None)
    first = helper.process
    helper.process.kill()
    assert helper.decode("t", b"y")[1].startswith("ChildProcessError") and helper.decode("t", b"z") == ("z", None)
    assert not first.is_alive()
    second = helper.process
    helper.pipe.close()             # as when the task is lost
    second.join(10)
    assert second.exitcode == 0


def test_table_text_and_breaks_in_docx():
    assert decode_docx(DOCX) == "First <b>line</b> & more\nSecond line"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = ('<w:p><w:pPr><w:t>no</w:t></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t>'
            '<w:br w:type="page"/><w:noBreakHyphen/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>'
            '<w:p/><w:sdt><w:p><w:r><w:t>no</w:t></w:r></w:p></w:sdt>')
    xml = f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'.encode()
    assert decode_docx(zip_bytes([("word/document.xml", xml)])) == "a\tb\nc-link\n"


def test_archive_members_keep_their_order_and_duplicates(spark):
    data = zip_bytes([(f"{n}.txt", str(n).encode()) for n in range(300)])
    rows = spark.createDataFrame([(1, "z.zip", data)], "k int, name string, content binary")
    members = expand_archives(rows, ["k"])
    got = [(r.member, r.name, r.content) for r in members.sort("member").collect()]
    assert got == [(n, f"{n}.txt", str(n).encode()) for n in range(300)]


def test_large_members_leave_in_chunks(spark):
    block = os.urandom(1 << 20)
    data = zip_bytes([(f"{n}.txt", block) for n in range(80)])
    rows = spark.createDataFrame([(1, "z.zip", data)], "k int, name string, content binary")
    sizes = expand_archives(rows, ["k"]).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("b")).first()
    assert sizes.n == 80 and sizes.b == 80 << 20


def test_strict_utf8_like_python(spark):
    samples = [b"plain", "é\U0001f600".encode(), b"\xff", b"\xc3", b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80",
               b"a\x00b", b"\xef\xbb\xbfbom", b""]
    rows = spark.createDataFrame(list(enumerate(samples)), "i int, c binary")
    got = [r.t for r in rows.select("i", decode_text(F.col("c")).alias("t")).sort("i").collect()]
    expected = []
    for data in samples:
        try:
            expected.append(data.decode("utf-8"))
        except UnicodeDecodeError:
            expected.append(None)
    assert got == expected
