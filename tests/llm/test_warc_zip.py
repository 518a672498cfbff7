import gzip
import io
import json
import random
import zipfile

import pyarrow as pa
import pytest

from sievework.llm import warc_zip
from sievework.llm.warc_zip import Package


def opened(raw):
    return Package(pa.PythonFile(io.BytesIO(raw), mode="r"))


def records(n=5):
    return [warc_zip.record("response", {"WARC-Target-URI": f"http://h/{i}", "X": "é"}, f"body {i}\r\n\r\n é".encode() * (i + 1)) for i in range(n)]


def test_zip64_package_is_a_zip_file_and_is_parsed():
    raw = warc_zip.zip_package([("archive/a.warc", b"abc" * 100), ("indexes/é.cdxj", b"x"), ("empty", b"")])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.read("archive/a.warc") == b"abc" * 100
    package = opened(raw)
    assert list(package.members) == ["archive/a.warc", "indexes/é.cdxj", "empty"]
    assert package.content("archive/a.warc") == b"abc" * 100 and package.content("empty") == b""


def library_zip(members, index=None, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name), body, compress_type=method)
        if index is not None:
            z.writestr("indexes/index.cdx.gz", gzip.compress(index), compress_type=zipfile.ZIP_DEFLATED)
        z.comment = comment
    return out.getvalue()


def test_package_of_another_writer_with_index_and_comment():
    recs = records()
    body, lines = b"", []
    for i, r in enumerate(recs):
        lines.append(f"com,h)/{i} 2020 " + json.dumps({"filename": "a.warc.gz", "offset": str(len(body)), "length": str(len(r))}))
        body += r
    package = opened(library_zip([("archive/a.warc.gz", body)], ("!meta {}\n" + "\n".join(lines)).encode(), comment=b"PK\x05\x06 no end" + b"." * 30))
    places = list(package.records())
    assert len(places) == 5
    for i, (at, size) in enumerate(places):
        headers, content = warc_zip.parse_record(package.read(at, size))
        assert headers["warc-target-uri"] == f"http://h/{i}" and headers["x"] == "é" and content == f"body {i}\r\n\r\n é".encode() * (i + 1)


def test_package_without_index_is_searched(monkeypatch):
    recs = records(20)
    package = opened(library_zip([("archive/a.warc.gz", b"".join(recs[:13])), ("archive/b.warc.gz", b"".join(recs[13:]))]))
    for span in (7, 100, 1 << 20):
        monkeypatch.setattr(warc_zip, "SPAN", span)
        assert [package.read(at, size) for at, size in package.records()] == recs


def test_bad_files_are_errors():
    with pytest.raises(ValueError, match="isn't stored"):
        list(opened(library_zip([("archive/a.warc.gz", b"x" * 500)], method=zipfile.ZIP_DEFLATED)).records())
    for raw in (b"", b"no zip at all" * 10, warc_zip.zip_package([("a", b"b")])[:-5]):
        with pytest.raises(ValueError):
            opened(raw)


def test_round_trip(spark):
    rng = random.Random(0)
    rows = [(i, f"http://h{i}.org/é {i}", "".join(rng.choice("<p>é\r\n\x00 🙂") for _ in range(rng.randrange(400))), "x") for i in range(60)]
    rows += [(None, None, None, None), (None, None, "", "x"), (1, "", None, None), (1, "", None, None), (2, "line\r\nbreak", "x" * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string").repartition(3)
    manifest = warc_zip.write_packages(pages, rows_per_package=7)
    assert manifest.agg({"n_rows": "sum"}).first()[0] == len(rows)
    got = warc_zip.read_packages(spark, manifest)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((r[:3] for r in rows), key=str)
    assert warc_zip.read_packages(spark, warc_zip.write_packages(pages.limit(0))).count() == 0


def test_records_that_the_index_leaves_out_are_searched():
    recs = records(9)
    ends = [sum(map(len, recs[: i + 1])) for i in range(9)]
    lines = [json.dumps({"filename": "a.warc.gz", "offset": ends[i] - len(recs[i]), "length": len(recs[i])}) for i in (7, 2, 3)]
    lines.append(json.dumps({"filename": "index.cdx.gz", "offset": 0, "length": 99}))  # a ZipNum line
    package = opened(library_zip([("archive/a.warc.gz", b"".join(recs))], "\n".join(f"com,h)/ 2020 {x}" for x in lines).encode()))
    places = list(package.records())
    assert len(places) == 9 and [package.read(*p) for p in sorted(places)] == recs


@pytest.mark.parametrize("indexed", [False, True])
def test_plain_members_are_searched_by_content_length(indexed):
    recs = [gzip.decompress(r) for r in records(6)] + [warc_zip.record("response", {"WARC-Target-URI": "http://h/6", "X": "y" * 9000}, b"zipped")]
    line = json.dumps({"filename": "a.warc", "offset": len(recs[0]), "length": len(recs[1]) - 4})
    package = opened(library_zip([("archive/a.warc", b"".join(recs))], f"com 2020 {line}".encode() if indexed else None))
    got = [warc_zip.parse_record(package.read(*p)) for p in sorted(package.records())]
    assert got == [warc_zip.parse_record(r) for r in recs]
    for bad in (recs[0][:-20], b"no record"):
        with pytest.raises(ValueError):
            list(opened(library_zip([("archive/a.warc", bad)])).records())
