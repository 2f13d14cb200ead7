"""Encodings found in bytes, against Python's codecs."""

import pytest

from docweave.functions import encoding
from docweave.sources import files

TEXT = "<html><head>{meta}</head><body>Überraschung, naïve café: 100 € – “so”</body></html>"
META = '<meta charset="{}">'


def cases():
    utf, ansi = TEXT.format(meta=META.format("utf-8")), TEXT.format(meta='<meta http-equiv="Content-Type" content="text/html; charset=Windows-1252">')
    plain, latin = "<p>plain</p>", TEXT.format(meta="").replace("€", "").replace("–", "").replace("“so”", "")
    return [
        (b"\xef\xbb\xbf" + utf.encode(), "utf-8", "mark", utf),
        (utf.encode(), "utf-8", "bytes", utf),
        (b"\xff\xfe" + utf.encode("utf-16le"), "utf-16le", "mark", utf),
        (b"\xfe\xff" + utf.encode("utf-16be"), "utf-16be", "mark", utf),
        (utf.encode("utf-16le"), "utf-16le", "zeros", utf),
        (utf.encode("utf-16be"), "utf-16be", "zeros", utf),
        (ansi.encode("cp1252"), "windows-1252", "declared", ansi),
        (utf.encode("cp1252"), "windows-1252", "rest", utf),
        (ansi.encode(), "utf-8", "bytes", ansi),
        (latin.encode("latin-1"), "windows-1252", "rest", latin),
        (b"<?xml version='1.0' encoding='ISO-8859-1'?><p>\xe9</p>", "windows-1252", "declared", "<?xml version='1.0' encoding='ISO-8859-1'?><p>é</p>"),
        (plain.encode(), "us-ascii", "bytes", plain),
        (b"", "us-ascii", "bytes", ""),
        (b"\xff", "windows-1252", "rest", "ÿ"),
        (b"\xef\xbb\xbf\xff", "windows-1252", "rest", "ï»¿ÿ"),
        (bytes(range(0x80, 0xA0)), "windows-1252", "rest", encoding._CP1252),
        ("日本語のページ".encode(), "utf-8", "bytes", "日本語のページ"),
        (None, None, None, None),
    ]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases())], "i int, content binary")
    return {r["i"]: (r["encoding"], r["reason"], r["html"]) for r in files.decoded_pages(df).collect()}


@pytest.mark.parametrize("i", range(len(cases())))
def test_encoding(found, i):
    assert found[i] == cases()[i][1:]


def test_fixed_values_are_those_of_the_codec():
    assert "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)).replace("\ufffd", "") == encoding._CP1252.translate(dict.fromkeys(map(ord, "\x81\x8d\x8f\x90\x9d")))


def test_pages_of_a_folder(spark, tmp_path):
    full = {i: c for i, c in enumerate(cases()) if c[0]}  # Spark passes over empty files
    for i, (content, *_) in full.items():
        (tmp_path / f"{i}.html").write_bytes(content)
    (tmp_path / "other.txt").write_bytes(b"x")
    rows = files.read_pages(spark, str(tmp_path)).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["html"] for r in rows} == {f"{i}.html": c[3] for i, c in full.items()}
