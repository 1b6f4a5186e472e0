"""Archives are written and read back; frames stand alone behind their dictionary."""

import hashlib
import struct
import zstandard

from plumbline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, payload string, refers_to string"


def expected(rows):
    first = {}
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        if len(b) >= warc.MIN_BYTES and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h, *_ in rows:
        b = (h or "").encode()
        first_id = first.get(b)
        revisit = first_id is not None and i != first_id
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first_id if revisit else None))
    return out


def test_round_trip(spark, tmp_path):
    page = "<html><body>" + "same boilerplate in every page, as it is " * 5
    rows = [(i, f"http://x/{i}", f"{page}{i % 40}</body>") for i in range(200)]
    rows += [(300, None, None), (301, "a\r\nb", ""), (302, "u", "short"), (303, "u", "short"), (None, "u", rows[0][2]), (None, "u", "ü" * 80), (5, "u", rows[5][2]), (304, "u", "é😀" * 100_000)]
    rows = [(*r, "d", "p", "r") for r in rows]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = f"file://{tmp_path}/archives"
    written = warc.archive(pages, folder)
    back = warc.read(written, folder).collect()
    got = sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in back), key=str)
    assert got == sorted(expected(rows), key=str)
    assert written.groupBy().sum("records").first()[0] == len(rows)
    files = sorted((tmp_path / "archives").iterdir())
    assert {f.name for f in files} == {r["archive"] for r in written.collect()}
    data = files[0].read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert frames.decompressobj().decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    written = warc.archive(spark.createDataFrame([], SCHEMA), folder)
    assert written.count() == 0 and warc.read(written, folder).count() == 0


def test_dictionary_helps():
    samples = [f"<html><head><title>{i}</title></head><body class='page main wide'>{i * i}</body></html>".encode() for i in range(500)]
    d = warc.build_dictionary(samples)
    small = sum(len(zstandard.ZstdCompressor(dict_data=d).compress(x)) for x in samples)
    assert small < 0.7 * sum(len(zstandard.ZstdCompressor().compress(x)) for x in samples)
    assert warc.build_dictionary([b"x"]) is not None and warc.build_dictionary([]) is None
