"""Packages written and read back; the directory parser against the standard library's writer."""

import io
import zipfile

import duckdb
import pytest

from visloom.llm import warc
from visloom.llm.queries import QUERIES, SQL

PAGES = "page_id long, url string, html string, record_type string"


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(SQL["op2_warc_packages"]).df().sort_values("page_id").reset_index(drop=True)
    got = QUERIES["op2_warc_packages"](spark, sf).toPandas().sort_values("page_id").reset_index(drop=True)
    assert got.fillna(-1).to_dict() == want[got.columns].fillna(-1).to_dict()


def test_copies_nulls_and_repeats(spark):
    long = "é" * 500
    rows = [(1, "u", long, "z"), (2, "a\r\nb", long, "z"), (2, "u", long, "z"), (None, None, long, "z"), (4, None, None, "z")]
    rows += [(5, "u", "x" * 999, "z"), (6, "u", "x" * 999, "z"), (7, "u", "\r\n\r\n" * 400, "z")]
    got = warc.archived_pages(spark.createDataFrame(rows, PAGES)).collect()
    brief = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got)
    assert brief == [
        (0, 1000, "revisit", 2),
        (1, 1000, "revisit", 2),
        (2, 1000, "response", 0),
        (2, 1000, "response", 0),
        (4, 0, "response", 0),
        (5, 999, "response", 0),
        (6, 999, "response", 0),
        (7, 1600, "response", 0),
    ]
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_directories(monkeypatch, wide):
    if wide:  # everything beyond 10 bytes or 1 member gets ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for k in range(5):
            out.writestr(f"m{k}", bytes([65 + k]) * 100 * k)
        out.comment = b"a comment with PK\x05\x06 inside"
    whole = data.getvalue()
    assert (warc.END64_SIGNATURE in whole) == wide
    for m in warc.stored_members(data, len(whole)):
        k = int(m.name[1:])
        assert whole[m.offset : m.offset + m.size] == bytes([65 + k]) * 100 * k


def test_bad_packages():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("m", b"x" * 1000)
    for data in (packed, io.BytesIO(b"x" * 100)):
        with pytest.raises(warc.BadPackage):
            warc.stored_members(data, len(data.getvalue()))
    with pytest.raises(warc.BadPackage):
        warc.read_record(warc.warc_record(1, "u", b"abc", None).replace(b"abc", b"abd"))
