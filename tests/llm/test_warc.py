import hashlib

import pytest
from pyspark.sql import functions as F

from subventa.llm.store import new_path
from subventa.llm.warc import planned, read_archive, write_archive

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "a" * 200


def archive(spark, rows, **more):
    path = new_path(spark, "warc-test")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as payload", "2 as first")
    write_archive(planned(df.repartition(3)), path)
    return path


def test_round_trip_and_revisits(spark):
    rows = [(3, "http://a/3", BIG), (1, "http://a/1", BIG), (2, None, BIG), (4, "http://a/4\r\nX: y", "short"), (5, "http://é/ 5", "short"),
            (6, "u", None), (7, "u", ""), (None, "u", BIG), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 50), (9, "u", "é\U0001f600" * 300000), (1, "http://a/1", BIG)]
    path = archive(spark, rows)
    got = sorted(((r.page_id, r.target_uri, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in read_archive(spark, path).collect()), key=repr)
    want = []
    for page, url, html in rows:
        body = html or ""
        again = page is not None and page != 1 and body == BIG
        want.append((page, url, "revisit" if again else "response", 1 if again else None, hashlib.sha256(body.encode()).hexdigest(), len(body.encode()), None if again else body))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("condition", ["record_type = 'revisit'", "page_id in (2, 6)", "page_id > 4 and page_id <= 8", "target_uri is null", "payload_digest = 'x'", "payload_bytes > 100 and record_type = 'response'"])
def test_filters_are_pushed_and_right(spark, condition):
    path = archive(spark, [(i, None if i % 5 == 0 else f"u{i}", BIG if i % 3 else f"{i}" * i) for i in range(1, 12)])
    whole = {tuple(r) for r in read_archive(spark, path).collect() if True}
    frame = read_archive(spark, path).filter(condition)
    kept = {tuple(r) for r in frame.collect()}
    by_hand = {tuple(r) for r in spark.createDataFrame(list(whole), read_archive(spark, path).schema).filter(condition).collect()}
    assert kept == by_hand


def test_payload_can_be_left_out(spark):
    path = archive(spark, [(1, "u", BIG), (2, "v", "x")])
    back = read_archive(spark, path, payload=False)
    assert {(r.page_id, r.payload, r.payload_bytes) for r in back.collect()} == {(1, None, len(BIG)), (2, None, 1)}


def test_empty_table_and_overwrite(spark):
    path = archive(spark, [(1, "u", BIG)])
    write_archive(planned(spark.createDataFrame([(2, "v", "x")], SCHEMA)), path)
    assert [r.page_id for r in read_archive(spark, path).collect()] == [2]
    write_archive(planned(spark.createDataFrame([(3, "w", "x")], SCHEMA)), path, mode="append")
    assert sorted(r.page_id for r in read_archive(spark, path).collect()) == [2, 3]
    assert read_archive(spark, archive(spark, [])).count() == 0


def test_foreign_archive_without_lengths(spark, tmp_path):
    import gzip

    from subventa.llm.warc import record

    raw = b"".join(gzip.compress(record("response", i, f"u{i}", None, "d", 3, b"abc")) for i in range(5))
    (tmp_path / "x.warc.gz").write_bytes(raw)
    got = read_archive(spark, str(tmp_path)).orderBy("page_id")
    assert [(r.page_id, bytes(r.payload)) for r in got.collect()] == [(i, b"abc") for i in range(5)]
    assert read_archive(spark, str(tmp_path)).filter(F.col("page_id") == 3).count() == 1


@pytest.mark.parametrize("sizes", [[7], [1, 2, 4], [3, 3, 1]])
def test_members_with_several_records_and_plain_files_lose_nothing(spark, tmp_path, sizes):
    import gzip

    from subventa.llm.warc import record

    bodies = [b"", b"x", b"WARC/1.1\r\n\r\n", b"\r\n" * 50, b"y" * 300_000, bytes(range(256)) * 300, b"end"]
    raw = [record("response", i, f"u{i}", None, "d", len(b), b) for i, b in enumerate(bodies)]
    members, at = [], 0
    for n in sizes:
        members.append(gzip.compress(b"".join(raw[at : at + n])))
        at += n
    (tmp_path / "z").mkdir(), (tmp_path / "p").mkdir()
    (tmp_path / "z" / "x.warc.gz").write_bytes(b"".join(members))
    (tmp_path / "p" / "x.warc").write_bytes(b"".join(raw))
    for folder in ("z", "p"):
        rows = read_archive(spark, str(tmp_path / folder)).collect()
        assert sorted((r.page_id, bytes(r.payload)) for r in rows) == list(enumerate(bodies))
        heads = read_archive(spark, str(tmp_path / folder), payload=False).filter("page_id >= 3")
        assert sorted(r.page_id for r in heads.collect()) == [3, 4, 5, 6]


def test_a_cut_archive_is_an_error(spark, tmp_path):
    import gzip

    from subventa.llm.warc import record

    whole = gzip.compress(record("response", 1, "u", None, "d", 3, bytes(range(256)) * 999))
    (tmp_path / "x.warc.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception, match="archive ends inside a record|shorter than its content length"):
        read_archive(spark, str(tmp_path)).collect()
