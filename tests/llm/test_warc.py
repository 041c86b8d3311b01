import hashlib
import re

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in data:
        owner = max((j for j, q in data if q == p and j is not None), default=None)
        response = len(p) < 1000 or i == owner
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if response else "revisit", None if response else owner))
    return out


def rows():
    big = "é" * 600
    return [(1, "http://a", big), (5, "http://b\r\nX: y", big), (3, None, big), (7, "http://c", "x" * 999), (8, "u", "x" * 999), (9, "u", "x" * 1000), (2, "u", "x" * 1000), (4, "u", None), (6, "u", ""), (None, "u", big), (None, "u", "z" * 2000), (11, "u", "y" * 300_000), (12, "u", "q" * 1500), (12, "u", "q" * 1500)]


def test_round_trip(spark):
    got = warc.round_trip(spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 as payload", "'x' as sha256").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows())))
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ids_of_another_type_and_very_long_payloads(spark):
    data = [(1, "u", "a\r\n\r\nb" * 1_000_000), (2, "u", "a\r\n\r\nb" * 1_000_000), (3, "u", "\r\n\r\n"), (4, "u", "\r\n\r\n" * 300)]
    got = warc.round_trip(spark.createDataFrame(data, "page_id int, url string, html string"))
    assert got.schema["refers_to"].dataType.simpleString() == "int"
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(data)))


def test_wrong_records_are_found(spark, tmp_path):
    """A header whose length or digest isn't that of its block ends the job."""
    data = [(1, "u", "x" * 2000), (2, "u", "x" * 2000)]
    for k, (old, new) in enumerate((("2100", "2101"), ("sha1:", "sha1:0"))):
        path = f"{tmp_path}/{k}"
        warc.write(spark.createDataFrame(data, SCHEMA), path)
        heads = spark.read.parquet(f"{path}/headers").collect()
        text = bytes(heads[0].header).decode()
        length = max(re.findall(r"Content-Length: (\d+)", "".join(bytes(h.header).decode() for h in heads)), key=int)
        old = f"Content-Length: {length}" if k == 0 else old
        new = f"Content-Length: {int(length) + 1}" if k == 0 else new
        bad = [(h.page_id, h.sha256, bytearray(bytes(h.header).decode().replace(old, new, 1).encode())) for h in heads]
        spark.createDataFrame(bad, "page_id long, sha256 string, header binary").write.mode("overwrite").parquet(f"{path}/headers")
        with pytest.raises(Exception, match="corrupt record"):
            warc.facts(spark, path).collect()
        assert "WARC/1.1" in text


def test_payloads_meet_headers_in_place(spark, tmp_path):
    warc.write(spark.createDataFrame(rows(), SCHEMA), f"{tmp_path}/a")
    plan = warc.records(spark, f"{tmp_path}/a")._jdf.queryExecution().optimizedPlan().toString()
    assert "payload" in plan and spark.sql("show tables").filter("tableName like 'tidemark_%'").count() == 0


def test_records_can_be_read_as_warc(spark, tmp_path):
    warc.write(spark.createDataFrame(rows(), SCHEMA), f"{tmp_path}/a")
    assert warc.payloads(spark, f"{tmp_path}/a").count() == len({h or "" for _, _, h in rows()})
    found = warc.records(spark, f"{tmp_path}/a").collect()
    (tmp_path / "files").mkdir()
    (tmp_path / "files/all.warc").write_bytes(b"".join(bytes(r.record) for r in found))
    back = warc.read_files(spark, f"{tmp_path}/files").collect()
    assert len(back) == len(found) == len(rows())
    for r in back:
        if r.record_type == "response":
            assert r.digest == "sha1:" + hashlib.sha1(bytes(r.block).split(b"\r\n\r\n", 1)[1]).hexdigest()
        else:
            assert bytes(r.block) == b""


def test_corruption_is_found(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "abc")], SCHEMA), f"{tmp_path}/a")
    spark.createDataFrame([("0" * 64, bytearray(b"abc"))], "sha256 string, payload binary").write.mode("append").parquet(f"{tmp_path}/a/payloads")
    try:
        warc.payloads(spark, f"{tmp_path}/a").collect()
    except Exception as e:
        assert "corrupt payload" in str(e)
    else:
        raise AssertionError("a wrong digest passed")
