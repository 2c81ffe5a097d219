import base64
import hashlib

from sightline.llm import warc as W


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\r\nWARC-Type: revisit", "<p>é</p>"), (1, "u1", "<p>é</p>"), (2, None, None), (4, "u4", ""), (5, "u5", "x" * 10), (None, "n", "x" * 10), (1, "u1", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, strong string")
    path = f"file://{tmp_path}/a"
    W.write_archive(df, path)
    got = {}
    for r in W.read_archive(spark, path).collect():
        got.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], r["verified"]))
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got[1] == [("response", None, 9, d("<p>é</p>"), True)] * 2
    assert got[3] == [("revisit", 1, 9, d("<p>é</p>"), True)]
    assert got[2] == [("response", None, 0, d(""), True)] and got[4] == [("revisit", 2, 0, d(""), True)]
    assert got[None] == [("revisit", 5, 10, d("x" * 10), True)]
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    for r in W.reconstruct(spark, path).collect():
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(block) - 4 == int(fields[b"Content-Length"])
        assert fields[b"WARC-Type"] == (b"revisit" if r["page_id"] in (3, 4, None) else b"response")
    path = f"file://{tmp_path}/b"
    W.write_archive(df, path, min_bytes=10)
    assert [r["record_type"] for r in W.read_archive(spark, path).where("page_id = 3").collect()] == ["response"]
    path = f"file://{tmp_path}/c"
    W.write_archive(df.where("false"), path)
    assert W.read_archive(spark, path).collect() == []
