import base64
import hashlib

import pytest

from pathledger.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, record string, place string, payload string"


def pages(spark):
    rows = [(i, f"http://h{i % 3}/é{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "http://x", ""), (102, "http://x\r\nWARC-Type: none", "a\r\n\r\nb\r\n\r\n"), (103, "u", "a\r\n\r\nb\r\n\r\n"), (104, "u", "long ü " * 30_000)]
    rows += [(5, "http://h2/é5", "once more"), (5, "http://h2/é5", "once more"), (5, "z", "once more"), (None, "n", "null page"), (None, None, "null page"), (7, "n", "null page"), (200, "u", "unique")]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def expected(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [(p is not None, p or 0) for p, _, h in rows if (h or "") == (html or "")]
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), max(same)))
    return out


@pytest.mark.parametrize("few", [100_000, 0])
def test_archive_gives_every_record_back(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_COPIES", few)
    rows = [tuple(r)[:3] for r in pages(spark).collect()]
    path = warc.write_archive(pages(spark), str(tmp_path / "a"))
    got = [tuple(r) for r in warc.digest_rows(warc.read_archive(spark, path)).collect()]
    want = expected(rows)
    assert sorted((r[:3] for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    tops = {w[2]: w[3] for w in want}
    for page_id, _, digest, kind, refers in got:
        top = tops[digest][1] if tops[digest][0] else None
        assert (kind == "revisit" and refers == top) or (kind == "response" and refers is None and page_id == top)
    assert sum(r[3] == "response" for r in got) == len(tops)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len(tops) == stored.select("digest").distinct().count()


def test_records_are_exact_and_files_round_trip(spark, tmp_path):
    records = warc.read_archive(spark, warc.write_archive(pages(spark), str(tmp_path / "a"))).cache()
    made = sorted(bytes(r["record"]) for r in records.collect())
    warc.write_files(records, str(tmp_path / "files"))
    assert sorted(bytes(r["record"]) for r in warc.read_files(spark, str(tmp_path / "files")).collect()) == made
    for r in made:
        head, _, rest = r.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        http, _, payload = rest[:-4].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) - 4 == int(fields[b"Content-Length"]) and r.endswith(b"\r\n\r\n")
        n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        if fields[b"WARC-Type"] == b"response":
            assert len(payload) == n and fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
        else:
            assert payload == b"" and fields[b"WARC-Refers-To"] and fields[b"WARC-Profile"] == warc.PROFILE.encode()
    assert len({x for r in made for x in r.split(b"\r\n") if x.startswith(b"WARC-Record-ID")}) == len(made)


def test_changed_payloads_and_lengths_are_noticed(spark, tmp_path):
    path = warc.write_archive(pages(spark), str(tmp_path / "a"))
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "concat(payload, X'00') AS payload").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{path}/headers").write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    with pytest.raises(ValueError, match="length says"):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n"))


def test_no_pages(spark, tmp_path):
    path = warc.write_archive(pages(spark).limit(0), str(tmp_path / "a"))
    assert warc.digest_rows(warc.read_archive(spark, path)).collect() == []
