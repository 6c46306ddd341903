import gzip
import hashlib

from pyspark.sql import functions as F

from epicohort.llm import warc as W

LONG = "<p>" + "long page " * 200_000 + "</p>"
COPY = "<html>" + "copied " * 40 + "</html>"
ROWS = [(1, "http://a.example/1", "<html>é one</html>" + "x" * 120), (2, "http://a.example/2", COPY), (3, "http://b.example/3", COPY),
        (4, None, COPY), (5, "http://b.example/5\r\nWARC-Type: evil", "short"), (6, "http://b.example/6", "short"), (7, "u", None), (8, "u", ""),
        (9, "http://c.example/9", LONG), (10, "http://c.example/10", LONG), (11, "same", "again" * 40), (11, "same", "again" * 40),
        (11, "same", "again" * 40), (None, "http://d.example", COPY), (12, "a%20b", "\r\n\r\nWARC/1.1\r\n" + "y" * 200)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, archive string, OFFSET long")


def brute(rows):
    out, first = [], {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        data = (html or "").encode()
        again = len(data) >= W.LEAST_REVISIT and data in first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
        first.setdefault(data, page)
    return sorted(out, key=str)


def test_records_read_back(spark):
    index = W.write_archives(frame(spark))
    got = W.read_back(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_every_byte_of_an_archive_is_in_the_index_once(spark):
    index = W.write_archives(frame(spark).repartition(3)).orderBy("archive", "offset").collect()
    ids = [r["record_id"] for r in index]
    assert len(set(ids)) == len(ids) == len(ROWS)
    by_archive = {}
    for r in index:
        by_archive.setdefault(r["archive"], []).append(r)
    for archive, records in by_archive.items():
        store, path = W.open_store(archive)
        with store.open_input_file(path) as f:
            data = f.read()
        at = 0
        for r in records:
            assert r["offset"] == at
            at += r["length"]
            fields, http, payload = W.parse_record(gzip.decompress(data[r["offset"]:at]))
            assert fields["warc-type"] == r["record_type"] and f"<{r['record_id']}>" == fields["warc-record-id"]
            assert fields["warc-payload-digest"] == f"sha256:{r['digest']}"
            if r["record_type"] == "response":
                assert hashlib.sha256(payload).hexdigest() == r["digest"]
            else:
                assert payload == b"" and fields["warc-refers-to"] == f"<{r['refers_to']}>" and r["refers_to"] in ids
        assert at == len(data)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_selected_records_are_read_by_ranges(spark):
    index = W.write_archives(frame(spark))
    some = index.where(F.col("record_key").isin("1", "9", "12"))
    got = {r["record_key"]: bytes(r["payload"]).decode() for r in W.read_records(some).collect()}
    assert got == {str(r[0]): r[2] for r in ROWS if r[0] in (1, 9, 12)}


def test_ranges_coalesce_up_to_a_gap_and_a_size(monkeypatch):
    monkeypatch.setattr(W, "GAP_BYTES", 10)
    monkeypatch.setattr(W, "READ_BYTES", 100)
    assert list(W._ranges([(0, 20), (20, 20), (50, 10), (71, 5), (76, 90), (166, 500)])) == \
        [[(0, 20), (20, 20), (50, 10)], [(71, 5), (76, 90)], [(166, 500)]]
    assert list(W._ranges([])) == []


def test_empty_table_and_text_keys(spark):
    empty = W.write_archives(frame(spark, []))
    assert empty.count() == 0 and W.read_back(empty).count() == 0
    named = spark.createDataFrame([("a b\r\n%", "u", "z" * 150), ("c", "u", "z" * 150)], "page_id string, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in W.read_back(W.write_archives(named), "string").collect())
    assert got == [("a b\r\n%", "response", None), ("c", "revisit", "a b\r\n%")]
