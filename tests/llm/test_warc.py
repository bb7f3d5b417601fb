import hashlib

import pytest

from tsumugi.llm import warc
from tsumugi.llm.common import new_folder


def made(n=6):
    pay = [f"<html>page {i} é</html>".encode() * (i + 1) for i in range(n)]
    return pay, [warc.record(i, f"http://x/{i} y", p, hashlib.sha256(p).hexdigest()) for i, p in enumerate(pay)]


@pytest.mark.parametrize("gz", [True, False])
def test_whole_archive(gz):
    pay, recs = made()
    got = list(warc.salvage(b"".join(warc.gzip_member(r) if gz else r for r in recs)))
    assert [(k, r["page_id"], r["payload"]) for k, _, r in got] == [("record", i, p) for i, p in enumerate(pay)]


@pytest.mark.parametrize("gz", [True, False])
def test_every_damaged_byte_costs_only_its_record(gz):
    pay, recs = made(3)
    parts = [warc.gzip_member(r) if gz else r for r in recs]
    whole, mid = b"".join(parts), (len(parts[0]), len(parts[0]) + len(parts[1]))
    for at in range(mid[0], mid[1]):
        data = bytearray(whole)
        data[at] ^= 0x55
        got = list(warc.salvage(bytes(data)))
        ids = [r[2]["page_id"] for r in got if r[0] == "record"]
        gaps = [r for r in got if r[0] == "gap"]
        assert ids[0] == 0 and ids[-1] == 2
        assert all(g[1:3] == (mid[0], mid[1] - mid[0]) for g in gaps)
        # in a plain record the values of a few header fields have nothing to be checked against
        assert gaps or (at - mid[0] < recs[1].index(b"\r\n\r\n") if not gz else at - mid[0] < 10)


@pytest.mark.parametrize("gz", [True, False])
def test_cut_off_leading_garbage_and_missing_bytes(gz):
    _, recs = made(4)
    parts = [warc.gzip_member(r) if gz else r for r in recs]
    data = b"junk\x1f\x8b\x08junk" + parts[0] + parts[1][:-9] + parts[2] + b"WARC/1.1\r\n" + parts[3] + parts[0][:20]
    got = list(warc.salvage(data))
    assert [r[2]["page_id"] for r in got if r[0] == "record"] == [0, 2, 3]
    gaps = [(r[1], r[2]) for r in got if r[0] == "gap"]
    assert len(gaps) == 4 and sum(n for _, n in gaps) == len(data) - len(parts[0]) - len(parts[2]) - len(parts[3])
    assert list(warc.salvage(b"")) == []


def test_members_of_several_records_and_mixed_archives():
    pay, recs = made(6)
    bad = bytearray(recs[1])
    bad[-6] ^= 1
    several = warc.gzip_member(recs[0] + bytes(bad) + recs[2])
    ids = lambda data: [r[2]["page_id"] for r in warc.salvage(data) if r[0] == "record"]
    gaps = lambda data: [r[1:3] for r in warc.salvage(data) if r[0] == "gap"]
    assert ids(several) == [0, 2] and gaps(several) == [(0, len(recs[1]))]
    whole = warc.gzip_member(b"".join(recs))
    for at in range(len(whole) // 2, len(whole) - 1, 7):  # one gzip stream that breaks off: what came before is kept
        got = ids(whole[:at])
        assert got == list(range(len(got))) and gaps(whole[:at]) == [(0, at)]
    assert len(ids(whole[: len(whole) - 12])) >= 4
    mixed = recs[0] + warc.gzip_member(recs[1]) + bytes(bad) + warc.gzip_member(recs[2]) + recs[3]
    assert ids(mixed) == [0, 1, 2, 3] and len(gaps(mixed)) == 1


def test_damage_is_an_error_where_all_records_are_wanted(spark):
    from tsumugi.llm.common import get_file, put_file

    df = spark.createDataFrame([(i, "u", "<p>" + "x" * i) for i in range(30)], "page_id long, url string, html string")
    m = warc.write(df, new_folder(spark, "t"))
    assert warc.read(m, whole=True).count() == 30
    file = m.first().file
    put_file(file, get_file(file)[:-9])
    assert warc.read(m).filter("kind = 'gap'").count() == 1
    with pytest.raises(Exception, match="was written with"):
        warc.read(m, whole=True).count()


def test_write_read(spark):
    big, small = "x" * 120, "y" * 99
    rows = [(5, "u", big), (3, "u", big), (3, "u", big), (9, None, big), (1, "u", small), (2, "u", small), (7, "u", None), (8, "u", ""), (11, "a b", "é" * 60), (12, "a\nb", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to")
    got = sorted(map(tuple, warc.read(warc.write(df, new_folder(spark, "t"), archive_bytes=300)).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    first = {big: 3, "é" * 60: 11}
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        r = first.get(h) if h in first and p != first[h] else None
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if r else "response", r))
    assert got == sorted(want, key=str)
    assert warc.read(warc.write(df.limit(0), new_folder(spark, "t"))).count() == 0
