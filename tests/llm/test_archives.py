import gzip
import hashlib
import io

import pytest

from tramline.llm import archives

ROWS = [(5, "http://a/1", "x" * 200), (3, "http://a/2", "x" * 200), (9, None, "x" * 200), (1, "http://b\r\nX: y", "é" * 50), (2, "", "é" * 50), (4, " urn:none\t\x00 ", "s" * 99), (6, "http://c", "s" * 99), (7, "urn:none", None), (8, "u", ""), (None, "n", "x" * 200), (10, "w", "WARC/1.1\r\n\r\n" * 9), (10, "w", "WARC/1.1\r\n\r\n" * 9)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, payload string, record_type string")


def test_round_trip(spark):
    got = sorted(archives.round_trip(pages(spark, ROWS).repartition(3)).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert len(got) == len(ROWS)
    by = {i: (u, h or "") for i, u, h in ROWS}
    for r in got:
        raw = by[r.page_id][1].encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        same = [i for i, (_, h) in by.items() if i is not None and h.encode() == raw]
        first = min(same) if same and len(raw) >= 100 else r.page_id
        revisit = len(raw) >= 100 and (r.page_id is None or r.page_id > first)
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
    assert all(r.url == by[r.page_id][0] for r in got)  # also those that a header can't hold as they are


def test_small_files(spark):
    folder = archives.new_path(spark, "warc")
    made = archives.write_archives(pages(spark, ROWS).coalesce(1), folder, file_bytes=300)
    assert made.count() > 3 and sum(r.records for r in made.collect()) == len(ROWS)
    assert archives.read_archives(spark, folder, made).count() == len(ROWS)


def test_empty(spark):
    assert archives.round_trip(pages(spark, [])).collect() == []


def member(block=b"hello", **headers):
    return archives.member({"WARC-Type": "resource", **headers}, block)


def test_members_read_over_block_borders():
    import random

    rng = random.Random(1)
    blocks = [rng.randbytes(n) for n in (0, 1, archives.BLOCK, 3 * archives.BLOCK + 7)]
    got = archives.read_bytes(b"".join(member(b) for b in blocks))
    assert [r.block for r in got] == blocks
    assert got[1].offset == len(member(blocks[0]))


@pytest.mark.parametrize("bad", [
    member()[:-5],
    gzip.compress(b"not a record at all\r\n\r\n"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n"),
    gzip.compress(b"WARC/1.1\r\nX: y\r\n\r\nab\r\n\r\n"),
    member(**{"WARC-Block-Digest": "sha256:" + "0" * 64}),
    b"plain",
])
def test_faults_are_raised(bad):
    with pytest.raises(ValueError):
        archives.read_bytes(member() + bad)


def test_one_block_in_memory():
    class Slow(io.BytesIO):
        most = 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            return super().read(n)

    source = Slow(b"".join(member(b"y" * 1000) for _ in range(300)))
    assert sum(1 for _ in archives.records(source)) == 300 and source.most == archives.BLOCK
