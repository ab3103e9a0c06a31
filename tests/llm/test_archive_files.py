import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernel.llm import warc


def test_files_are_read_by_their_sidecars(spark, tmp_path):
    rows = [(i, f"http://a/{i}", "p" * 1500 if i % 3 else f"page {i} é" * (i * 7)) for i in range(1, 60)] + [(None, None, None), (77, "u", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("name", "offset", "payload", "record_type")}).repartition(3)
    first, second = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    files = warc.write_files(warc.classified(pages), first, file_bytes=20_000).cache()
    made = warc.normalise_files(files, first, second).cache()
    assert files.count() == made.count() > 3 and made.agg(F.sum("records")).first()[0] == len(rows)
    for f in files.collect():  # one stream each
        z = zlib.decompressobj(31)
        z.decompress((tmp_path / "a" / f"{f.name}.warc.gz").read_bytes())
        assert z.eof and not z.unused_data
    (tmp_path / "b" / "0abc.idx").write_text("<urn:left:behind> 0 10\n")  # no finished task reported it
    got = warc.read_files(made, second).collect()
    want = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows)
    for g in got:
        repeated = g.page_id is not None and g.page_id % 3 and g.page_id not in (59, 77)
        assert (g.record_type, g.refers_to) == (("revisit", 59) if repeated else ("response", None))
        assert g.payload_bytes == len(want[g.page_id]) and (repeated or bytes(g.payload) == want[g.page_id])
    name = made.where("records > 2").first().name
    line = (tmp_path / "b" / f"{name}.idx").read_text().splitlines()[1].split()
    data = (tmp_path / "b" / f"{name}.warc.gz").read_bytes()[int(line[1]) :][: int(line[2])]
    assert line[0].encode() in zlib.decompress(data, 31)
    assert not list(tmp_path.glob("*/*.part-*"))


def test_a_store_without_files_takes_rows(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000)], "page_id long, url string, html string")
    with_files = sorted(map(tuple, warc.round_trip(pages).collect()))
    with pytest.raises((warc.pa.ArrowInvalid, OSError)):
        warc.store_of("viewfs://store/x")
    def unknown(folder):
        raise warc.pa.ArrowInvalid("unknown scheme")

    monkeypatch.setattr(warc, "store_of", unknown)
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == with_files and with_files[0][3:] == ("revisit", 2)


MEMORY = """
import resource, sys, zlib
sys.path.insert(0, sys.argv[1])
from quernel.llm import warc
def archive():
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    for i in range(300):
        yield z.compress(warc.record(i, "u", bytes([i % 256]) * (1 << 20), "response", None))
    yield z.flush()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(1 for _ in warc.members(archive()))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_a_large_archive_is_a_stream():
    """300 MB in one gzip stream, normalised in a few megabytes."""
    out = subprocess.run([sys.executable, "-c", MEMORY, str(Path(__file__).parents[2])], capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) == 300 and int(out[1]) < 40, out
