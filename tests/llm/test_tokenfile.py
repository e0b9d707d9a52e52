import io
import tempfile
import zlib

import numpy as np
import pytest

from linewise.llm.tokenfile import PlaneReader, PlaneWriter, from_planes, read_tokens, to_planes, write_tokens
from linewise.llm.tokens import PieceEncoder


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("top", [1, 2, 300, 70_000, 2**32])
def test_planes_round_trip(bits, top):
    ids = np.random.default_rng(1).integers(0, top, 1003).astype(np.uint32)
    planes = to_planes(ids, bits)
    assert len(planes) <= (32 if bits else 4)
    assert np.array_equal(from_planes(planes, len(ids), bits), ids)


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits):
    rng, out = np.random.default_rng(2), io.BytesIO()
    lists = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 1, 7, 64, 65, 1000, 3)]
    w = PlaneWriter(out, chunk_ids=64, bits=bits)
    for i, ids in enumerate(lists):
        w.add(None if i == 2 else i, ids.tobytes())
    assert w.close() == len(out.getvalue())
    r = PlaneReader(out)
    assert [d[0] for d in r.documents()] == [0, 1, None, 3, 4, 5, 6]
    want = [(len(x), zlib.crc32(x.tobytes())) for x in lists]
    assert [d[2:] for d in PlaneReader(out).documents()] == want
    assert [d[1] for d in r.documents()] == [0, 0, 1, 8, 72, 137, 1137]
    for first in range(8):
        for last in range(first, 8):
            assert [d[2:] for d in r.documents(first, last)] == want[first:last]
    flat = np.concatenate(lists)
    assert np.array_equal(r.chunk(3), flat[192:256])  # one chunk alone


@pytest.mark.parametrize("bits", [False, True])
def test_write_and_read(spark, odd, bits):
    folder = tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")
    files = write_tokens(odd, folder, chunk_ids=1000, bits=bits)
    got = read_tokens(files).orderBy("start").collect()
    tok = PieceEncoder().tok
    want = sorted(((r.doc_id, (tok.encode(r.text, add_special_tokens=False).ids if r.text else []) + [1])
                   for r in odd.select("doc_id", "text").collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (d or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want)
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_empty(empty):
    files = write_tokens(empty, tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp"))
    assert files.count() == 0 and read_tokens(files).count() == 0


def test_files_and_long_files_are_read_in_several_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"some words {i} of document {i % 7} " * (1 + i % 5)) for i in range(300)],
                               "doc_id bigint, text string")
    folder = tempfile.mkdtemp(prefix="linewise-test-", dir="/tmp")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = write_tokens(df, folder, chunk_ids=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = files.count()
    assert n > 1
    one = sorted(map(tuple, read_tokens(files).collect()))
    tasks = read_tokens(files).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == n
    split = read_tokens(files, unit_ids=500)
    assert split.select(F.spark_partition_id().alias("p")).distinct().count() > 2 * n
    assert sorted(map(tuple, split.collect())) == one
    assert [r[1] for r in one] == [sum(x[2] for x in one[:i]) for i in range(len(one))]
