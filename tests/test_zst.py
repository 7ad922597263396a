"""Files of zstd frames: frames that end anywhere, tasks, what is broken, and writes that fail."""

import os
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from plycast.sources import files, zst


def packed(text: bytes, cuts: list[int], checked: bool = True) -> bytes:
    ends = [0, *sorted(cuts), len(text)]
    return b"".join(zstandard.ZstdCompressor(write_checksum=checked).compress(text[a:b]) for a, b in zip(ends, ends[1:], strict=False))


def tasks(path, least=1):
    return zst.ZstReader(str(path), least).partitions()


def test_frames_that_end_anywhere(tmp_path):
    draw = random.Random(7)
    for n in range(150):
        text = "".join(draw.choice(["a", "bc", "é", "\n", "\n\n", "x" * 40]) for _ in range(draw.randrange(60))).encode()
        body = packed(text, [draw.randrange(len(text) + 1) for _ in range(draw.randrange(9))], n % 2 == 0)
        if n % 3 == 0:  # a skippable frame before or behind
            skipped = (0x184D2A53).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"12345"
            body = skipped + body if n % 2 else body + skipped
        path = tmp_path / f"{n}.zst"
        path.write_bytes(body)
        for least in (1, 30, 10**6):
            got = [line for t in tasks(path, least) for line in zst.lines(t)]
            assert got == (text.removesuffix(b"\n").split(b"\n") if text else [])


def test_a_task_for_each_frame(spark, tmp_path):
    rows = [f"row {k} " + "z" * (k % 300) for k in range(5000)]
    text = ("\n".join(rows) + "\n").encode()
    (tmp_path / "d.zst").write_bytes(packed(text, list(range(40_001, len(text), 40_001))))
    d = zst.read_lines(spark, str(tmp_path / "d.zst"))
    n = len(text) // 40_001 + 1
    assert d.rdd.getNumPartitions() == n > 15
    got = d.withColumn("task", F.spark_partition_id()).collect()
    assert [r.line for r in got] == rows and {r.task for r in got} == set(range(n))
    assert [r.line for r in got if r.first] == rows[:1]


def test_a_line_over_many_frames_and_large_blocks(tmp_path):
    text = b"a\n" + os.urandom(400_000).hex().encode() + b"\n" + b"\0" * 3_000_000 + b"\nend"
    (tmp_path / "l.zst").write_bytes(packed(text, list(range(0, len(text), 90_001))))
    assert [line for t in tasks(tmp_path / "l.zst") for line in zst.lines(t)] == text.split(b"\n")


def test_broken_files_are_errors(spark, tmp_path):
    body = packed(b"one\ntwo\n" * 1000, [4000])
    (tmp_path / "cut.zst").write_bytes(body[:-6])
    (tmp_path / "junk.zst").write_bytes(body + b"junk")
    (tmp_path / "empty.zst").write_bytes(b"")
    for name in ("cut", "junk"):
        with pytest.raises(Exception, match="cut off|no zstd frame"):
            zst.read_lines(spark, str(tmp_path / f"{name}.zst")).collect()
    with pytest.raises(Exception, match="none.zst"):
        zst.read_lines(spark, str(tmp_path / "none.zst")).collect()
    assert zst.read_lines(spark, str(tmp_path / "empty.zst")).count() == 0


def test_a_failed_write_leaves_no_row(spark, tmp_path):
    path, d = str(tmp_path / "out"), spark.range(0, 3000, 1, 3).select(F.format_string("line %d", "id").alias("x"))
    zst.append_lines(d, path, frame=999)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="stop"):
        zst.append_lines(d.select(F.when(F.col("x") == "line 2500", F.raise_error(F.lit("stop"))).otherwise(F.col("x")).alias("x")), path)
    assert sorted(os.listdir(path)) == before and len(before) == 3
    zst.append_lines(d, path)
    got = zst.read_lines(spark, path).groupBy("line").count().collect()
    assert len(got) == 3000 and {r["count"] for r in got} == {2}


def test_puzzles_there_and_back(spark, tmp_path):
    path = str(tmp_path / "p.zst")
    rows = [(f"p{k}", None if k % 7 == 0 else 'a "b", c', "e2e4", "1500", "75", "95", "8", "pin fork", "u", "") for k in range(500)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in files.PUZZLE_NAMES.values()))
    files.write_puzzles_zst(d.repartition(2), path, 700)
    got = files.read_puzzles(spark, path)
    assert got.columns == d.columns and got.rdd.getNumPartitions() > 20
    assert sorted(map(repr, got.na.fill("").collect())) == sorted(map(repr, d.na.fill("").collect()))
