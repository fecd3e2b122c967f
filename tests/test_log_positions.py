"""S10 / ST1: logs that grow, are truncated and are rotated, read from their last positions."""

import os
import random

from skuflow.sources import log_files, ranges
from skuflow.streaming import logs as sl


def put(root, name, data, mode="ab"):
    os.makedirs(os.path.dirname(f"{root}/log_name={name}"), exist_ok=True)
    os.makedirs(f"{root}/log_name={name}", exist_ok=True)
    with open(f"{root}/log_name={name}/{name}.log", mode) as f:
        f.write(data)


def scan(spark, root, old, **more):
    lines, new = log_files.read_new_lines(spark, root, old, **more)
    return sorted((r.log_name, r.line) for r in lines.collect()), new


def test_lines_of_ranges_are_each_read_once(tmp):
    rng = random.Random(2)
    data = b"\n".join(bytes(rng.choices(b"ab\r", k=rng.choice([0, 1, 5, 40]))) for _ in range(200))
    for tail in (b"", b"\n"):
        with open(f"{tmp}/f", "wb") as f:
            f.write(data + tail)
        size = len(data + tail)
        want, at = [], 0
        for line in (data + tail).split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        want = want[:-1] if not want[-1][1] else want
        for step in (1, 2, 7, 100, 10 ** 6):
            got = [x for lo in range(0, size, step) for x in ranges.lines(f"{tmp}/f", lo, min(lo + step, size))]
            assert got == want


def test_positions_append_truncate_rotate(spark, tmp):
    root = f"{tmp}/logs"
    assert scan(spark, root, None) == ([], {})
    put(root, "app", b"one\ntwo\npart")
    put(root, "db", b"x\r\n" * 3)
    got, at = scan(spark, root, None, split_bytes=3)
    assert got == [("app", "one"), ("app", "two")] + [("db", "x")] * 3
    assert scan(spark, root, at)[0] == []
    put(root, "app", b"ly written\n")
    got, at = scan(spark, root, at)
    assert got == [("app", "partly written")]
    put(root, "app", b"new\n", "wb")                       # truncated: shorter than its position
    put(root, "db", b"rotated and longer than before\n", "wb")     # other first bytes
    got, at = scan(spark, root, at)
    assert got == [("app", "new"), ("db", "rotated and longer than before")]
    os.remove(f"{root}/log_name=app/app.log")
    got, at = scan(spark, root, at)
    assert got == [] and len(at) == 1
    put(root, "app", b"new\n")
    assert scan(spark, root, at)[0] == [("app", "new")]


def test_stream_resumes_inside_files(spark, tmp):
    root, sink, ck = f"{tmp}/logs", f"{tmp}/sink", f"{tmp}/ck"

    def run():
        sl.run_error_monitor(spark, root, sink, ck, "2024-01-02 00:00:00")
        return sorted((r.log_name, r.line) for r in spark.read.parquet(sink).collect())

    put(root, "app", b"2024-01-01 10:00:00 ERROR a\nfine\n2023-01-01 10:00:00 ERROR old\n")
    want = [("app", "2024-01-01 10:00:00 ERROR a")]
    assert run() == want
    put(root, "app", b"ERROR b\n")
    put(root, "db", b"Traceback\n")
    want += [("app", "ERROR b"), ("db", "Traceback")]
    assert run() == sorted(want)
    assert run() == sorted(want)
    put(root, "app", b"ERROR c\n", "wb")
    put(root, "db", b"a new file ERROR, longer\n", "wb")
    want += [("app", "ERROR c"), ("db", "a new file ERROR, longer")]
    assert run() == sorted(want)
