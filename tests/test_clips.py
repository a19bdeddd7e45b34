"""Clips over blocks against the plain recursion, for hot sequences and blocks of every size."""

import random

import pytest

from tracklens.operators import clips

SCHEMA = "seq bigint, start bigint, ttc double"


def plain(values, step, ratio):
    out, last = [], None
    for p in values:
        if p is not None and last is not None:
            low, high = (last / step, last * step) if ratio else (last - step, last + step)
            p = max(low, min(high, p))
        out.append(p)
        last = p
    return out


def walk(rng, n, nulls):
    x, out = 5.0, []
    for _ in range(n):
        x = max(0.1, x + rng.gauss(0, 2)) if rng.random() < 0.9 else rng.uniform(0.1, 40)
        out.append(None if rng.random() < nulls else x)
    return out


@pytest.mark.parametrize("step, ratio", [(0.01, False), (1.0, False), (1.02, True), (1.5, True)])
def test_maps_of_blocks_send_every_value_as_the_recursion(step, ratio):
    rng = random.Random(9)
    for n in (1, 2, 5, 40):
        for nulls in (0.0, 0.2):
            values = walk(rng, n, nulls)
            steps = clips.Steps(step, ratio)
            for v in values:
                steps.add(v)
            block = {k: getattr(steps, k) for k in ("fresh", "cut", "xs", "ys", "left", "right")}
            for before in [None, 0.001, 0.5, 3.0, 7.5, 100.0, *[rng.uniform(0.1, 20) for _ in range(20)]]:
                start = [] if before is None else [before]
                want = plain([*start, *values], step, ratio)[-1]
                got = clips.through(block, before)
                assert got == (None if want is None else pytest.approx(want, rel=1e-9)), (n, before)
            assert len(steps.xs) <= 2 * n + 1


@pytest.mark.parametrize("step, ratio, rows", [(0.05, False, 7), (1.0, False, 1024), (1.01, True, 50)])
def test_hot_sequence(spark, step, ratio, rows):
    """One sequence holds nearly all rows; it is clipped over many partitions and blocks."""
    rng = random.Random(10)
    sequences = {1: walk(rng, 6000, 0.0), 2: walk(rng, 30, 0.3), 3: [None, 2.0], 4: [None]}
    table = [(s, k * 3, v) for s, values in sequences.items() for k, v in enumerate(values)]
    rng.shuffle(table)
    got = {}
    for r in clips.recursive_clip(spark.createDataFrame(table, SCHEMA).repartition(6), step, ratio, rows=rows).collect():
        got[r["seq"], r["start"]] = r["smooth"]
    assert len(got) == len(table)
    for s, values in sequences.items():
        for k, want in enumerate(plain(values, step, ratio)):
            assert got[s, k * 3] == (None if want is None else pytest.approx(want, rel=1e-9)), (s, k)


def test_empty_and_refused(spark):
    assert clips.recursive_clip(spark.createDataFrame([], SCHEMA), 1.0).count() == 0
    with pytest.raises(Exception, match="positive"):
        clips.recursive_clip(spark.createDataFrame([(1, 0, 1.0), (1, 1, -1.0)], SCHEMA), 1.5, ratio=True).collect()
