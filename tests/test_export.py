"""Training samples against plain numpy; skipped intervals; the resumable sink."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import export
from tracklens.sources import sinks

INTERVALS = "seq bigint, idx bigint, rx0 bigint, ry0 bigint, rx1 bigint, ry1 bigint, hi bigint, truth double, truth_status string"
EVENTS = "seq bigint, idx bigint, x int, y int, t_us bigint, p int, hi bigint, rx0 bigint, ry0 bigint, rx1 bigint, ry1 bigint, x1 double, y1 double, x2 double, y2 double"


def make(spark, n=40):
    rng = np.random.default_rng(2)
    spans = [(1, 0, 2, 3, 9, 14, 1000, 1.5, "OK"), (1, 1, 0, 0, 1, 1, 2000, 2.0, "OK"), (1, 2, 0, 0, 5, 5, 1000, None, "OUT_OF_RANGE"), (1, 3, 0, 0, 5, 5, 1000, -1.0, "OK"), (2, 0, 4, 4, 4, 9, 500, 3.0, "OK"), (3, 0, 5, 5, 9, 9, 500, 3.0, "OK")]
    rows = []
    for seq, idx, x0, y0, x1, y1, hi, *_ in spans[:2]:
        rows += [(seq, idx, int(rng.integers(x0, x1)), int(rng.integers(y0, y1)), int(rng.integers(0, hi)), int(rng.integers(0, 2)), hi, x0, y0, x1, y1, 0.0, 0.0, 1.0, 1.0) for _ in range(n)]
    return export.judged(spark.createDataFrame(spans, INTERVALS)), spark.createDataFrame(rows, EVENTS), spans, rows


def plain(span, rows, taus, height, width, split):
    seq, idx, x0, y0, x1, y1, hi, *_ = span
    out = []
    for tau in taus:
        kinds = []
        for sign in (1, 0) if split else (None,):
            count, last = np.zeros((y1 - y0, x1 - x0)), np.full((y1 - y0, x1 - x0), -1.0)
            for r in rows:
                if r[:2] == (seq, idx) and (sign is None or r[5] == sign):
                    count[r[3] - y0, r[2] - x0] += 1
                    last[r[3] - y0, r[2] - x0] = max(last[r[3] - y0, r[2] - x0], r[4])
            kinds.append((np.where(count > 0, np.exp(-(hi - last) / tau), 0), np.log1p(count), (count > 0) * 1.0))
        for c in range(3):
            for kind in kinds:
                a = kind[c][np.linspace(0, y1 - y0 - 1, height).astype(int)][:, np.linspace(0, x1 - x0 - 1, width).astype(int)]
                out.append(a)
    return np.stack(out)


@pytest.mark.parametrize("taus, split", [([300], False), ([300], True), ([300, 50], True)])
def test_images_against_numpy(spark, taus, split):
    judged, rows, spans, plain_rows = make(spark)
    good = judged.where("reason IS NULL")
    got = {(r["seq"], r["idx"]): np.array(r["image"]) for r in export.images(good, rows, taus, 6, 5, split).collect()}
    assert set(got) == {(1, 0), (1, 1), (3, 0)} and not got[3, 0].any()
    for span in spans[:2]:
        want = plain(span, plain_rows, taus, 6, 5, split)
        assert got[span[:2]] == pytest.approx(want.ravel()) and want.shape[0] == 3 * (1 + split) * len(taus)


def test_samples_skips_and_summary(spark):
    judged, rows, *_ = make(spark)
    got = {(r["seq"], r["idx"]): r for r in export.samples(judged, rows, 300, 4, 4).collect()}
    assert set(got) == {(1, 0), (1, 1), (3, 0)}
    r = got[1, 0]
    assert len(r["image"]) == 48 and len(r["stats"]) == 27 and r["metadata"][:4] == [11, 7, 77, 40] and r["gt_log"] == pytest.approx(math.log(1.5))
    assert {(r["seq"], r["idx"]) for r in export.samples(judged, rows, 300, 4, 4, most=1).collect()} == {(1, 0), (3, 0)}
    assert sorted(tuple(r) for r in export.skips(judged).collect()) == [(1, 2, "INVALID_GT", "OUT_OF_RANGE"), (1, 3, "EXPORT_FAIL", "truth is not positive"), (2, 0, "EXPORT_FAIL", "region is empty")]
    assert {r["seq"]: tuple(r)[1:] for r in export.summary(judged).collect()} == {1: (2, 2, 1, 1), 2: (0, 1, 0, 1), 3: (1, 0, 0, 0), None: (3, 3, 1, 2)}
    for bad in ([], [0]):
        with pytest.raises(ValueError):
            export.images(judged, rows, bad, 4, 4)
    with pytest.raises(ValueError):
        export.images(judged, rows, [1], 1 << 20, 4)


def test_sink_resumes_and_refuses_sequences_without_samples(spark, tmp_path):
    judged, rows, *_ = make(spark)
    found, path = export.samples(judged, rows, 300, 4, 4), str(tmp_path / "samples")
    with pytest.raises(ValueError, match="2"):
        sinks.write_samples(found, judged, path)
    sinks.write_samples(found.where("seq = 1"), judged.where("seq = 1"), path)
    sinks.write_samples(found.withColumn("gt_ttc", F.lit(0.0)), judged.where("seq IN (1, 3)"), path)  # only sequence 3 is left
    back = spark.read.parquet(path)
    assert dict(back.dtypes)["image"] == "array<float>"
    assert {(r["seq"], r["idx"]): r["gt_ttc"] for r in back.collect()} == {(1, 0): 1.5, (1, 1): 2.0, (3, 0): 0.0}
