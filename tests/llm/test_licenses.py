"""License scans: every rule alone, and acronyms with joined versions."""

import re

from tracklens.llm import licenses


def labels(spark, texts):
    df = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"])
    return [(r["labels"], r["score"]) for r in df.orderBy("doc_id").collect()]


def test_acronyms_pass_the_gate_and_open_windows(spark):
    want = {"Released under the MPL 2.0": "mpl-2.0", "EPL 2.0": "epl-2.0", "CDDL 1.0": "cddl-1.0", "EUPL 1.2": "eupl-1.2", "see GPLv3 for": "gpl-3.0", "LGPLv2.1": "lgpl-2.1", "AGPLv3": "agpl-3.0", "MPL2.0": "mpl-2.0", "GPL3": "gpl-3.0"}
    for (text, label), (found, score) in zip(want.items(), labels(spark, list(want)), strict=True):
        assert label in found and score > 0, text
    assert labels(spark, ["simple words of a new house"]) == [([], 0.0)]


def test_examples_of_every_rule_are_detected_alone(spark):
    rows = []
    for rule in licenses.rules():
        every = sorted(licenses.examples(rule.pattern.removeprefix("^(?:").removesuffix(")(?= |$)")), key=lambda x: (len(x), x))
        assert all(re.search(licenses.gate(), x) and re.search(rule.pattern, x) and x.split(" ")[0] in rule.first and len(x.split(" ")) <= licenses.WINDOW for x in every), rule
        rows += [(rule, x) for x in dict.fromkeys((every[0], every[len(every) // 2], every[-1]))]
    for (rule, text), (found, score) in zip(rows, labels(spark, [x for _, x in rows]), strict=True):
        assert rule.label in found and score > 0, (rule.rule, text)
