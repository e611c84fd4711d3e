"""The fingerprint index batch by batch against brute force."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import fingerprint_index, repeats
from tests.llm.test_operators import SCHEMA, WORD, brute, corpus


@pytest.mark.parametrize("compacted", [False, True])
def test_each_batch_is_verified_against_earlier_runs(spark, compacted):
    rows = corpus()
    # batches by place: copies and shared passages of the first texts lie in different batches
    part = {i: k % 3 for k, (i, *_) in enumerate(rows)}
    index, ranges, seen, later = fingerprint_index.FingerprintIndex(spark), {}, {}, 0
    for b in range(3):
        mine = [r for r in rows if part[r[0]] == b]
        base = repeats.keyed(spark.createDataFrame(mine, SCHEMA))
        for r in index.add(base, repeats.anchors(base, repeats.WORDS)).collect():
            ranges.setdefault(r.doc, []).append((r.first, r.last))
        seen |= {i: tuple(WORD.findall(t or "")) for i, t, *_ in mine}
        for i, gone in brute(seen, 35).items():
            got = [False] * len(gone)
            for first, last in ranges.get(i, []):
                end = min(last, len(got) - 35) + 35
                got[first:end] = [True] * max(0, end - first)
            assert got == gone, (b, i)
            later += b > 0 and sum(gone) > 0
        if compacted:
            index.compact()
    assert later > 5 and len(index.runs) == (1 if compacted else 3)
