"""What SimHash links is compared by the near-dedup stage's exact likeness, whatever the pieces find."""

import numpy as np
import pyarrow as pa

from quillspark.llm import near, simhash, textkit


def test_links_of_fingerprints_are_compared(spark, monkeypatch):
    random = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in random.integers(0, 100000, n)]
    long = word(5000)
    phrase = ["x", "y", "z"] * 60
    texts = {1: long, 2: [*long[:-1], "other"], 3: phrase + word(30), 4: phrase + word(30), 5: word(200)}
    texts = {k: " ".join(v) for k, v in texts.items()}
    prints = dict(zip(texts, simhash.simhashes(*textkit.utf8(pa.array(list(texts.values()), pa.large_string()))), strict=True))
    assert (prints[1] ^ prints[2]).bit_count() <= simhash.BITS and prints[3] == prints[4]
    entries = near.entries

    def blind(buf, off, size=near.SHINGLE):
        return [entries(buf, off, size)[0], pa.array([[]] * (len(off) - 1), pa.list_(pa.int64()))]

    monkeypatch.setattr(near, "entries", blind)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert sorted(r[0] for r in simhash.stage(spark, docs, "").select("doc_id").collect()) == [1, 3, 4, 5]
