import os
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievector.llm import training_order as t
from sievector.plans.staging import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = t.Permutation(n, 17)
    slots = p.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (p.number(slots) == np.arange(n)).all()
    if n > 100:
        assert (slots != t.Permutation(n, 18).slot(np.arange(n))).mean() > 0.9


def test_shards(spark, odd, clashing, documents):
    library = Tokenizer.from_file(PATH)
    for docs, length, per_shard in ((odd, 16, 8), (clashing, 64, 1000), (documents, 512, 64)):
        folder = fresh_path(spark, "test")
        rows = t.materialise(docs, PATH, 17, length, per_shard, folder=folder).collect()
        stride, last = 2 + 2 * length, (len(rows) - 1) // per_shard
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        read = list(t.read(folder, 0, 10**9, length, per_shard))
        assert len(read) == len(rows)
        by = {}
        for r in rows:
            ids = read[r["slot"]]
            assert len(ids) == r["n"] and zlib.crc32(ids.astype("<u2").tobytes()) == r["ids_crc32"]
            assert (r["shard"], r["offset"]) == (r["slot"] // per_shard, r["slot"] % per_shard * stride) and r["path"].endswith(f"shard-{r['shard']:08d}.bin")
            by.setdefault(r["doc_id"], []).append((r["part"], ids.tolist()))
        for name in {r["path"] for r in rows}:  # full, but for the last
            size = os.path.getsize(name.removeprefix("file://"))
            assert size == stride * per_shard or name.endswith(f"shard-{last:08d}.bin") and size == stride * ((len(rows) - 1) % per_shard + 1)
        for d in docs.collect():
            ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [50256]
            for k in range(0, len(ids), length):
                assert (k // length, ids[k : k + length]) in by[d["doc_id"]]
        # a reader that resumes gets the same rows, over the end of a shard too
        for at in (len(rows) // 2, per_shard - 1, len(rows) - 1, len(rows)):
            assert [x.tolist() for x in t.read(folder, at, 3, length, per_shard)] == [x.tolist() for x in read[at : at + 3]]


def test_slot_is_the_image(spark, documents):
    """Of the sequence's number in the order of the table."""
    docs = documents.coalesce(1).where("doc_id < 60")
    rows = t.materialise(docs, PATH, 5, 64, 100).collect()
    place = {d["doc_id"]: i for i, d in enumerate(docs.collect())}
    order = t.Permutation(len(rows), 5)
    for number, r in enumerate(sorted(rows, key=lambda r: (place[r["doc_id"]], r["part"]))):
        assert r["slot"] == order.slot(np.array([number]))[0]


def test_input_that_is_not_files(spark, documents):
    """After a shuffle or a draw, what is read twice is a staged copy."""
    for docs in (documents.repartition(7), documents.join(documents.select("doc_id").distinct(), "doc_id"), documents.orderBy(F.rand())):
        rows = t.materialise(docs, PATH, 17, 512, 64).collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents.collect()} and sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert t.steady(documents) is documents


def test_empty_table(none):
    assert t.materialise(none, PATH).count() == 0
