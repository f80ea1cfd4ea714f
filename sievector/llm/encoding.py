"""Byte-level BPE over tables: a lexicon of the corpus's frequent words, ids of every text, and texts of the ids.

One pass counts words, the driver compiles the most frequent into the automaton, a second pass encodes and decodes.

Defined cases: null is the empty text, which has no ids; a very long text is encoded whole, and a very long word by a heap;
repeated rows give equal rows; only the named text column and the key are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievector.llm import lexicon
from sievector.llm.batch_encoder import LexiconEncoder, parts_of
from sievector.llm.batches import arrow_map, pieces
from sievector.llm.subwords import PATTERN, REMEMBERED, Vocabulary, encoder_of, frequent
from sievector.plans.staging import fresh_path, stage


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, words as the splitting pattern cuts them; each distinct part of a batch is cut once."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = regex.compile(PATTERN).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in pieces(batches):
            distinct, code, heads, _ = parts_of(pc.fill_null(batch.column(0), ""))
            first = np.bincount(code[heads], minlength=len(distinct))
            later = np.bincount(code, minlength=len(distinct)) - first
            for part, a, b in zip(distinct, first.tolist(), later.tolist()):
                for n, text in ((a, part), (b, " " + part)):
                    if n:
                        for w in split(text):
                            held[w] += n
            if len(held) > REMEMBERED:
                yield flush()
        yield flush()

    return arrow_map(docs.select("text"), body, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def put_file(spark: SparkSession, data: bytes, tag: str) -> str:
    """Write ``data`` to the shared folder and hand it to every executor; returns its name for ``SparkFiles.get``."""
    path = fresh_path(spark, tag)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def compile_lexicon(spark: SparkSession, counts: DataFrame, vocabulary: Vocabulary, size: int) -> str:
    """The automaton of the most frequent words, at most ``size``, as a file on all executors."""
    top = frequent(stage(counts, "words"), "n", size).collect()
    entries = {r["word"].encode(): vocabulary.merge(r["word"].encode()) for r in top}
    return put_file(spark, lexicon.to_bytes(lexicon.build(entries)), "lexicon")


def encode(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", lexicon_words: int = 40_000) -> DataFrame:
    """(key, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text that they stand for.

    ``lexicon_words`` bounds what the driver and each executor hold, not what is encoded.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(vocabulary_path)
    name = compile_lexicon(spark, count_words(docs), vocabulary, lexicon_words)
    shared = spark.sparkContext.broadcast((vocabulary.tokens, vocabulary.ranks, vocabulary.special))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(name, lambda: LexiconEncoder(Vocabulary(*shared.value), lexicon.Lexicon(SparkFiles.get(name))))
        token = shared.value[0].__getitem__
        for batch in pieces(batches):
            ids, sizes = encoder.encode(batch.column(1))
            own = np.split(ids, np.cumsum(sizes)[:-1])
            texts = [b"".join(map(token, x.tolist())).decode("utf-8", "replace") for x in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()), pa.array(texts, pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), "text"), body, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)
