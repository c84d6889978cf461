"""Substring dedup over words: a merged count-min sketch screens the windows, an exact grouping settles the rest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sketches import BLOBS, Shape, bit_sets, blobs_of, in_all_rows, merged
from lodestone.llm.windows import Hashes, covered, gathered, stretches_of, word_codes
from lodestone.session import cut_lineage

#: Keys a task holds before it hands on a partial sketch.
HELD = 1 << 21


@dataclass(frozen=True)
class Repeats:
    """Words in a window, words in the anchor by which windows are counted, and the fixed size of the sketch."""
    length: int = 20
    anchor: int = 6
    shape: Shape = Shape()


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_twin`` (tells rows of one key apart by their text) and ``_text`` (null: empty)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_twin"), body.alias("_text"))


def _sketch(cfg: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            codes = (word_codes(t.as_py()) for t in batch.column("_text").cast(pa.large_binary()))
            for _, _, laid, ends in gathered(codes, cfg.length):
                held.append(stretches_of(laid, ends, cfg.length, cfg.anchor).anchor)
                n += len(held[-1])
                if n >= HELD:
                    yield blobs_of(np.concatenate(held), cfg.shape, salt)
                    held, n = [], 0
        if n:
            yield blobs_of(np.concatenate(held), cfg.shape, salt)

    return run


def _screened(cfg: Repeats, bits, with_windows: bool):
    """Stretches whose anchor the sketch counts twice or more; with the names of their windows if asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, twins = batch.column("_key"), batch.column("_twin")
            codes = (word_codes(t.as_py()) for t in batch.column("_text").cast(pa.large_binary()))
            for numbers, offsets, laid, ends in gathered(codes, cfg.length):
                found = stretches_of(laid, ends, cfg.length, cfg.anchor)
                keep = np.flatnonzero(in_all_rows(bits.value, found.anchor, cfg.shape))
                begins = np.concatenate(([0], ends[:-1]))
                part = found.sequence[keep]
                shift = np.array(offsets)[part] - begins[part] if len(keep) else np.zeros(0, np.int64)
                rows = pa.array(np.array(numbers)[part] if len(keep) else np.zeros(0, np.int64), pa.int64())
                low, high = found.low[keep], found.high[keep]
                columns = {
                    "_key": keys.take(rows), "_twin": twins.take(rows), "low": pa.array(low + shift, pa.int64()), "high": pa.array(high + shift, pa.int64()),
                    "lead": pa.array(found.at[keep] - low, pa.int64()), "anchor": pa.array(found.anchor[keep].view(np.int64), pa.int64()),
                    "whole": pa.array(found.whole[keep].view(np.int64), pa.int64()),
                }
                if with_windows:
                    sizes = high - low + 1
                    offset = np.concatenate(([0], np.cumsum(sizes)))
                    starts = np.arange(offset[-1]) - np.repeat(offset[:-1] - low, sizes)
                    names = Hashes(laid).of(starts, starts + cfg.length)
                    columns["names"] = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), pa.array(names.view(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def repeated_spans(rows: DataFrame, cfg: Repeats) -> DataFrame:
    """``(_key, _twin, low, high)``: windows starting at words low to high of a text also start earlier."""
    spark = rows.sparkSession
    sketch = merged(rows.select("_text").mapInArrow(_sketch(cfg), BLOBS))
    bits = spark.sparkContext.broadcast(bit_sets(sketch, cfg.shape, "twos"))
    kind = rows.select("_key").schema["_key"].dataType.simpleString()
    narrow = f"_key {kind}, _twin long, low long, high long, lead long, anchor long, whole long"
    screened = rows.mapInArrow(_screened(cfg, bits, False), narrow)
    named = rows.mapInArrow(_screened(cfg, bits, True), narrow + ", names array<long>")

    # stretches of equal words: all but the first go as a whole
    first = F.min(F.struct("_key", "low", "_twin", "high", "lead", "names")).alias("first")
    groups = cut_lineage(named.groupBy("anchor", "whole").agg(F.count("*").alias("n"), first))
    ahead = groups.where("n > 1").select("anchor", "whole", F.struct("first._key", "first.low").alias("_first"))
    later = screened.join(ahead, ["anchor", "whole"]).where(F.struct("_key", "low") > F.col("_first")).select("_key", "_twin", "low", "high")

    # an anchor in unequal stretches: the first of each kind is compared window by window
    unequal = groups.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    windows = (groups.join(unequal, "anchor").select("anchor", "first.*")
               .select("anchor", "_key", "_twin", "low", "lead", F.posexplode("names").alias("step", "name"))
               .select("anchor", "name", (F.col("lead") - F.col("step")).alias("place"), "_key", "_twin", (F.col("low") + F.col("step")).alias("start")))
    windows = cut_lineage(windows)
    firsts = (windows.groupBy("anchor", "name", "place").agg(F.count("*").alias("n"), F.min(F.struct("_key", "start")).alias("_first"))
              .where("n > 1").select("anchor", "name", "place", "_first"))
    single = (windows.join(firsts, ["anchor", "name", "place"]).where(F.struct("_key", "start") > F.col("_first"))
              .select("_key", "_twin", F.col("start").alias("low"), F.col("start").alias("high")))
    return later.unionByName(single)


def _cut(cfg: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(map(unpacked, batch.column("_packed").to_pylist()), batch.column("_spans"), strict=True):
                words = text.split()
                found = spans.as_py()
                n_words.append(len(words))
                gone = 0
                if found:
                    marks, _ = covered(len(words), ((s["low"], s["high"] + cfg.length) for s in found))
                    gone = int(marks.sum())
                    words = [w for w, m in zip(words, marks.tolist(), strict=True) if not m]
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, each behind its length: what a shuffle then writes is half as much."""
    for batch in batches:
        texts = batch.column("_text").cast(pa.large_binary())
        packed = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in (x.as_py() for x in texts)]
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_twin"), pa.array(packed, pa.binary())], ["_key", "_twin", "_packed"])


def unpacked(packed: bytes) -> bytes:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``(_key, _packed, _spans)``: each text with the list of its own spans or null; it has no more of them than windows."""
    own = spans.groupBy("_key", "_twin").agg(F.collect_list(F.struct("low", "high")).alias("_spans")).withColumnsRenamed({"_key": "_k", "_twin": "_t"})
    kind = rows.schema["_key"].dataType.simpleString()
    packed = rows.mapInArrow(_packed, f"_key {kind}, _twin long, _packed binary")
    return packed.join(own, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_twin") == F.col("_t")), "left").select("_key", "_packed", "_spans")


def without_repeats(docs: DataFrame, cfg: Repeats | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: each text without the words of windows that also start earlier.

    A window is ``cfg.length`` consecutive words of one text; earlier means a smaller key, or the same key and an
    earlier start.  Windows are judged on the input.  The kept words are joined by one space.

    A null key comes before all others.  Rows of one key are one document to the order: repeated rows start together, so
    neither gives way to the other.  Null, blank and short texts keep all their words; an empty table gives an empty
    result; other columns are ignored.
    """
    cfg = cfg or Repeats()
    rows = keyed(docs, key, text)
    joined = with_spans(rows, repeated_spans(rows, cfg))
    kind = rows.schema["_key"].dataType.simpleString()
    return joined.mapInArrow(_cut(cfg), f"doc_id {kind}, n_words long, n_removed long, kept string")
