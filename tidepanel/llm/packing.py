"""Conflict-constrained best-fit packing of documents into sequences of fixed length."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, folded

CAPACITY = 2048
GROUP_ROWS, GROUP_BYTES = 4096, 16 << 20


def best_fit(items: Iterable[tuple[int, ...]], capacity: int, per_source: int = 2) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster or clusters), in the order given; sizes are 1 to ``capacity``.

    Open bins stand in order of (room left, number).  An item goes to the first bin from its size upwards that
    is compatible: its bitmap of duplicate clusters lacks all the item's, and its bitmap of sources that have
    reached ``per_source`` documents lacks the item's.  The successor search goes on until such a bin is found,
    over all bins if need be; without one a new bin opens.
    """
    order: list[tuple[int, int]] = []
    clusters, sources, counts, used, out = [], [], [], [], []
    for size, source, *own in items:
        k = bisect_left(order, (size, -1))
        s, c = 1 << source, sum(1 << x for x in own)
        while k < len(order) and (clusters[b := order[k][1]] & c or sources[b] & s):
            k += 1
        if k < len(order):
            b = order.pop(k)[1]
        else:
            b = len(used)
            clusters.append(0), sources.append(0), counts.append({}), used.append(0)
        out.append((b, used[b]))
        used[b] += size
        clusters[b] |= c
        n = counts[b][source] = counts[b].get(source, 0) + 1
        if n >= per_source:
            sources[b] |= s
        if used[b] < capacity:
            insort(order, (capacity - used[b], b))
    return out


def pieces(text: str, n: int, capacity: int) -> list[str]:
    """``text`` cut before every ``capacity``-th word; joined they are the text."""
    if n <= capacity:
        return [text]
    at = [m.start() for i, m in enumerate(re.finditer(WORD, text)) if i and i % capacity == 0]
    return [text[a:b] for a, b in zip([0, *at], [*at, None])]


def dup_cluster(text: Column) -> Column:
    """Texts equal but for case and white space share a cluster."""
    return F.xxhash64(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _numbered(values: pa.ChunkedArray) -> list[int]:
    """A number for each different value, null being one."""
    return values.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, per_source: int = 2, with_text: bool = True, cluster: Column | None = None) -> DataFrame:
    """Every document's words in bins of ``capacity`` words: doc_id, piece, n_words, bin_id, slot, offset (, text).

    Longer documents are cut into pieces of ``capacity`` words and a rest; joined by piece they are the text.
    A bin has no two pieces of one duplicate cluster (``cluster``, by default texts equal but for case and white space;
    near copies are told by a cluster column of theirs) nor of one doc_id, and at most ``per_source`` of a source.  Rows
    are dealt by a hash of id and text over packing groups of about 4096 rows or 16 MB, so a hot source or
    cluster is spread evenly and a group is packed in one task's memory; in a group pieces go largest first
    (ties by id, text hash and piece), so reruns agree.  A row repeated over 4096 times is counted and its copies dealt 64 to
    a group; they don't share bins.  bin_id is "group-bin", slot the place in the bin from 0, offset its first word.

    Documents without words (null or empty text) take no room: bin_id, slot and offset are null.  Null
    sources are one source; null ids are no conflict.  Other columns aren't read, whatever their names.  A text of
    any length is one row of one group.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select("doc_id", F.col("source").cast("string").alias("source"), text.alias("text"), *([] if cluster is None else [cluster.alias("cluster")]))
    n, size = raw.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    groups = max(1, -(-n // GROUP_ROWS), -(-(size or 0) // GROUP_BYTES))
    rows = folded(raw).select("row.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
    deal = F.pmod(F.xxhash64("doc_id", "text", F.floor(F.col("copy") / 64)), F.lit(groups)).alias("g")
    rows = rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("int").alias("n"), (dup_cluster(F.col("text")) if cluster is None else F.col("cluster")).alias("cluster"), F.xxhash64("text").alias("th"), *(["text"] if with_text else []), deal)

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("bin_id", T.StringType()), T.StructField("slot", T.IntegerType()), T.StructField("offset", T.IntegerType())]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))

    def pack(rows: pa.Table) -> pa.Table:
        # ids stay in Arrow: pandas makes doubles of whole numbers beside a null
        rows = rows.take(pc.sort_indices(rows, [("doc_id", "ascending"), ("th", "ascending")], null_placement="at_start")).combine_chunks()
        sources, clusters, ids = (_numbered(rows[c]) for c in ("source", "cluster", "doc_id"))
        words = rows["n"].to_pylist()
        # a document's bit is beyond those of all clusters; without an id there is none
        above = max(clusters, default=0) + 1
        nameless = rows["doc_id"].is_null().to_pylist()
        own = [[c] if none else [c, above + d] for c, d, none in zip(clusters, ids, nameless)]
        parts = []  # (-size, row, piece)
        for row, left in enumerate(words):
            k = 0
            while left > 0:
                parts.append((-min(left, capacity), row, k))
                left, k = left - capacity, k + 1
        parts.sort()
        where = best_fit(((-size, sources[row], *own[row]) for size, row, _ in parts), capacity, per_source)
        g, slots, out = rows["g"][0].as_py() if len(rows) else 0, {}, []
        for (size, row, k), (b, at) in zip(parts, where):
            slots[b] = slot = slots.get(b, -1) + 1
            out.append((row, k, -size, f"{g}-{b}", slot, at))
        out += [(row, 0, 0, None, None, None) for row, n in enumerate(words) if n == 0]
        at, piece, *rest = zip(*out) if out else ((), (), (), (), (), ())
        made = [rows["doc_id"].take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
        made += [pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.string(), pa.int32(), pa.int32()))]
        if with_text:
            texts = rows["text"].to_pylist()
            cut = {row: pieces(texts[row], n, capacity) for row, n in enumerate(words) if n > capacity}
            made.append(pa.array([cut[r][k] if r in cut else texts[r] for r, k in zip(at, piece)], pa.string()))
        return pa.Table.from_arrays(made, [f.name for f in fields])

    return rows.groupBy("g").applyInArrow(pack, T.StructType(fields))


def op5_packing(docs: DataFrame) -> DataFrame:
    """doc_id, piece, n_words, bin_id, slot and offset of all pieces of ``docs``; edge cases as in :func:`pack_documents`."""
    return pack_documents(docs, with_text=False)
