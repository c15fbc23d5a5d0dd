"""Removing long byte strings that occur more than once, by suffix sorting bucket by bucket with difference-cover ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches

DEPTH = 400  # bytes that two suffixes must share
ANCHOR = 100  # bytes that name a bucket
MODULUS, COVER = 7, (0, 1, 3)  # every residue mod 7 is a difference of two of these
DOUBLED = 224  # bytes that one set of cover ranks stands for: MODULUS times a power of 2, over half of DEPTH less MODULUS
SLICE = 1 << 22  # bytes of a text looked at together
BLOCK = 2 << 20  # bytes of segments that a task sorts together, the last bucket aside
HOT = 2048  # distinct segments of a bucket above which its suffixes are grouped by the cluster, not sorted in a task
_RNG = np.random.default_rng(400)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b), np.uint64)]), dtype=np.uint64) for b in (_B, pow(_B, -1, 2**64)))
    return _POWERS[size]


class Prints:
    """Names for the windows of a byte string: a polynomial hash mod 2^64 by prefix sums, then mixed."""

    def __init__(self, data: np.ndarray):
        self.p, self.q = _powers(len(data))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * self.p[: len(data)], dtype=np.uint64)])

    def windows(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.q[: len(self.sums) - size] + np.uint64(size))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, count, anchor, name): runs of suffixes of ``data`` that have one anchor, in order.

    The anchor of a suffix is the leftmost least ANCHOR-byte window in its first DEPTH bytes, so it depends on
    those bytes alone: two suffixes that share DEPTH bytes have equal names at equal distances.
    """
    span, n = DEPTH - ANCHOR + 1, len(data) - DEPTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    name = Prints(data).windows(ANCHOR)
    low = np.uint64(0xFFFFFF)
    v = (name & ~low) | np.arange(len(name), dtype=np.uint64)
    # minimum of each run of span values: suffix minimum of one block, prefix minimum of the next
    pad = np.concatenate([v, np.full(-len(v) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & low).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return start, np.diff(np.concatenate([start, [n]])), anchor[start], name[anchor[start]]


def slices(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    a = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(a) - DEPTH + 1), SLICE):
        yield at, a[at : at + SLICE + DEPTH - 1]


#: SHIFT[a, b]: the least step that takes residues a and b both into the cover.
SHIFT = np.array([[min(k for k in range(MODULUS) if (a + k) % MODULUS in COVER and (b + k) % MODULUS in COVER) for b in range(MODULUS)] for a in range(MODULUS)])


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of ``keys``, equal for equal ones."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate([np.ones(min(1, len(s)), np.int32), (s[1:] != s[:-1]).astype(np.int32)]), dtype=np.int32)
    return out


def _cover_ranks(head: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the cover samples by their first DOUBLED bytes and by twice as many, 0 at other positions.

    ``head`` orders positions by MODULUS bytes, ``end`` is where a position's segment ends.  A step of a multiple
    of MODULUS leads from sample to sample, so ranks by h bytes and those h further on give ranks by 2 h.
    """
    n = len(head)
    at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
    rank = np.zeros(n + 1, np.int32)
    rank[at] = _dense(head[at])
    short, h = rank, MODULUS
    while h <= DOUBLED:
        on = at + h
        behind = np.where(on < end[at], rank[np.minimum(on, n)], 0)
        longer = np.zeros(n + 1, np.int32)
        longer[at] = _dense(rank[at].astype(np.int64) * (len(at) + 1) + behind)
        short, rank, h = rank, longer, 2 * h
    return short, rank


def _order_ties(group: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How many members of its group come before each suffix; members share their first MODULUS bytes.

    Two suffixes are compared by the ranks of the samples that the same step leads to from both.  In a group of up
    to 8 all pairs are; in a larger one each finds its place among those of every residue by binary search.
    ``group`` is in rising order.
    """
    before, n = np.zeros(len(group), np.int64), len(group)
    residue, sizes = place % MODULUS, np.bincount(group)
    small = sizes[group] <= 8
    for d in range(1, 8):
        x = np.flatnonzero(small[: n - d] & (group[: n - d] == group[d:])) if n > d else np.zeros(0, int)
        y = x + d
        step = SHIFT[residue[x], residue[y]]
        p, q = rank[place[x] + step], rank[place[y] + step]
        before[y] += p < q  # x and y each occur once in a round
        before[x] += q < p
    large, many = np.flatnonzero(~small), int(rank.max()) + 1
    for a in range(MODULUS) if len(large) else ():
        others = large[residue[large] == a]
        for step in np.unique(SHIFT[a]):
            mine = large[np.isin(residue[large], np.flatnonzero(SHIFT[a] == step))]
            keys = np.sort(group[others] * many + rank[place[others] + step])
            before[mine] += np.searchsorted(keys, group[mine] * many + rank[place[mine] + step]) - np.searchsorted(keys, group[mine] * many)
    return before


def repeated_suffixes(segs: list[bytes], offs: list[int], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, segment) of every suffix in ``segs`` (bucket by bucket): whether another one has its first DEPTH bytes.

    The suffixes are sorted by bucket, distance to the anchor and content, and neighbours are compared.  Sorting
    looks at MODULUS bytes; longer ties are resolved by the cover ranks (:func:`_cover_ranks`), made once for a
    block, so however long a tie is no more bytes are looked at.  Whether neighbours agree in DEPTH bytes follows from
    ranks by DOUBLED bytes at the first and the last sample and the bytes at both ends: exactly, without hashes.
    """
    data = np.frombuffer(b"".join(segs), np.uint8)
    sizes = np.array([len(s) for s in segs])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    end = np.repeat(base + sizes, sizes)
    head, padded = np.zeros(len(data), np.uint64), np.concatenate([data, np.zeros(MODULUS, np.uint8)])
    left = np.minimum(end - np.arange(len(data)), MODULUS)
    for k in range(MODULUS):  # big end first; a byte behind the segment's end is 0, and the length tells it from a true 0
        head = (head << np.uint64(8)) | np.where(k < left, padded[k : k + len(data)], 0).astype(np.uint64)
    head = (head << np.uint64(8)) | left.astype(np.uint64)

    count = sizes - DEPTH + 1
    seg = np.repeat(np.arange(len(segs)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = base[seg] + at
    bucket = np.unique(names, return_inverse=True)[1].astype(np.int64)
    where = bucket[seg] * (DEPTH + 1) + (np.asarray(offs)[seg] - at)
    order = np.lexsort((head[place], where))
    same = (where[order[1:]] == where[order[:-1]]) & (head[place[order[1:]]] == head[place[order[:-1]]])
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    repeated = np.zeros(len(seg), bool)
    if not tied.any():
        return repeated, seg
    group = np.cumsum(np.concatenate([[True], ~same]))[tied]
    group, order = np.unique(group, return_inverse=True)[1].astype(np.int64), order[tied]
    short, rank = _cover_ranks(head, end)
    by = np.lexsort((_order_ties(group, place[order], rank), group))
    order = order[by]
    x, y = place[order[:-1]], place[order[1:]]
    step = SHIFT[x % MODULUS, y % MODULUS]
    last = step + (DEPTH - DOUBLED - step) // MODULUS * MODULUS
    equal = (group[1:] == group[:-1]) & (short[x + step] == short[y + step]) & (short[x + last] == short[y + last]) & (head[x + DEPTH - MODULUS] == head[y + DEPTH - MODULUS])
    repeated[order[1:][equal]] = repeated[order[:-1][equal]] = True
    return repeated, seg


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist()))


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h1, name, c): the anchors of each text; c is 2 for one that it has more than once."""
    for b in batches:
        h, names, counts = [], [], []
        for key, text in zip(b["h1"], b["text"]):
            found = [segments(part) for _, part in slices(text.encode())]
            name, c = np.unique(np.concatenate([f[3] for f in found]), return_counts=True)
            h.append(np.full(len(name), key)), names.append(name.view(np.int64)), counts.append(np.minimum(c, 2))
        if h:
            yield pd.DataFrame({"h1": np.concatenate(h), "name": np.concatenate(names), "c": np.concatenate(counts).astype(np.int32)})


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of the marked anchors of each text, equal ones once.

    Suffixes of a segment that the text has twice are repeated for certain; their runs come as rows without a
    name, so that only the first of the equal segments goes on.
    """
    for b in batches:
        rows = []
        for key, text, marked in zip(b["h1"], b["text"], b["names"]):
            want, seen = np.sort(np.asarray(marked, np.int64).view(np.uint64)), {}
            for at, part in slices(text.encode()):
                start, count, anchor, name = segments(part)
                k = np.searchsorted(want, name)
                for j in np.flatnonzero(want[np.minimum(k, len(want) - 1)] == name):
                    a, n = int(start[j]), int(count[j])
                    seg = part[a : a + n + DEPTH - 1].tobytes()
                    off = int(anchor[j]) - a
                    sh = int.from_bytes(hashlib.blake2b(seg, digest_size=8, salt=off.to_bytes(2, "little")).digest(), "little", signed=True)
                    seen.setdefault((int(name[j].view(np.int64)), sh), []).append((at + a, n, off, seg))
            sure = []
            for (name, sh), found in seen.items():
                a, n, off, seg = found[0]
                rows.append((key, name, sh, a, n, off, min(len(found), 2), seg))
                if len(found) > 1:
                    sure += [(x[0], x[0] + x[1]) for x in found]
            sure.sort()
            merged: list[list[int]] = []
            for a, e in sure:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([a, e])
            rows += [(key, None, None, a, e - a, None, 2, None) for a, e in merged]
            if len(rows) > 5000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["h1", "name", "sh", "a", "n", "off", "c", "seg"])
    for c in ("name", "sh", "off"):  # by hand: a float on the way would lose digits
        f[c] = pd.array([r[f.columns.get_loc(c)] for r in rows], dtype="Int64")
    return f


def _sort_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which suffixes of each segment occur in another segment of its bucket; rows come in order of bucket."""
    held, size = [], 0

    def sorted_block(rows: pd.DataFrame) -> pd.DataFrame:
        hit, seg = repeated_suffixes([bytes(s) for s in rows["seg"]], rows["off"].astype(int).tolist(), rows["name"].to_numpy(np.int64))
        out, ends = [], np.searchsorted(seg, np.arange(len(rows) + 1))
        for k, (name, sh) in enumerate(zip(rows["name"], rows["sh"])):
            if (flags := hit[ends[k] : ends[k + 1]]).any():
                out += [(name, sh, a, e - a) for a, e in _runs(flags)]
        return pd.DataFrame(out, columns=["name", "sh", "at", "len"])

    for b in batches:
        while len(b):
            held.append(b)
            size += sum(map(len, b["seg"]))
            if size < BLOCK:
                break
            rows = pd.concat(held, ignore_index=True)
            last = rows["name"].iloc[-1]
            done = rows[rows["name"] != last]
            rest = rows[rows["name"] == last]
            if len(done):
                yield sorted_block(done.reset_index(drop=True))
            held, size = [rest], sum(map(len, rest["seg"]))
            break
    if held:
        yield sorted_block(pd.concat(held, ignore_index=True))


def _hot_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(name, sh, at, key): every suffix of some segments with a 128-bit digest of its first DEPTH bytes."""
    for b in batches:
        for name, sh, seg in zip(b["name"], b["sh"], b["seg"]):
            n = len(seg) - DEPTH + 1
            yield pd.DataFrame({"name": name, "sh": sh, "at": range(n), "key": [hashlib.blake2b(seg[k : k + DEPTH], digest_size=16).digest() for k in range(n)]})


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for h1, h2, text, starts in zip(b["h1"], b["h2"], b["text"], b["runs"]):
            data = text.encode()
            edge = np.zeros(len(data) + 1, np.int32)
            for r in starts:
                edge[r["a"]] += 1
                edge[r["a"] + r["n"] - 1 + DEPTH] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((h1, h2, int(gone.sum()), len(_runs(gone)), hashlib.sha256(kept).hexdigest(), kept))
        yield pd.DataFrame(out, columns=["h1", "h2", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_bytes(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 (, kept)) of every document's whole text in UTF-8.

    A byte goes if a DEPTH-byte string that also starts elsewhere, in any document, covers it.  Every suffix
    falls into the bucket of its anchor, a content-defined ANCHOR-byte string in its first DEPTH bytes:

    1. Anchors are counted; those that occur once hold no repeated suffix.
    2. Texts with other anchors give the segments of suffixes around these; equal texts and equal segments are
       one, by aggregation before the shuffle, and all of them are repeated.
    3. Distinct segments go to their buckets.  A task sorts one block of buckets after another
       (:func:`repeated_suffixes`): suffixes by their first bytes, longer ties by ranks of the samples of a difference
       cover, which are made beforehand.  A suffix that has a neighbour's first DEPTH bytes is repeated.
       Buckets of over HOT segments are left to the cluster: a row for each suffix, grouped by a digest.
    4. Runs of repeated suffixes go back to their texts.

    Null text is empty.  Texts under DEPTH bytes hold nothing repeated.  Rows with equal texts have equal
    results; ids may be null or repeated.  Texts are looked at in slices of SLICE bytes that overlap, so one of any
    length needs some ten times SLICE bytes of memory beside itself.  Columns other than doc_id and text aren't read,
    whatever their names.  An empty table gives no rows.  ``kept`` is the rest of the bytes; it may not be UTF-8 any more.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select("doc_id", text.alias("text")).select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))
    long = raw.where(F.col("n_bytes") >= DEPTH)
    copies = raw.select("doc_id", "h1", "h2", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    names = materialize(long.select("h1", "text").mapInPandas(_anchors, "h1 long, name long, c int"))
    again = names.groupBy("name").agg(F.max("c").alias("c"), F.min("h1").alias("x"), F.max("h1").alias("y")).where("c > 1 or x <> y").select("name")
    marked = names.join(again, "name").groupBy("h1").agg(F.collect_set("name").alias("names"))
    texts = long.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    texts = materialize(texts.join(marked, "h1"), compression="zstd")
    release(names)
    segs = materialize(texts.select("h1", "text", "names").mapInPandas(_segments, "h1 long, name long, sh long, a long, n long, off int, c int, seg binary"), compression="zstd")

    kinds = segs.where("name is not null").groupBy("name", "sh").agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("off").alias("off"), F.first("seg").alias("seg"))
    kinds = materialize(kinds, compression="zstd")
    whole = kinds.where("c > 1").select("name", "sh", F.lit(0).cast("long").alias("at"), F.col("n").alias("len"))
    sizes = kinds.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    shared = kinds.select("name", "sh", "off", "seg").join(sizes, "name")
    hot = materialize(sizes.where(F.col("kinds") > HOT)).limit(1).count() > 0
    usual = shared.where(F.col("kinds") <= HOT) if hot else shared
    found = usual.select("name", "sh", "off", "seg").repartition("name").sortWithinPartitions("name", "sh").mapInPandas(_sort_buckets, "name long, sh long, at long, len long")
    found = found.unionByName(whole)
    if hot:
        keys = shared.where(F.col("kinds") > HOT).select("name", "sh", "seg").mapInPandas(_hot_keys, "name long, sh long, at long, key binary")
        keys = materialize(keys)
        tied = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
        found = found.unionByName(keys.join(tied, "key").select("name", "sh", "at", F.lit(1).cast("long").alias("len")))
    back = segs.select("h1", "name", "sh", "a").join(found, ["name", "sh"]).select("h1", (F.col("a") + F.col("at")).alias("a"), F.col("len").alias("n"))
    back = back.unionByName(segs.where("name is null").select("h1", "a", "n"))
    runs = back.groupBy("h1").agg(F.collect_set(F.struct("a", "n")).alias("runs"))
    cut = texts.select("h1", "h2", "text").join(runs, "h1").mapInPandas(_cut, "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = cut if with_kept else cut.drop("kept")

    # texts that occur more than once go whole, whatever else is known of them
    times = copies.where(F.col("n_bytes") >= DEPTH).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    facts = times.where("times > 1").join(cut, ["h1", "h2"], "full")
    empty = hashlib.sha256(b"").hexdigest()
    twice = F.col("times").isNotNull()
    out = (raw.select("doc_id", "h1", "h2", "n_bytes", "text").join(facts, ["h1", "h2"], "left") if with_kept else copies.join(facts, ["h1", "h2"], "left"))
    cols = [
        F.col("doc_id"), F.col("n_bytes"),
        F.when(twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(twice, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twice, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.sha2(F.col("text").cast("binary"), 256) if with_kept else F.col("sha"))).alias("kept_sha256"),
    ]
    if with_kept:
        cols.append(F.when(twice, F.lit(b"")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept"))
    return out.select(*cols)


def op2_substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.  Null texts are empty, repeated rows repeat each other's strings, and a text of any length is cut into slices."""
    return repeated_bytes(docs)
