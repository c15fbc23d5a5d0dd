"""Near-duplicate documents by SetSketch registers: banding, joint likelihood, then exact sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, release, small_batches

REGISTERS, BANDS = 128, 32
PER_BAND = REGISTERS // BANDS
BASE, RATE, LIMIT = 1.001, 20.0, 65534  # registers 0 to LIMIT + 1 fit 16 bits
MARGIN = 0.16  # 4.5 standard deviations of an estimate from 128 registers at a similarity of 0.8
BLOCK = 512
_MULTIPLIERS = np.random.default_rng(20240101).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = 4) -> Iterator[np.ndarray]:
    """For each whole text its distinct shingles as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs of anything but space and \\t\\n\\v\\f\\r; a text of fewer words has them all
    as one shingle, a text without words (or null) none.
    """
    for at in range(0, len(texts), 500):
        part = pa.array([t or "" for t in texts[at : at + 500]], pa.large_string())
        trimmed = pc.utf8_trim(pc.ascii_lower(part), characters=" \t\n\x0b\x0c\r")
        tokens = pc.split_pattern_regex(trimmed, r"[\x20\x09-\x0D]+")
        counts = np.where(pc.equal(trimmed, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(tokens).to_numpy())
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
        code = pc.list_flatten(tokens).dictionary_encode()
        h = pd.util.hash_array(np.asarray(code.dictionary.to_pylist(), dtype=object))[code.indices.to_numpy()] if len(code) else np.zeros(0, np.uint64)
        h = h.astype(np.uint64)
        for k, n in enumerate(counts):
            w = h[starts[k] : starts[k] + n]
            size = min(int(n), words)
            if not size:
                yield np.zeros(0, np.uint64)
                continue
            x = np.full(n - size + 1, size, np.uint64)
            for j in range(size):
                x = _mix(x + w[j : n - size + 1 + j])
            yield np.unique(x)


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set: each is the exponentially spaced, truncated minimum of RATE-exponential values.

    A register falls with its minimum's logarithm, so the sketch of a union is the larger register everywhere.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[a : a + 1024, None] * _MULTIPLIERS[None, :]).min(axis=0), out=least)
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0**-53
    x = -np.log1p(-u) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(x) / np.log(BASE))
    return np.clip(k, 0, LIMIT + 1).astype(np.uint16)


def likelihood_similarity(a_larger: np.ndarray, b_larger: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity that makes the register comparison likeliest, set sizes known; on a grid of 0.02."""
    u = (na / (na + nb))[:, None]
    v, equal = 1 - u, (REGISTERS - a_larger - b_larger)[:, None]
    j = np.minimum(np.arange(0, 1.0001, 0.02)[None, :], np.minimum(u / v, v / u))

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    more, less = p(u - v * j), p(v - u * j)
    fit = a_larger[:, None] * np.log(more) + b_larger[:, None] * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def _plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Which rows of two register arrays may be ``least`` similar: by the exact sizes, then by likelihood."""
    ok = np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9
    at = np.flatnonzero(ok)
    if len(at):
        x, y = a[at], b[at]
        est = likelihood_similarity((x > y).sum(axis=1), (x < y).sum(axis=1), na[at].astype(float), nb[at].astype(float))
        ok[at] = est >= least - MARGIN
    return ok


def _unpacked(bands: pd.Series) -> np.ndarray:
    return np.stack(bands.to_list()).astype(np.int64).view(np.uint16).reshape(len(bands), REGISTERS) if len(bands) else np.zeros((0, REGISTERS), np.uint16)


def sketch(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, rid, n, node, bands) of every document.

    rid names the row by id and text.  node is a 64-bit digest of the shingle set, null for an empty set; bands
    are the registers, four to a long.
    """

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, node, bands = [], [], []
            for s in shingle_sets(b.column("text").to_pylist(), words):
                n.append(len(s))
                node.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                bands.append(registers(s).view(np.int64) if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            # ids stay in Arrow: pandas makes doubles of whole numbers beside a null
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), *made], ["doc_id", "rid", "n", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("rid"), text.alias("text")).mapInArrow(sketched, f"doc_id {kind}, rid long, n long, node long, bands array<long>")


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(node, hashes) of the classes in ``nodes``: their texts are read once more, the sets go to the shared folder."""
    wanted = classes.join(nodes, "node").select("node", "rid")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64("doc_id", text).alias("rid"), text.alias("text")).join(wanted, "rid").dropDuplicates(["node"])

    def as_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), 500):
                part = b.iloc[a : a + 500]
                yield pd.DataFrame({"node": part["node"], "hashes": [s.tobytes() for s in shingle_sets(part["text"].tolist(), words)]})

    return materialize(texts.select("node", "text").mapInPandas(as_sets, "node long, hashes binary"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full shingle sets are ``least`` similar."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= round(100 * least) * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return joined.where(alike("ha", "hb")).select("a", "b")


def _whole_groups(keys: list[str], work):
    """Runs ``work`` on frames of whole groups, many small ones or one large one, of rows that come in order of ``keys``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            k = b[keys].to_numpy()
            other = np.flatnonzero((k != k[-1]).any(axis=1)) if len(k) else []
            cut = other[-1] + 1 if len(other) else 0
            if cut:
                yield work(b.iloc[:cut].reset_index(drop=True))
            held = b.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield work(held)

    return run


def _groups(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, int]]:
    k = pdf[keys].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]])
    return zip(starts[:-1].tolist(), starts[1:].tolist())


GROUP = ["bucket", "lo", "hi"]


def _open_in_bucket(least: float):
    """Classes in a bucket that may be similar to one of another component, block against block: (node), not pairs.

    Pairs of small groups are judged together, many groups at a time; in a large group a row's likeliest
    partners come first, which decide most rows.
    """

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        regs, n, comp, block = _unpacked(pdf["bands"]), pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["block"].to_numpy()
        lo, hi = pdf["lo"].to_numpy(), pdf["hi"].to_numpy()
        out, floor = np.zeros(len(pdf), bool), (least - MARGIN - 0.04) * REGISTERS
        left, right, waiting = [], [], 0

        def together() -> None:
            nonlocal waiting
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                ok = (comp[x] != comp[y]) & ((lo[x] == hi[x]) | (block[x] != block[y]))
                x, y = x[ok], y[ok]
                likely = (regs[x] == regs[y]).sum(axis=1) >= floor
                x, y = x[likely], y[likely]
                ok = _plausible(regs[x], regs[y], n[x], n[y], least) if len(x) else np.zeros(0, bool)
                out[x[ok]] = out[y[ok]] = True
            left.clear(), right.clear()
            waiting = 0

        for a, e in _groups(pdf, GROUP):
            if e - a <= 48:
                x, y = np.triu_indices(e - a, 1)
                left.append(x + a), right.append(y + a)
                waiting += len(x)
                if waiting > 20_000:
                    together()
                continue
            for i in range(a, e):
                other = a + np.flatnonzero((comp[a:e] != comp[i]) & ((lo[i] == hi[i]) | (block[a:e] != block[i])) & (np.minimum(n[a:e], n[i]) >= least * np.maximum(n[a:e], n[i]) - 1e-9))
                equal = (regs[other] == regs[i]).sum(axis=1)
                # registers are equal about as often as the sets are similar: below this no estimate comes near
                other, equal = other[equal >= floor], equal[equal >= floor]
                other = other[np.argsort(-equal, kind="stable")]
                for part in (other[:16], other[16:]):
                    if len(part) and _plausible(np.repeat(regs[i][None], len(part), axis=0), regs[part], np.full(len(part), n[i]), n[part], least).any():
                        out[i] = True
                        break
        together()
        return pdf.loc[out, [*GROUP, "node", "comp", "block"]]

    return _whole_groups(GROUP, judge)


def _components_of(comp: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(component, smallest component linked to it) for links between rows x and y of ``comp``."""
    names, at = np.unique(comp, return_inverse=True)
    x, y, label = at[x], at[y], np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    k = np.flatnonzero(label != np.arange(len(names)))
    return names[k], names[label[k]]


def _joined_in_bucket(least: float):
    """Components that full sets in a bucket link, as (a, b): a component and the smallest it is linked to.

    In a large group intersections of all pairs are a product of the classes' membership matrices over the
    shingles that at least two of them have.
    """

    def large(sets: list[np.ndarray], n: np.ndarray, comp: np.ndarray, top: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        group = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])) - 1
        shared = np.bincount(group) > 1
        pick = shared[group]
        col, row = (np.cumsum(shared) - 1)[group[pick]], row[pick]
        both = np.zeros((len(top), len(left)), np.float32)
        for a in range(0, int(shared.sum()), 4096):
            k = slice(*np.searchsorted(col, [a, a + 4096]))
            has = np.zeros((len(sets), min(4096, int(shared.sum()) - a)), np.float32)
            has[row[k], col[k] - a] = 1
            both += has[top] @ has[left].T
        near = 100 * both >= round(100 * least) * (n[top][:, None] + n[left][None, :] - both)
        near &= comp[top][:, None] != comp[left][None, :]
        x, y = np.nonzero(near)
        return top[x], left[y]

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        every, comps, blocks = [np.frombuffer(h, np.uint64) for h in pdf["hashes"]], pdf["comp"].to_numpy(), pdf["block"].to_numpy()
        los, his, found, seen = pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), [], {}
        nodes = pdf["node"].to_numpy()
        for a, e in _groups(pdf, GROUP):
            sets, comp, block, lo, hi = every[a:e], comps[a:e], blocks[a:e], los[a], his[a]
            n = np.array([len(x) for x in sets])
            if e - a <= 12:
                links = []
                for i in range(e - a):
                    for k in range(i + 1, e - a):
                        if comp[i] != comp[k] and (lo == hi or block[i] != block[k]):
                            pair = (nodes[a + i], nodes[a + k])
                            if pair not in seen:  # other bands bring the same pairs
                                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                                seen[pair] = 100 * both >= round(100 * least) * (n[i] + n[k] - both)
                            if seen[pair]:
                                links.append((i, k))
                x, y = np.array(links, int).reshape(-1, 2).T
            else:
                x, y = large(sets, n, comp, np.flatnonzero(block == lo), np.flatnonzero(block == hi))
            if len(x):
                p, q = _components_of(comp, x, y)
                found.append(pd.DataFrame({"a": p, "b": q}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return _whole_groups(GROUP, join)


def near_duplicates(docs: DataFrame, least: float = 0.8, words: int = 4) -> DataFrame:
    """(doc_id, rid, n_shingles, component, component_id) of every row: components of documents at least ``least`` similar.

    Documents with one shingle set are one class from the start.  Classes that share a band of four registers
    meet; at a similarity of 0.8 two miss each other in all 32 bands once in 20 million.  First each class in
    a bucket is compared with the bucket's first class: a star, not all pairs.  Of the components of those
    links, only pairs of classes from different ones, in one bucket, can still change anything.  A class that
    by likelihood may be similar to another component's stays, and those that stay in a bucket are compared on
    full sets, block against block, where rows name components and not pairs.  So no link between components
    is lost; links inside a component change nothing and aren't looked for.

    Buckets of over BLOCK classes are compared block against block in tasks of their own, so a band that very many
    classes share costs time by the square of their number, on all executors, and no link.

    component_id is the smallest doc_id of the component, nulls aside (null if all are null).  Empty texts
    are linked with nothing: their component is their own id.  Repeated rows are equal texts.  Ids may be null or
    repeated, so component_id names no component; component does (among empty texts, the row: its rid).  Columns other
    than doc_id and text aren't read, whatever their names.  A text of any length is one row; its shingles take some
    16 bytes a word.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = materialize(sketch(docs, words))
    classes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "rid")).alias("m"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("node", "m.rid", "n", "bands"))
    banded = classes.select("node", F.posexplode("bands").alias("pos", "regs")).select("node", F.xxhash64("pos", "regs").alias("bucket"))
    buckets = materialize(banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    members = materialize(banded.join(buckets, "bucket"))
    star = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    @F.pandas_udf("boolean")
    def plausible(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series(_plausible(_unpacked(x), _unpacked(y), nx.to_numpy(), ny.to_numpy(), least))

    side = [classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bands").alias(f"bands_{c}")) for c in "ab"]
    maybe = star.join(side[0], "a").join(side[1], "b").where(plausible("bands_a", "bands_b", "na", "nb")).select("a", "b")
    maybe = materialize(maybe)
    in_pairs = maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(in_pairs, docs, classes, words)
    links = materialize(_verified(maybe, sets, least))
    release(sets, maybe)
    comp = components(links)

    placed = members.join(comp, "node", "left").select("bucket", "node", "size", F.coalesce("comp", "node").alias("comp"))
    split = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = placed.join(split, "bucket").join(classes.select("node", "n", "bands"), "node").select("*", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("block"))
    rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p")).select("bucket", "node", "comp", "n", "bands", "block", F.least("block", "p").alias("lo"), F.greatest("block", "p").alias("hi"))
    unsure = materialize(rest.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInPandas(_open_in_bucket(least), "bucket long, lo int, hi int, node long, comp long, block int"))
    if unsure.limit(1).count():
        sets = _sets(unsure.select("node").distinct(), docs, classes, words)
        full = unsure.join(sets, "node")
        more = materialize(full.repartition(*GROUP).sortWithinPartitions(*GROUP, "node").mapInPandas(_joined_in_bucket(least), "a long, b long").distinct())
        release(sets, comp)
        comp = components(links.unionByName(more))
    release(unsure, members, buckets)

    named = classes.select("node").join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first")).join(named, "node")
    ids = ids.join(ids.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("node", "comp", "component_id")
    own = F.col("node").isNull()
    return rows.select("doc_id", "rid", F.col("n").alias("n_shingles"), "node").join(ids, "node", "left").select("doc_id", "rid", "n_shingles", F.when(own, F.col("rid")).otherwise(F.col("comp")).alias("component"), F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, least: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, nulls last, ties by row hash.

    Groups are components of :func:`near_duplicates`, never rows that merely share an id, null or not.  Texts without
    words are like nothing, though rows equal in id and text are one.  All columns pass through, whatever their names.
    """
    found = near_duplicates(docs, least, words).groupBy((F.col("n_shingles") > 0).alias("full"), "component", "doc_id", "rid").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "n")).alias("m")
    chosen = materialize(found.groupBy("full", "component").agg(first).select("m.rid", "m.n"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", text).alias("rid"))
    out = keyed.join(chosen.select("rid"), "rid", "left_semi")
    if chosen.where("n > 1").limit(1).count():  # some row is there more than once
        out = out.dropDuplicates(["rid"])
    return out.select("row.*")


def op9_near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, on four-word shingles; edge cases as in :func:`near_duplicates`."""
    found = near_duplicates(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
