"""Spelling variants: a corpus's words, the words one edit away, and the commonest form that each word leads to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_batches

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
HELD = 100_000  # different words that a task counts before it hands them on
FEW = 4096  # pairs that a key may give before it is split
LONG = 256  # code points above which a word's rows carry a name in its place


def damaged(name: object, run: str, every: int = 97) -> str:
    """``run`` without one code point if ``every`` divides the CRC of id and run: a made-up misspelling."""
    h = zlib.crc32(f"{name}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): the words of all texts, some misspelt by :func:`damaged`, of at least these lengths and counts.

    Each task counts words before they are shuffled, and hands its counts on when it holds HELD of them.  Null
    text: no words.  A null id counts as an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                runs = Counter()
                for m in RUN.finditer(text.as_py() or ""):
                    runs[m[0]] += 1
                    if len(runs) > HELD:  # a very long text of words seen once
                        _add(held, name, runs)
                        yield given()
                _add(held, name, runs)
                if len(held) > HELD:
                    yield given()
        yield given()

    def _add(held: Counter, name: str | None, runs: Counter) -> None:
        for run, n in runs.items():
            word = damaged("" if name is None else name, run.translate(LOWER), every)
            if len(word) >= min_length:
                held[word] += n
        runs.clear()

    small_batches(docs.sparkSession)
    parts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _rest(w: Column, a: Column, skip: Column) -> Column:
    """``w`` without the part that starts at ``a`` and ends before ``skip``."""
    return F.concat(F.substring(w, F.lit(1), a), F.substring(w, skip + 1, F.length(w)))


def _halves(rows: DataFrame) -> DataFrame:
    """(name, size, probe, a, b): each interval of an indexed word's positions, split in two at its middle."""
    m = F.shiftright(F.col("a") + F.col("b"), 1)
    both = F.array(F.struct(F.col("a").alias("a"), m.alias("b")), F.struct(m.alias("a"), F.col("b").alias("b")))
    return rows.select("name", "size", "probe", F.explode(both).alias("x")).select("name", "size", "probe", "x.a", "x.b").where("a < b")


def near_words(words: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b): all pairs of different words of ``words`` (distinct, not null) with one code point inserted, deleted or replaced.  b is as long as a or one longer; of equal lengths a < b.

    A word of length l is cut evenly in two.  One edit leaves one segment whole: the other half, [a, b) of the
    positions, is left out and (l, a, b, rest) is the key under which the word is indexed.  Words of the same length probe
    with their own key, words one longer with the rest at shifted positions, which leaves out b - a + 1.  Where
    a key would give over ``few`` pairs, which are many words with a segment in common, both its sides are split again at the
    interval's middle, so that more of the word must agree, down to single positions, where an alphabet bounds the
    group.  Pairs that share a key are verified by edit distance and met once.  A word of any length is four rows,
    which double with each split; so those of a word of over LONG code points carry its name (LONG + 1 code points: its
    start and its SHA-256) and get the word by a join where it is read.
    """
    size = F.length("word").cast("int")
    name = F.when(size > LONG, F.concat(F.substring("word", 1, LONG + 1 - 64), F.sha2("word", 256))).otherwise(F.col("word"))
    own = words.select(name.alias("name"), size.alias("size"), F.lit(False).alias("probe"))
    longer = words.where(size > 1).select(name.alias("name"), (size - 1).alias("size"), F.lit(True).alias("probe"))
    longs = materialize(words.where(size > LONG).select(name.alias("name"), "word"))
    named = longs.limit(1).count() > 0

    def spelt(rows: DataFrame, col: str, word: str) -> DataFrame:
        """``rows`` and, as ``word``, the words that the names in ``col`` stand for."""
        if not named:
            return rows.withColumn(word, F.col(col))
        return rows.join(longs.select(F.col("name").alias(col), F.col("word").alias("whole")), col, "left").withColumn(word, F.coalesce("whole", col)).drop("whole")

    rows = _halves(own.unionByName(longer).select("*", F.lit(0).alias("a"), F.col("size").alias("b")))
    found, far, state = [], [], None
    while True:
        rest = _rest(F.col("word"), F.col("a"), F.col("b") + F.col("probe").cast("int"))
        keyed = spelt(rows, "name", "word").select(*rows.columns, F.sha2(rest, 256).alias("rest"))  # of one width, however long the words
        key = ["size", "a", "b", "rest"]
        n, m = F.sum((~F.col("probe")).cast("long")), F.sum(F.col("probe").cast("long"))
        keyed = materialize(keyed)
        counts = keyed.groupBy(*key).agg(n.alias("n"), m.alias("m")).where("n > 0 and n + m > 1")
        counts = counts.select(*key, ((F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * F.col("m") > few) & (F.col("b") - F.col("a") > 1)).alias("hot"))
        kept = materialize(keyed.join(counts, key))
        release(keyed, *[state] * (state is not None))
        cold = kept.where(~F.col("hot"))
        index = cold.where(~F.col("probe")).select(*key, F.col("name").alias("w"))
        met = index.join(cold.select(*key, F.col("name").alias("v"), "probe"), key).where(F.col("probe") | (F.col("w") < F.col("v")))
        pairs = met.where((F.length("v") <= LONG) & (F.levenshtein("w", "v", 1) == 1)).select(F.col("w").alias("a"), F.col("v").alias("b"))
        found.append(materialize(pairs))
        if named:
            far.append(materialize(met.where(F.length("v") > LONG).select("w", "v", "probe").distinct()))
        state = kept
        hot = kept.where("hot")
        if not hot.limit(1).count():
            break
        rows = _halves(hot)
    release(state)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    if named:
        both = reduce(DataFrame.unionByName, far).distinct()
        both = spelt(spelt(both, "w", "x"), "v", "y").where(F.levenshtein("x", "y", 1) == 1)
        # names of one length aren't in the order of their words
        every = every.unionByName(both.select(F.when(F.col("probe"), F.col("x")).otherwise(F.least("x", "y")).alias("a"), F.when(F.col("probe"), F.col("y")).otherwise(F.greatest("x", "y")).alias("b")))
    out = materialize(every.distinct())
    release(*found, *far, longs)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by pointer doubling.  A form has at least twice its word's count, so chains are short."""
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        release(at)
        moved = new.where("moved").limit(1).count()
        at = new.select("word", "root")
        at.scratch_path = new.scratch_path
        if not moved:
            return at


def spelling_variants(words: DataFrame, ratio: int = 2, few: int = FEW) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of (word, n), words being distinct.

    form is the near word of largest n (ties: first in code-point order) if that is at least ``ratio`` times the word's;
    root is what following the forms ends at, the word itself if it has none.  Without words the result is empty.
    """
    words = materialize(words.select("word", "n"))
    near = near_words(words.select("word"), few)
    both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("word"), F.col("e.b").alias("other"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "other"))  # the commonest, then the first
    met = both.join(words.select(F.col("word").alias("other"), "n"), "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = materialize(words.join(met, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= ratio * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.n")).alias("form_n"))).alias("best")))
    release(near, words)
    ends = roots(known.where("best is not null").select("word", "best.form"))
    return known.join(ends, "word", "left").select("word", "n", "n_near", "best.form", "best.form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of whole ``documents`` (:func:`word_counts`, :func:`spelling_variants`).

    Null ids and texts, repeated rows and texts of any length are words like any other; other columns aren't read; no documents give no
    rows.
    """
    return spelling_variants(word_counts(docs)).select("word", "form", "root", "n", "n_near", "form_n")
