"""Near-duplicate records: exact Jaccard join on word n-grams by vertical partitioning.

The global order of n-grams (rarest first) is cut into fragments. Overlap is counted in each fragment by
itself and the partial counts are summed per pair:

1. Texts become sets of hashed n-grams; equal sets are one class with one 64-bit key, drawn from two digests
   and the size of the set, and redrawn for all should two different classes get the same.
2. Every n-gram's frequency is counted over all classes. The n-grams of a batch of texts travel packed, a
   row per batch and bucket of hashes, with the keys of their classes; a bucket sends back only those that
   stand in two classes at least, about a tenth. N-grams that occur once only count in the set's size.
3. Each class's n-grams are put in the global order. A pair reaching the threshold ``t`` must share one of
   the smaller side's first ``n - ceil(2t/(1+t) n) + 1`` and the larger side's first ``n - ceil(t n) + 1``
   n-grams. Fragment 0 is these prefixes; its join by n-gram, with length and position filters, yields the
   pairs with their overlap there and the places of the last n-gram they have in common.
4. Pairs whose sum can still reach the threshold go on. The order is cut at fixed frequencies, common to all
   classes, into further fragments, and what lies behind those places is counted in each of them by itself.
5. The partial counts, fragment 0's among them, are summed per pair and compared with the threshold in whole
   numbers.

No step gathers an n-gram's postings or a class's members in one place, nor caps them: an n-gram with more
than ``OFTEN`` classes in a batch goes to its bucket as a count, and its classes stay with the batch until the
total comes back.

Defined cases: a null or too short text has no set and no pair; repeated texts are members of one class;
ids that repeat with equal text count once; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlens.llm.words import WordHashes, gram_sets, hash_text, mix, words
from prefixlens.sources.tables import written

#: A text's class (part 0), or a batch's n-grams of one bucket in runs of one class each: those to be looked up,
#: with the counts of frequent ones (part 1), and the frequent ones themselves (part 2).
PACKED = "part int, id bigint, key bigint, d1 bigint, d2 bigint, n int, batch bigint, bucket int, keys binary, ns binary, sizes binary, grams binary, often binary, counts binary"
#: A bucket's answer to a batch about frequent n-grams, or the shared n-grams of the classes of one slice.
REPLY = "batch bigint, bucket int, often binary, totals binary, slice int, keys binary, ns binary, sizes binary, grams binary, dfs binary"
RUNS = ("keys", "ns", "sizes", "grams")
#: Fragments of the global order, a power of 4 of the frequency each.
FRAGMENTS = 4
#: Classes of a batch from which an n-gram counts as frequent in it.
OFTEN = 8
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _rows(ddl: str, **columns) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in ddl.split(", ")))
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], _TYPES[k]) if n in columns else pa.nulls(size, _TYPES[k]) for n, k in zip(names, kinds)], names=names)


def _pieces(place: np.ndarray, used: np.ndarray, *values: np.ndarray) -> list[list[bytes]]:
    """The bytes of ``values`` at each of the places ``used``; ``place`` is sorted."""
    at, end = np.searchsorted(place, used), np.searchsorted(place, used, "right")
    return [[v[p:q].tobytes() for p, q in zip(at, end)] for v in values]


def _runs(place: np.ndarray, keys: np.ndarray, ns: np.ndarray, grams: np.ndarray, used: np.ndarray) -> dict[str, list[bytes]]:
    """RUNS columns for the places ``used``; rows are sorted by (place, key)."""
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(place))).astype(np.int32)
    return dict(zip(RUNS, _pieces(place[starts], used, keys[starts], ns[starts], sizes) + _pieces(place, used, grams)))


def _place(x: np.ndarray, n: int) -> np.ndarray:
    return ((x.view(np.uint64) >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def packed_rows(df: DataFrame, pick: Callable[[pa.RecordBatch], Iterator[tuple[int, str, str]]], n: int, min_words: int, buckets: int, seed: int = 0) -> DataFrame:
    """PACKED rows of all texts. ``pick`` gives (id, group, text) of a batch; groups never match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = WordHashes(), TaskContext.get().partitionId() << 32
        for number, b in enumerate(batches):
            ids, groups, texts = [], [], []
            for i, group, text in pick(b):
                ws = words(text)
                if len(ws) >= max(min_words, n):
                    ids.append(i)
                    groups.append(hash_text(group))
                    texts.append(ws)
            if not ids:
                continue
            grams, offsets = gram_sets(texts, groups, n, cache)
            sizes = np.diff(offsets).astype(np.int32)
            with np.errstate(over="ignore"):
                d1 = np.add.reduceat(grams, offsets[:-1])
                d2 = np.bitwise_xor.reduceat(grams * grams + (grams >> np.uint64(7)), offsets[:-1])
                keys = mix(d1 ^ mix(d2 + np.uint64(seed)) ^ sizes.astype(np.uint64)).view(np.int64)
            yield _rows(PACKED, part=np.zeros(len(ids), np.int32), id=ids, key=keys, d1=d1.view(np.int64), d2=d2.view(np.int64), n=sizes)
            # a class once a batch
            _, first = np.unique(keys, return_index=True)
            mine = np.zeros(len(ids), bool)
            mine[first] = True
            owner = np.repeat(np.arange(len(ids)), sizes)
            grams, owner = grams[mine[owner]], owner[mine[owner]]
            unique, inverse, counts = np.unique(grams, return_inverse=True, return_counts=True)
            at, bucket = _place(unique, buckets), _place(grams, buckets)
            frequent = counts >= OFTEN
            for part, wanted in ((1, ~frequent[inverse]), (2, frequent[inverse])):
                rows = np.flatnonzero(wanted)
                rows = rows[np.lexsort((owner[rows], bucket[rows]))]
                used = np.unique(np.concatenate([bucket[rows], at[frequent]]))
                if not len(used):
                    continue
                columns = {"part": np.full(len(used), part, np.int32), "batch": np.full(len(used), task + number), "bucket": used}
                columns |= _runs(bucket[rows], keys[owner[rows]], sizes[owner[rows]], grams[rows], used)
                if part == 1:
                    often = np.flatnonzero(frequent)[np.argsort(at[frequent], kind="stable")]
                    columns |= dict(zip(("often", "counts"), _pieces(at[often], used, unique[often], counts[often].astype(np.int64))))
                yield _rows(PACKED, **columns)

    return df.mapInArrow(run, PACKED)


def _unpack(t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, its size, n-gram) of RUNS columns."""
    keys, ns, sizes, grams = (np.frombuffer(b"".join(t.column(c).to_pylist()), k) for c, k in zip(RUNS, (np.int64, np.int32, np.int32, np.uint64)))
    return np.repeat(keys, sizes), np.repeat(ns, sizes), grams


def _sliced(keys: np.ndarray, ns: np.ndarray, grams: np.ndarray, df: np.ndarray, slices: int) -> pa.RecordBatch:
    """REPLY rows, one per slice of classes."""
    place = _place(keys, slices)
    order = np.lexsort((keys, place))
    place, used = place[order], np.unique(place)
    columns = {"slice": used, **_runs(place, keys[order], ns[order], grams[order], used), "dfs": _pieces(place, used, df[order].astype(np.int64))[0]}
    return _rows(REPLY, **columns)


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows of equal ``column`` together; they come sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = b.column(column).to_numpy()
        begin = 0
        for c in [*np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist(), b.num_rows] if b.num_rows else ():
            if c > begin:
                held.append(b.slice(begin, c - begin))
            if c < b.num_rows and held and held[-1].column(column)[-1].as_py() != at[c]:
                yield pa.Table.from_batches(held)
                held = []
            begin = c
    if held:
        yield pa.Table.from_batches(held)


def shared_grams(packed: DataFrame, buckets: int) -> DataFrame:
    """(key, n, ranked: array of (df, g) in the global order): the n-grams of each class that another class has too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "bucket"):
            keys, ns, grams = _unpack(t)
            order = np.lexsort((keys, grams))
            keys, ns, grams = keys[order], ns[order], grams[order]
            once = np.ones(len(grams), bool)  # a class may come from several batches
            once[1:] = (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])
            keys, ns, grams = keys[once], ns[once], grams[once]
            often, counts = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("often", np.uint64), ("counts", np.int64)))
            every, at = np.unique(np.concatenate([grams, *often]), return_inverse=True)
            total = np.bincount(at, np.concatenate([np.ones(len(grams)), *counts]), len(every)).astype(np.int64)
            df = total[at[: len(grams)]]
            yield _sliced(keys[df > 1], ns[df > 1], grams[df > 1], df[df > 1], buckets)
            ends = np.cumsum([len(grams), *map(len, often)])
            rows = [i for i, x in enumerate(often) if len(x)]
            batch, bucket = (t.column(c).to_numpy()[rows] for c in ("batch", "bucket"))
            yield _rows(REPLY, batch=batch, bucket=bucket, often=[often[i].tobytes() for i in rows], totals=[total[at[ends[i] : ends[i + 1]]].tobytes() for i in rows])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, ns, grams = _unpack(b.slice(i, 1))
                often, totals = (np.frombuffer(b.column(c)[i].as_py(), k) for c, k in (("often", np.uint64), ("totals", np.int64)))
                by = np.argsort(often)
                yield _sliced(keys, ns, grams, totals[by][np.searchsorted(often[by], grams)], buckets)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "slice"):
            keys, ns, grams = _unpack(t)
            df = np.frombuffer(b"".join(t.column("dfs").to_pylist()), np.int64)
            order = np.lexsort((grams, df, keys))
            keys, ns, grams, df = keys[order], ns[order], grams[order], df[order]
            once = np.ones(len(grams), bool)
            once[1:] = (grams[1:] != grams[:-1]) | (keys[1:] != keys[:-1])
            keys, ns, grams, df = keys[once], ns[once], grams[once], df[once]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            items = pa.StructArray.from_arrays([pa.array(df), pa.array(grams.view(np.int64))], ["df", "g"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(keys)).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.array(ns[starts]), lists], names=["key", "n", "ranked"])

    asked = packed.where("part = 1").select("batch", "bucket", *RUNS, "often", "counts")
    replies = written(asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, REPLY), "neardup-frequencies")
    kept = packed.where("part = 2").select("batch", "bucket", *RUNS)
    frequent = kept.join(replies.where("slice IS NULL").select("batch", "bucket", "often", "totals"), ["batch", "bucket"]).select(*RUNS, "often", "totals").mapInArrow(answer, REPLY)
    found = [x.select("slice", *RUNS, "dfs") for x in (replies.where("slice IS NOT NULL"), frequent)]
    return found[0].unionByName(found[1]).repartition(buckets, "slice").sortWithinPartitions("slice").mapInArrow(rank, "key bigint, n int, ranked array<struct<df:bigint,g:bigint>>")


def ranked(shared: DataFrame, t: Fraction) -> DataFrame:
    """Classes that could match: key, n, single, p and q (prefix lengths as the larger and as the smaller side), ranked n-grams."""
    least = lambda r: F.ceil(F.lit(r.numerator) * F.col("n") / F.lit(r.denominator) - F.lit(1e-9)).cast("int")
    prefix = lambda r: (F.col("n") - least(r) + 1 - F.col("single")).cast("int")
    lists = shared.withColumn("single", (F.col("n") - F.size("ranked")).cast("int"))
    return lists.withColumns({"p": prefix(t), "q": prefix(2 * t / (1 + t))}).where("p > 0").select("key", "n", "single", "p", "q", "ranked")


def similar_classes(ordered: DataFrame, t: Fraction, fragments: int = FRAGMENTS) -> DataFrame:
    """Pairs of classes at or above the threshold: a, b (keys), overlap, na, nb. ``ordered`` is a written table."""
    num, den = t.numerator, t.denominator
    required = num * (F.col("na") + F.col("nb"))  # overlap * (num + den) must reach it

    def prefix(length: str, side: str) -> DataFrame:
        return ordered.where(F.col(length) > 0).select("key", "n", "single", F.posexplode(F.slice("ranked", F.lit(1), F.col(length))).alias("k", "x")).select(
            F.col("x.g").alias("g"), F.col("key").alias(side), F.col("n").alias(f"n{side}"), F.col("k").alias(f"k{side}"), (F.col("n") - F.col("single") - F.col("k") - 1).alias(f"left_{side}")
        )

    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    reach = lambda counted: (counted + F.least("left_a", "left_b")) * (num + den) >= required
    first = (
        prefix("q", "a").join(prefix("p", "b"), "g").where(smaller & (F.col("na") * den >= F.col("nb") * num))
        # n-grams before this one may be common as well
        .where((1 + F.least("ka", "kb") + F.least("left_a", "left_b")) * (num + den) >= required)
        .groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"), F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.min("left_a").alias("left_a"), F.min("left_b").alias("left_b"))
        .where(reach(F.col("c")))
    )
    level = lambda x: F.least(F.floor(F.log2(x["df"]) / 2), F.lit(fragments - 1)).cast("int")
    # the n-grams of each fragment, with the place of its first in the order
    cut = ordered.select("key", F.transform(F.sequence(F.lit(0), F.lit(fragments - 1)), lambda f: F.struct(
        F.size(F.filter("ranked", lambda x: level(x) < f)).alias("at"), F.transform(F.filter("ranked", lambda x: level(x) == f), lambda x: x["g"]).alias("grams")
    )).alias("cut"))
    behind = lambda s, k: F.slice(s["grams"], F.greatest(F.col(k) + 2 - s["at"], F.lit(1)), F.greatest(F.size(s["grams"]), F.lit(1)))
    left = first.select("a", "b", "na", "nb", "c", "ka", "kb").join(cut, F.col("a") == F.col("key")).select("a", "b", "na", "nb", "c", "kb", F.transform("cut", lambda s: behind(s, "ka")).alias("sa"))
    both = left.join(cut, F.col("b") == F.col("key"))
    partial = F.zip_with("sa", "cut", lambda x, y: F.size(F.array_intersect(x, behind(y, "kb"))).cast("bigint"))
    summed = both.select("a", "b", "na", "nb", F.aggregate(partial, F.col("c"), lambda total, c: total + c).alias("overlap"))
    return summed.where(F.col("overlap") * (num + den) >= required)


def similarity_join(df: DataFrame, pick: Callable, n: int, threshold: str, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, key, rep; links: a, b, overlap, na, nb between class keys) of all texts of df."""
    t = Fraction(threshold)
    buckets = max(16, 2 * df.rdd.getNumPartitions())
    seed = 0
    while True:
        packed = written(packed_rows(df, pick, n, min_words, buckets, seed), "neardup-packed")
        texts = packed.where("part = 0").select("id", "key", "d1", "d2", "n")
        both = [f(c).alias(f"{c}{i}") for c in ("d1", "d2", "n") for i, f in enumerate((F.min, F.max))]
        classes = written(texts.groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n"), *both[:4], both[5]), "neardup-classes")
        if classes.where("d10 <> d11 OR d20 <> d21 OR n <> n1").isEmpty():
            break
        seed += 1  # two classes have one key: draw others
    members = written(texts.select("id", "key").distinct().join(classes.select("key", "rep"), "key"), "neardup-members")
    return members, similar_classes(written(ranked(shared_grams(packed, buckets), t), "neardup-ranked"), t)


def member_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of ids (line_a < line_b): within a class, and between linked classes."""
    x, y = members.alias("x"), members.alias("y")
    pair = [F.least("x.id", "y.id").alias("line_a"), F.greatest("x.id", "y.id").alias("line_b")]
    within = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(*pair)
    across = links.select("a", "b").join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key")).select(*pair)
    return within.unionByName(across)


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per id: its class (the smallest id in it) and the number of other classes and other ids it is similar to."""
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(size.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.sum("size").alias("others")).withColumnRenamed("a", "key")
    per = size.join(other, "key", "left").select("key", F.coalesce("links", F.lit(0)).alias("similar_classes"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("similar_ids"))
    return members.join(per, "key").select("id", F.col("rep").alias("class_id"), "similar_classes", "similar_ids")
