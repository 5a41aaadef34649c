"""Long exact spans shared between records, by super-k-mer partitioning.

A window is a run of ``length`` characters. Its minimiser is the smallest hash of a k-mer in it. Consecutive windows with one minimiser travel as one packed string, the
super-k-mer, to the minimiser's bucket; equal windows have equal minimisers and so always meet there.
Inside a bucket the windows of all super-k-mers are sorted and equal neighbours, compared character by
character, are the shared windows.

Only buckets that at least two records reach are opened; that is found by counting before any text moves.
A bucket with more windows than ``BUCKET_WINDOWS`` (a boilerplate passage in a third of all records, say)
is not sorted in one task: equal super-k-mers become one string there, and the windows of the different
strings are grouped by their text over all tasks, with equal results. Hashes alone decide nothing on either way.

Defined cases: null, empty and short texts have no window; a record that repeats a span only within itself
shares nothing; repeated rows with one id are one record; records of equal text share all windows; an empty
table gives an empty table; extra columns are ignored. Characters are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlens.llm.neardup import member_pairs
from prefixlens.llm.words import mix
from prefixlens.sources.tables import written

PACKED = "bucket bigint, id bigint, part int, at int, windows int, chars binary"
#: Windows sorted in one task at most.
BUCKET_WINDOWS = 1_000_000
#: Super-k-mers of this many windows are cut, so that a very long repetitive text stays in small pieces.
MAX_WINDOWS = 4096
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def rolling(codes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every run of ``width`` numbers: the polynomial's value mod 2**64, mixed."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h, powers, done = None, codes.astype(np.uint64) + np.uint64(1), 1
        # runs of 1, 2, 4, ... numbers, put together for the bits of width
        start, power, bit = 0, base, width
        while bit:
            if bit & 1:
                piece = powers[start : start + n]
                h = piece.copy() if h is None else h * power + piece
                start += done
            bit >>= 1
            if bit:
                powers = powers[: len(powers) - done] * power + powers[done:]
                power *= power
                done *= 2
        return mix(h)


def _smallest(h: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` consecutive hashes."""
    done = 1
    while done * 2 <= span:
        h = np.minimum(h[done:], h[: len(h) - done])
        done *= 2
    rest = span - done
    return np.minimum(h[rest:], h[: len(h) - rest]) if rest else h


def super_kmers(codes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first window, number of windows) of each super-k-mer of one text."""
    if len(codes) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _smallest(rolling(codes, k, _BASE[0]), length - k + 1)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate(([0], change))
    ends = np.concatenate((change, [len(least)]))
    if (ends - starts).max() > MAX_WINDOWS:
        cuts = [np.arange(s, e, MAX_WINDOWS) for s, e in zip(starts, ends)]
        ends = np.concatenate([np.append(c[1:], e) for c, e in zip(cuts, ends)])
        starts = np.concatenate(cuts)
    return least[starts], starts, ends - starts


def packed_rows(df: DataFrame, pick: Callable[[pa.RecordBatch], Iterator[tuple[int, list[str]]]], length: int, k: int) -> DataFrame:
    """The super-k-mers of all texts. ``pick`` gives (id, texts) of a batch; spans never cross texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            chars: list[bytes] = []
            for i, texts in pick(b):
                for part, text in enumerate(texts):
                    if len(text) < length:
                        continue
                    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                    hashes, starts, counts = super_kmers(codes, length, k)
                    m = len(starts)
                    out[0].append(hashes.view(np.int64))
                    out[1].append(np.full(m, i, np.int64))
                    out[2].append(np.full(m, part, np.int32))
                    out[3].append(starts.astype(np.int32))
                    out[4].append(counts.astype(np.int32))
                    chars += [text[s : s + c + length - 1].encode("utf-8", "surrogatepass") for s, c in zip(starts.tolist(), counts.tolist())]
            if chars:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out), pa.array(chars, pa.binary())], names=["bucket", "id", "part", "at", "windows", "chars"])

    return df.mapInArrow(run, PACKED)


#: Rows of the next stage: a shared window's key with one of its records, and where it stands.
WINDOWS = "bucket bigint, w1 bigint, w2 bigint, id bigint, part int, at int"


def _codes(chars: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(c.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32) for c in chars]
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _expand(b: pa.RecordBatch | pa.Table, length: int):
    """All windows of packed rows: row of each, offset in the row, offset in the joined codes, codes."""
    codes, sizes = _codes(b.column("chars").to_pylist())
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, offset, begins[row] + offset, codes


def _window_batch(b, row, offset, w1, w2, keep) -> pa.RecordBatch:
    take = row[keep]
    col = lambda name: b.column(name).to_numpy()[take]
    return pa.RecordBatch.from_arrays(
        [pa.array(col("bucket")), pa.array(w1[keep].view(np.int64)), pa.array(w2[keep].view(np.int64)), pa.array(col("id")), pa.array(col("part")), pa.array((col("at") + offset[keep]).astype(np.int32))],
        names=["bucket", "w1", "w2", "id", "part", "at"],
    )


def _sort_bucket(b: pa.Table, length: int) -> pa.RecordBatch:
    """The windows of whole buckets that stand in two records at least, by sorting."""
    b = b.combine_chunks()
    row, offset, at, codes = _expand(b, length)
    bucket, owner = b.column("bucket").to_numpy()[row], b.column("id").to_numpy()[row]
    w1 = rolling(codes, length, _BASE[0])[at]
    w2 = rolling(codes, length, _BASE[1])[at]
    order = np.lexsort((w2, w1, bucket))
    s1, s2, sb = w1[order], w2[order], bucket[order]
    head = np.ones(len(order), bool)  # the first of each run of equal hashes
    head[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (sb[1:] != sb[:-1])
    new = head.copy()
    # neighbours of equal hashes are compared as texts, a slice of rows at a time
    same = np.flatnonzero(~head)
    view = np.lib.stride_tricks.sliding_window_view(codes, length)
    differ = [j[(view[at[order[j]]] != view[at[order[j - 1]]]).any(axis=1)] for j in np.split(same, range(8192, len(same), 8192))]
    run = np.cumsum(head) - 1
    for r in np.unique(run[np.concatenate(differ)]):
        # different texts under one pair of hashes: the run is put in the order of the texts
        j = np.flatnonzero(run == r)
        texts = [view[at[x]].tobytes() for x in order[j]]
        by_text = sorted(range(len(j)), key=texts.__getitem__)
        order[j] = order[j][by_text]
        new[j] = [i == 0 or texts[x] != texts[by_text[i - 1]] for i, x in enumerate(by_text)]
    group, firsts = np.cumsum(new) - 1, np.flatnonzero(new)
    low = np.minimum.reduceat(owner[order], firsts)
    high = np.maximum.reduceat(owner[order], firsts)
    # the texts of such a run are told apart by their number in it
    w2[order] += (group - group[np.flatnonzero(head)][run]).astype(np.uint64)
    return _window_batch(b, row, offset, w1, w2, order[(low < high)[group]])


def shared_windows(packed: DataFrame, length: int, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Every window that stands in two records at least, once per place: WINDOWS. ``packed`` is a written table."""
    size = packed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("windows").alias("in_bucket")).where("low < high").select("bucket", "in_bucket")
    met = packed.join(size, "bucket")
    small = met.where(F.col("in_bucket") <= bucket_windows).select("bucket", "id", "part", "at", "windows", "chars")
    large = met.where(F.col("in_bucket") > bucket_windows).select("bucket", "id", "part", "at", "windows", "chars")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for b in batches:
            # rows come sorted by bucket: at a change, all that is held are whole buckets
            ids = b.column(0).to_numpy()
            change = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != ids[0]:
                change = np.append(0, change)
            windows += int(b.column(4).to_numpy().sum())
            if windows >= bucket_windows // 4 and len(change):
                held.append(b.slice(0, change[-1]))
                yield _sort_bucket(pa.Table.from_batches(held), length)
                held, b = [], b.slice(change[-1])
                windows = int(b.column(4).to_numpy().sum())
            held.append(b)
        if held:
            yield _sort_bucket(pa.Table.from_batches(held), length)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 16):
                part = b.slice(i, 16)
                texts = [c.decode("utf-8", "surrogatepass") for c in part.column(1).to_pylist()]
                counts = np.array([len(t) - length + 1 for t in texts])
                windows = [t[k : k + length].encode("utf-8", "surrogatepass") for t in texts for k in range(len(t) - length + 1)]
                take = pa.array(np.repeat(np.arange(len(texts)), counts))
                offset = np.concatenate([np.arange(n) for n in counts])
                columns = [part.column(c).take(take) for c in (0, 2, 3, 4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(offset.astype(np.int32)), pa.array(windows, pa.binary())], names=["bucket", "low", "high", "string", "offset", "window"])

    sorted_in_task = small.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(sort, WINDOWS)
    if large.isEmpty():
        return sorted_in_task
    # equal super-k-mers are one string; its windows are grouped as texts
    strings = large.groupBy("bucket", "chars").agg(F.min("id").alias("low"), F.max("id").alias("high")).withColumn("string", F.monotonically_increasing_id())
    strings = written(strings, "spans-strings")
    each = strings.select("bucket", "chars", "low", "high", "string").mapInArrow(explode, "bucket bigint, low bigint, high bigint, string bigint, offset int, window binary")
    common = each.groupBy("bucket", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("bucket", "window", F.monotonically_increasing_id().alias("w1"))
    common = written(common, "spans-common")
    shared = each.join(common, ["bucket", "window"]).select("string", "offset", "w1")
    placed = large.join(strings.select("bucket", "chars", "string"), ["bucket", "chars"]).join(shared, "string")
    return sorted_in_task.unionByName(placed.select("bucket", "w1", F.lit(0).cast("bigint").alias("w2"), "id", "part", (F.col("at") + F.col("offset")).alias("at")))


def same_windows(windows: DataFrame) -> DataFrame:
    """(id, key): records with the same shared windows, equally often, have one key, the smallest id among them.

    ``windows`` is a written table. Windows are told apart by two 64-bit digests, summed in halves.
    """
    parts = []
    for h in (F.xxhash64("bucket", "w1", "w2"), F.xxhash64("w2", "bucket", "w1", F.lit(1))):
        parts += [F.shiftright(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1))]
    sums = [f"s{i}" for i in range(len(parts))]
    per = windows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p).alias(c) for p, c in zip(parts, sums)])
    per = written(per, "spans-records")
    return per.join(per.groupBy("n", *sums).agg(F.min("id").alias("key")), ["n", *sums]).select("id", "key")


def sharing_classes(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: id, key, rep; links: a, b between keys): records by their shared windows, and classes with a common one.

    ``windows`` is a written table. Only one record of a class, its key, takes part in the join. A window is left
    out where every record's place for it directly follows one common window before it: its pairs are that window's too.
    """
    members = written(same_windows(windows), "spans-members")
    windows = windows.join(members.where("id = key").select("id"), "id", "left_semi")
    place = Window.partitionBy("id", "part").orderBy("at")
    before = windows.select(
        "bucket", "w1", "w2", "id",
        F.when(F.lag("at").over(place) == F.col("at") - 1, F.xxhash64(F.lag("bucket").over(place), F.lag("w1").over(place), F.lag("w2").over(place))).alias("prev"),
    )
    groups = before.groupBy("bucket", "w1", "w2").agg(F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.count("prev").alias("c"), F.count(F.lit(1)).alias("n"))
    first = groups.where(~((F.col("c") == F.col("n")) & (F.col("p0") == F.col("p1")))).select("bucket", "w1", "w2")
    rows = windows.join(first, ["bucket", "w1", "w2"]).select("bucket", "w1", "w2", "id").distinct()
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.w1") == F.col("y.w1")) & (F.col("x.w2") == F.col("y.w2")) & (F.col("x.id") < F.col("y.id"))
    links = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return members.withColumn("rep", F.col("key")), links


def sharing_pairs(windows: DataFrame) -> DataFrame:
    """Distinct pairs of records with a shared window: line_a < line_b."""
    return member_pairs(*sharing_classes(windows))


def shared_chars(windows: DataFrame, length: int) -> DataFrame:
    """Per record: how many of its characters lie in a shared span, and in how many separate stretches."""
    place = Window.partitionBy("id", "part").orderBy("at")
    step = windows.select("id", "part", "at").distinct().withColumn("gap", F.col("at") - F.lag("at").over(place))
    new = F.col("gap").isNull() | (F.col("gap") > length)
    return step.groupBy("id").agg(
        F.sum(F.when(new, length).otherwise(F.col("gap"))).cast("bigint").alias("shared_chars"),
        F.sum(F.when(new, 1).otherwise(0)).cast("bigint").alias("stretches"),
    )


def find(df: DataFrame, pick: Callable, length: int, k: int | None = None, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Written table of the shared windows of all records of df."""
    packed = written(packed_rows(df, pick, length, k or max(1, length // 3)), "spans-packed")
    return written(shared_windows(packed, length, bucket_windows), "spans-windows")
