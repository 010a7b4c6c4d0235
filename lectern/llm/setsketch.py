"""Near-duplicate groups by SetSketch.

A sketch holds, for each of its registers, the smallest of exponentially distributed values of a set's elements,
rounded to a power of a base. An element's values ascend: the j-th lies in the j-th interval of a truncated
exponential distribution and goes to another register each time, so drawing stops once no register can fall any
further. Sketches of unions are maxima of registers, and two sketches agree in about as many registers as their sets
have in common.

Register values are banded. In a bucket of agreeing bands every text is compared with the smallest id first, which
settles whole groups of copies with one comparison a text. Only where texts of a bucket are still in different
groups are they compared with each other, up to ``BLOCK`` of them. The texts of larger buckets meet by the rarest
shingles of their sets instead, which is exact. Comparisons estimate similarity from both sketches by maximum likelihood;
what comes near the threshold is verified on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import id_and_text, map_batches
from lectern.llm.rff_quality import summed
from lectern.llm.shingles import mix, shingle_sets
from lectern.operators.graph import components
from lectern.session import cut_lineage

REGISTERS = 256
BASE = 1.08
RATE = 16.0
TOP = 255
#: Values a band. A pair of similarity 0.8 shares none of the 51 bands in 2 of 10**9 cases.
BAND = 5
BANDS = REGISTERS // BAND
#: Estimates this far below the threshold are dropped: five standard errors of the estimate, which is 0.017 to 0.021
#: at a similarity of 0.8.
SLACK = 0.1
#: Registers that agree are a rough estimate, this much above the likely one or less; it saves most of the others.
SPARE = 0.03
#: Registers, and slack, of the finer sketches of texts that are compared with each other; five errors again.
FINE_REGISTERS = 1024
FINE_SLACK = 0.05
#: Texts of a bucket that are compared with each other; those of a larger one meet by rare shingles.
BLOCK = 512
#: Counters of shingles, by some bits of their hashes; they only set an order, which may be any.
COUNTERS = 1 << 16
#: Pairs that one task looks at at once, and those of them whose sketches it compares at once.
SLAB = 1_000_000
SOME_PAIRS = 4096
#: Texts with a rare shingle that one task holds; those of a more frequent one meet in pairs of so large blocks.
CELL = 2048
SHINGLE_WORDS = 4
#: A pair is linked if 100 times its intersection reaches this many times its union.
PERCENT = 80


def sketches(sets: list[np.ndarray], width: int = REGISTERS) -> np.ndarray:
    """``width`` registers (a power of two) of each set, one row a set; a row of zeros for an empty one."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    edges = np.append(np.log(width / (width - np.arange(width))) / RATE, np.inf)
    least = np.full((len(sets), width), np.inf)
    if sizes.sum():
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        start, stride = mix(hashes ^ np.uint64(0x51)), mix(hashes ^ np.uint64(0xA7)) | np.uint64(1)
        for j in range(width):
            low, high = edges[j], edges[j + 1]
            uniform = (mix(hashes + np.uint64(0x1000193 * (j + 1))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            value = low - np.log1p(-uniform * -np.expm1(-RATE * (high - low))) / RATE
            register = ((start + np.uint64(j) * stride) & np.uint64(width - 1)).astype(np.int64)
            np.minimum.at(least.ravel(), owner * width + register, value)
            going = (least.max(axis=1) > high)[owner]
            if not going.any():
                break
            if not going.all():
                hashes, owner, start, stride = hashes[going], owner[going], start[going], stride[going]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(level, 0, TOP).astype(np.uint8)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = registers[:, : BAND * BANDS].reshape(len(registers), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND):
        key = key * np.uint64(256) + parts[:, :, k]
    return mix(key).view(np.int64)


def likelihood_estimate(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of sets with ``n`` and ``m`` elements and sketches ``p`` and ``q``.

    It depends on how many registers of the one sketch are larger and smaller than those of the other.
    """
    more, less = (p > q).sum(axis=1), (p < q).sum(axis=1)
    same = p.shape[1] - more - less
    u, v = n / (n + m), m / (n + m)

    def larger(x):
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def logs(j):
        up, down = larger(np.maximum(u - v * j, 0)), larger(np.maximum(v - u * j, 0))
        tiny = 1e-12
        return more * np.log(up + tiny) + less * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = logs(a) > logs(b)
        low, high = np.where(left, low, a), np.where(left, b, high)
    return (low + high) / 2


def registers_of(column: pa.Array, width: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def printed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, print``: a hash of the text, which with the id stands for the row."""
    return id_and_text(docs, id_col, text_col).withColumn("print", F.xxhash64("text"))


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``doc_id, print, n_shingles, set_key, registers``; texts with equal shingle sets have equal keys.

    ``print`` tells the texts of one id apart.
    """

    def work(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            keys = [
                np.array([np.sum(mix(s)), np.bitwise_xor.reduce(mix(s ^ np.uint64(0x77)))], np.uint64).tobytes()
                for s in sets
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array([row.tobytes() for row in sketches(sets)], pa.binary()),
                ],
                names=["doc_id", "print", "n_shingles", "set_key", "registers"],
            )

    schema = "doc_id long, print long, n_shingles long, set_key binary, registers binary"
    return map_batches(printed_texts(docs, id_col, text_col), work, schema)


def band_rows(classes: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(registers_of(batch.column(1)))
                rep = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(rep)], names=["key", "rep"])

    return map_batches(classes.select("rep", "registers"), work, "key long, rep long")


def near(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose estimate reaches the threshold."""

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = registers_of(batch.column(2)), registers_of(batch.column(3))
                n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5))
                keep = likelihood_estimate(p, q, n, m) >= threshold
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"]
                )

    of = lambda end: classes.select(
        F.col("rep").alias(end), F.col("registers").alias(f"r_{end}"), F.col("n").alias(f"n_{end}")
    )
    joined = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
    return map_batches(joined, work, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""

    def work(batches):
        for batch in batches:
            left, right = shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words)
            shared = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(left, right)], np.int64)
            union = np.array([len(s) + len(t) for s, t in zip(left, right)], np.int64) - shared
            keep = pa.array((100 * shared >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in (0, 1)], names=["a", "b"])

    of = lambda end: texts.select(F.col("doc_id").alias(end), F.col("text").alias(f"t_{end}"))
    joined = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "t_a", "t_b")
    return map_batches(joined, work, "a long, b long")


def compared(group: dict[str, np.ndarray], target: float) -> np.ndarray:
    """Near pairs of a group: texts of one bucket, in different components, first together in this bucket."""
    registers, rep, comp, n = (group[c] for c in ("registers", "rep", "component", "n"))
    left, right = [], []
    for i in range(len(rep) - 1):
        agree = (registers[i + 1 :] == registers[i]).sum(axis=1)
        j = np.flatnonzero((agree >= (target - SLACK - SPARE) * REGISTERS) & (comp[i + 1 :] != comp[i])) + i + 1
        left.append(np.full(len(j), i))
        right.append(j)
    i, j = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    if len(i):
        keys = band_keys(registers)
        kept = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == group["key"][0]
        i, j = i[kept], j[kept]
    if len(i):
        near_ij = likelihood_estimate(group["fine"][i], group["fine"][j], n[i], n[j]) >= target - FINE_SLACK
        i, j = i[near_ij], j[near_ij]
    return np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], axis=1).astype(np.int64)


def shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur in the texts, those with equal low bits together."""

    def part(batch):
        hashes = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0), words)])
        return np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)

    return summed(texts.select("text"), part, COUNTERS)


def rare_shingles(texts: DataFrame, words: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``token, rep, n, left, indexed``: the rarest shingles of each set, and how many of it come from there on.

    Two sets as similar as ``percent`` share one of the rarest shingles of the larger one, as many as that percentage
    lets differ, and of the rarest of the smaller one, as many as a pair of equal sizes lets differ.
    """

    def work(batches):
        for batch in batches:
            parts = []
            for rep, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                n = len(own)
                asked = n - -(-percent * n // 100) + 1
                held = n - -(-2 * percent * n // (100 + percent)) + 1
                order = np.lexsort((own, counts[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]))[:asked]
                place = np.arange(len(order))
                parts.append((own[order].view(np.int64), np.full(len(order), rep), np.full(len(order), n), n - place, place < held))
            if parts:
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["token", "rep", "n", "left", "indexed"]
                )

    return map_batches(texts.select("doc_id", "text"), work, "token long, rep long, n long, left long, indexed boolean")


def rare_pairs(group: dict[str, np.ndarray], percent: int) -> Iterator[np.ndarray]:
    """Pairs of sets in different components that may still be similar if this is their first shingle in common.

    From that shingle on there must be enough of either set left. For a set that bounds the sizes of its partners, so
    only those are looked at. If the group has sketches, the pairs' estimates reach the threshold; if it has blocks, the
    pairs are of different ones.
    """
    index = np.flatnonzero(group["indexed"])
    index = index[np.argsort(group["n"][index], kind="stable")]
    if not len(index) or group["component"].min() == group["component"].max():
        return
    sizes, n, left = group["n"][index], group["n"], group["left"]
    low = np.searchsorted(sizes, -(-percent * n // 100), "left")
    high = np.searchsorted(sizes, np.minimum(n, left * (100 + percent) // percent - n), "right")
    found = np.maximum(high - low, 0)
    edges = np.cumsum(found)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + SLAB, "right")))
        x = np.repeat(np.arange(at, stop), found[at:stop])
        ends = np.cumsum(found[at:stop])
        y = index[np.repeat(low[at:stop], found[at:stop]) + np.arange(len(x)) - np.repeat(ends - found[at:stop], found[at:stop])]
        keep = (left[y] * (100 + percent) >= percent * (n[x] + n[y])) & (group["component"][x] != group["component"][y])
        if "block" in group:
            keep &= group["block"][x] != group["block"][y]
        x, y = x[keep], y[keep]
        if "fine" in group:
            x, y = near_fine(group, x, y, percent / 100)
        later = group["rep"][x] > group["rep"][y]
        x, y = np.where(later, y, x), np.where(later, x, y)
        yield np.unique(np.stack([group[c][z] for c in ("rep", "component") for z in (x, y)], axis=1), axis=0)
        at = stop


def near_fine(group: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``x`` and ``y`` whose finer sketches are near the threshold, each once."""
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    near_xy = np.zeros(len(pairs), bool)
    for at in range(0, len(pairs), SOME_PAIRS):
        i, j = pairs[at : at + SOME_PAIRS].T
        p, q = group["fine"][i], group["fine"][j]
        rough = np.flatnonzero((p == q).sum(axis=1) >= (target - FINE_SLACK - SPARE) * FINE_REGISTERS)
        if len(rough):
            n = group["n"].astype(float)
            likely = likelihood_estimate(p[rough], q[rough], n[i[rough]], n[j[rough]])
            near_xy[at + rough] = likely >= target - FINE_SLACK
    return pairs[near_xy, 0], pairs[near_xy, 1]


def dealt_shingles(rare: DataFrame, sketched: DataFrame) -> DataFrame:
    """``(token, rep, n, left, indexed, component)`` of shingles in several components, with ``low, high, block, fine``.

    ``low`` and ``high`` are the blocks of a shingle's texts that meet; ``sketched`` has ``rep, fine``.
    """
    shared = rare.groupBy("token").agg(
        F.count(F.lit(1)).alias("rows"), F.max("indexed").alias("any"), F.min("component").alias("first"), F.max("component").alias("last")
    )
    shared = shared.filter("any and first < last").select("token", F.ceil(F.col("rows") / CELL).alias("blocks"))
    placed = rare.join(shared, "token").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    cells = placed.withColumn("other", other).select(
        *rare.columns, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block"
    )
    return cells.join(sketched, "rep")


def met_by_rare_shingles(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b, of_a, of_b`` of ``dealt_shingles`` rows that are near the threshold, each once.

    ``of_a`` and ``of_b`` are their components.
    """
    names = ["token", "low", "high", "block", "rep", "n", "left", "indexed", "component"]
    cell = names[:3]

    def work(batches):
        held: list[dict[str, np.ndarray]] = []

        def settle():
            group = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held.clear()
            if group["low"][0] == group["high"][0]:
                del group["block"]
            for pairs in rare_pairs(group, percent):
                if len(pairs):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pairs[:, k]) for k in range(4)], names=["a", "b", "of_a", "of_b"]
                    )

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)}
            rows["fine"] = registers_of(batch.column(len(names)), FINE_REGISTERS)
            changes = np.any([rows[c][1:] != rows[c][:-1] for c in cell], axis=0)
            starts = [0, *(np.flatnonzero(changes) + 1), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                if held and any(held[-1][c][-1] != rows[c][a] for c in cell):
                    yield from settle()
                held.append({c: column[a:b] for c, column in rows.items()})
        if held:
            yield from settle()

    grouped = rows.select(*names, "fine").repartition(*cell).sortWithinPartitions(*cell)
    return map_batches(grouped, work, "a long, b long, of_a long, of_b long").distinct()


def one_a_component(pairs: DataFrame) -> DataFrame:
    """Of the pairs ``a, b, of_a, of_b`` one for each text and component that it may be linked with."""
    left = pairs.groupBy("a", "of_b").agg(F.min("b").alias("b")).select("a", "b")
    right = pairs.groupBy("b", "of_a").agg(F.min("a").alias("a")).select("a", "b")
    return left.unionByName(right).distinct()


def fine_sketches(texts: DataFrame, words: int) -> DataFrame:
    """``rep, fine``: sketches of many registers."""

    def work(batches):
        for batch in batches:
            rows = sketches(shingle_sets(batch.column(1), words), FINE_REGISTERS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in rows], pa.binary())], names=["rep", "fine"]
            )

    return map_batches(texts.select("doc_id", "text"), work, "rep long, fine binary")


def cross_pairs(unsettled: DataFrame, target: float) -> DataFrame:
    """Near pairs of texts of a bucket that are in different components.

    ``unsettled`` has ``key, rep, component, n, registers, fine``, and no more than ``BLOCK`` rows a key.
    """
    numbers = ["key", "rep", "component", "n"]

    def work(batches):
        held: list[dict[str, np.ndarray]] = []

        def settle():
            group = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held.clear()
            pairs = compared(group, target)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(numbers)}
            rows["registers"] = registers_of(batch.column(len(numbers)))
            rows["fine"] = registers_of(batch.column(len(numbers) + 1), FINE_REGISTERS)
            starts = [0, *(np.flatnonzero(rows["key"][1:] != rows["key"][:-1]) + 1), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:]):
                if held and held[-1]["key"][-1] != rows["key"][a]:
                    yield settle()
                held.append({c: column[a:b] for c, column in rows.items()})
        if held:
            yield settle()

    grouped = unsettled.select(*numbers, "registers", "fine").repartition("key").sortWithinPartitions("key")
    return map_batches(grouped, work, "a long, b long").distinct()


def star(buckets: DataFrame) -> DataFrame:
    """Pairs of each bucket's smallest id with its other ones."""
    hubs = buckets.groupBy("key").agg(F.min("rep").alias("hub"))
    return buckets.join(hubs, "key").filter("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()


def with_component(rows: DataFrame, links: DataFrame) -> DataFrame:
    groups = components(links, "a", "b").withColumnRenamed("node", "rep")
    return rows.join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    prints: bool = False,
) -> DataFrame:
    """Groups of near-duplicate texts: ``doc_id, n_shingles, component_id, kept`` for every row.

    Texts are linked if their sets of word shingles are as similar as ``percent`` says, and grouped by links of
    links. A missing text is an empty one; texts without words are linked with nothing. Rows without an id are left
    out; a repeated id counts as often as it comes, each row by its own text, and ``prints`` adds the ``xxhash64`` of the
    text, which tells such rows apart. Equal sets are known by a 128-bit hash. Bands and slacks are made for ``PERCENT``: they hold above it, but
    would lose links below, so that is an error.
    """
    if percent < PERCENT:
        raise ValueError(f"percent is {percent}; the bands find all links from {PERCENT} on only")
    rows = cut_lineage(sketch_documents(docs, id_col, text_col, words), "sketches")
    full = rows.filter("n_shingles > 0")
    classes = cut_lineage(
        full.groupBy("set_key")
        .agg(
            F.min(F.struct("doc_id", "print")).alias("least"),
            F.first("n_shingles").alias("n"),
            F.first("registers").alias("registers"),
        )
        # Sets have numbers of their own, since texts of one id may differ.
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    threshold = percent / 100 - SLACK
    bands = band_rows(classes)
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
    buckets = cut_lineage(bands.join(hubs.select("key", "hub"), "key"), "buckets")
    crowded = buckets.select("rep").distinct().join(classes, "rep").select("least.*", "rep")
    own = printed_texts(docs, id_col, text_col).join(crowded, ["doc_id", "print"])
    texts = cut_lineage(own.select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    buckets = buckets.select("key", "rep")
    tried = cut_lineage(near(star(buckets), classes, threshold), "stars")
    links = cut_lineage(verified(tried, texts, words, percent), "links")
    labelled = cut_lineage(with_component(buckets, links), "labelled")
    open_keys = labelled.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")
    )
    unsettled = cut_lineage(labelled.join(open_keys.filter("low < high").select("key", "size"), "key"), "unsettled")
    small = unsettled.filter(F.col("size") <= BLOCK)
    asked = texts.join(small.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    members = small.join(classes.select("rep", "n", "registers").join(fine_sketches(asked, words), "rep"), "rep")
    crossing = cut_lineage(cross_pairs(members, percent / 100), "crossing")
    crowd = cut_lineage(unsettled.filter(F.col("size") > BLOCK).select("rep", "component").distinct(), "crowd")
    if not crowd.isEmpty():
        crowded = cut_lineage(texts.join(crowd.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "crowded")
        rare = rare_shingles(crowded, words, percent, shingle_counts(crowded, words)).join(crowd, "rep")
        dealt = dealt_shingles(cut_lineage(rare, "rare"), fine_sketches(crowded, words))
        close = cut_lineage(met_by_rare_shingles(dealt, percent).join(tried, ["a", "b"], "left_anti"), "close")
        # One link joins a text to a component; pairs that are in one component by then need no look at their sets.
        some = cut_lineage(one_a_component(close), "some")
        links = links.unionByName(cut_lineage(verified(some, texts, words, percent), "links"))
        groups = components(links, "a", "b")
        top = {end: groups.select(F.col("node").alias(f"of_{end}"), F.col("component").alias(f"top_{end}")) for end in "ab"}
        rest = close.join(some, ["a", "b"], "left_anti").join(top["a"], "of_a", "left").join(top["b"], "of_b", "left")
        apart = F.coalesce("top_a", "of_a") != F.coalesce("top_b", "of_b")
        crossing = crossing.unionByName(rest.filter(apart).select("a", "b")).distinct()
    more = cut_lineage(verified(crossing.join(tried, ["a", "b"], "left_anti"), texts, words, percent), "links")
    links = links.unionByName(more)
    groups = components(links, "a", "b").withColumnRenamed("node", "rep")
    named = groups.join(classes.select("rep", F.col("least.doc_id").alias("first")), "rep")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("name")), "component").select("rep", "name")

    known = classes.select("set_key", "rep", F.col("least.doc_id").alias("first")).join(named, "rep", "left")
    members = rows.join(known.select("set_key", F.coalesce("name", "first").alias("name")), "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("name"))
    return members.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
        *(["print"] if prints else []),
    )
