"""Near-duplicate documents by BagMinHash signatures, verified on the bags.

A document is the bag (multiset) of its five-word shingles; two documents are
near duplicates when the weighted Jaccard similarity of their bags, the sum of
the smaller counts over the sum of the larger, is at least THRESHOLD.

Signatures. Every shingle has a Poisson process of points over time and
weight. The weight axis is cut into cells [0,1), [1,2), [2,4), [4,8) ...; a
cell's process has the rate of its width, and a bag with count w sees of the
top cell only the points that lie below w. So the points of the smaller count
are exactly those that both bags see. Every point falls to one of SIZE
components, which keeps the earliest; two bags agree in a component with
probability equal to their similarity. Points come in order of time, and a
shingle stops as soon as it is later than the latest component, so the work is
about one point a shingle.

Candidates. Components are banded; documents that share a band's bucket are
candidates. Bags that are equal are one class from the start. In a bucket each
class is compared with the bucket's first class and with the one before it (in
parts of about PART classes where the bucket is large). The links found so far
make components. Where a bucket still holds several of them, the classes
outside its largest are compared with the bucket's other components: directly
in a bucket of up to SMALL classes, and in a larger one through their rarest
shingles. Two bags that reach THRESHOLD must share one of the rarest shingles
that hold a fifth of either bag's weight, so classes of a large bucket that
share none of these need no comparison, nor do those whose weights and places
in the order leave too little to share: a bucket full of texts that only have
a passage in common is not expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, stored, table

SHINGLE = 5
#: Four fifths; _rarest and _reachable count with it in whole numbers.
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SIZE = BANDS * ROWS
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
PART = 256
SMALL = 4
#: Cells of weights in a factor of e, and classes of one shingle that a task compares with the others.
CELLS_A_FACTOR, BLOCK = 32, 4_096
#: Shingles of the texts that a worker handles at once: the bound of its memory.
SLICE = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes half of the output's."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's word shingles in order. A text of fewer words is one shingle of all of them, none if it has no word."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six characters that WORD leaves out
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(width, len(h))):
        out = mixed(out + h[k : k + n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return out


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    return np.unique(shingles(text), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two empty bags 1."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 1.0


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """A row of `size` 64-bit values for each bag. Empty bags get zeros."""
    lengths = [len(b[0]) for b in bags]
    found = np.full(len(bags) * size, np.inf)
    if sum(lengths):
        owner = np.repeat(np.arange(len(bags)), lengths)
        key = np.concatenate([b[0] for b in bags])
        count = np.concatenate([b[1] for b in bags]).astype(np.float64)
        # one process for each cell [low, high) that a count reaches into
        parts = []
        low, high = 0.0, 1.0
        seed = 1
        while True:
            in_cell = count > low
            if not in_cell.any():
                break
            parts.append((owner[in_cell], mixed(key[in_cell] + np.uint64(seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)), count[in_cell], np.full(int(in_cell.sum()), low), np.full(int(in_cell.sum()), high)))
            low, high, seed = high, 2 * high, seed + 1
        owner, state, count, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
        time = np.zeros(len(owner))
        while len(owner):
            state = mixed(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(_uniform(state)) / (high - low)
            live = time < found.reshape(-1, size).max(axis=1)[owner]
            owner, state, count, low, high, time = (c[live] for c in (owner, state, count, low, high, time))
            second = mixed(state ^ np.uint64(0xA0761D6478BD642F))
            seen = low + (high - low) * _uniform(mixed(second)) <= count
            at = owner[seen] * size + (second[seen] % np.uint64(size)).astype(np.int64)
            np.minimum.at(found, at, time[seen])
    found[np.isinf(found)] = 0
    # the last bits of a logarithm may differ between processors
    return ((found.view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16)).reshape(-1, size)


def _sliced(texts: list[str]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of consecutive texts, as bags, of bounded total size."""
    held, start, n = [], 0, 0
    for k, t in enumerate(texts):
        held.append(bag(t))
        n += len(held[-1][0])
        if n >= SLICE:
            yield start, held
            held, start, n = [], k + 1, 0
    if held:
        yield start, held


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        for start, bags in _sliced(texts):
            sig = signatures(bags)
            bands = np.zeros((len(bags), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mixed(bands + sig[:, r::ROWS][:, :BANDS] + np.uint64(r + 1))
            bands = mixed(bands + np.arange(BANDS, dtype=np.uint64))
            print_ = [xxhash.xxh3_128_digest(x.tobytes() + c.tobytes()) for x, c in bags]
            flat = pa.array(bands.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.slice(start, len(bags)), pa.array(print_, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1, dtype=np.int32) * BANDS), flat)], names=["doc_id", "print", "bands"])


def _bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bags for verification: the keys cut to 32 bits, and the counts where any is over 1.

    Two of n shingles agree in 32 bits by chance with probability n * n / 2^33,
    and then move the similarity by 1 / n.
    """
    for b in batches:
        for start, bags in _sliced(b.column(1).to_pylist()):
            keys, counts = [], []
            for x, c in bags:
                short, at = np.unique((x & np.uint64(0xFFFFFFFF)).astype("<u4"), return_inverse=True)
                n = np.bincount(at, c, len(short)).astype("<u4")
                keys.append(short.tobytes())
                counts.append(n.tobytes() if (n > 1).any() else b"")
            yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(bags)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "keys", "counts"])


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, "<u4")
    return k, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(k), np.int64)


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, keys and counts of either) rows to (a, b) of those that reach THRESHOLD."""
    for b in batches:
        left, right = [], []
        for i, j, ka, ca, kb, cb in zip(*(b.column(n).to_pylist() for n in range(6)), strict=True):
            if weighted_jaccard(_unpacked(ka, ca), _unpacked(kb, cb)) >= THRESHOLD:
                left.append(i)
                right.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose bags reach THRESHOLD."""
    one = bags.select(F.col("doc_id").alias("a"), F.col("keys").alias("ka"), F.col("counts").alias("ca"))
    two = bags.select(F.col("doc_id").alias("b"), F.col("keys").alias("kb"), F.col("counts").alias("cb"))
    # merge joins at any size: neither side is bounded
    return pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "ka", "ca", "kb", "cb").mapInArrow(_similar, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), by large-star and small-star rounds until nothing changes."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    seen = mark(edges)
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of a node, and the node, goes to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-links")
        before, seen = seen, mark(edges)
        if before == seen:
            break
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _divided(held: DataFrame, group: str) -> DataFrame:
    """The rows (group, node, root, ...) of groups with several components, with the largest one's root as `main`."""
    sizes = held.groupBy(group, "root").agg(F.count(F.lit(1)).alias("of_root"))
    main = sizes.groupBy(group).agg(F.max(F.struct("of_root", "root")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return held.join(main.select(group, F.col("m.root").alias("main")), group)


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of a small bucket's classes outside its main component with those of its other components."""
    x = rows.filter("root <> main").select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"))
    y = rows.select("bucket", F.col("node").alias("y"), F.col("root").alias("ry"))
    return x.join(y, "bucket").filter("rx <> ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _reachable(rows: DataFrame) -> DataFrame:
    """Pairs (a < b) of a class outside its shingle's main component and one of another component that can still reach THRESHOLD.

    rows: token, node, root, main, weight, left (what a bag's weight is from
    the shingle on, in the order of rarity), often. Bags of weights v and w
    reach it only if they share 4 / 9 of v + w, so only if neither is under
    4 / 5 of the other and both have as much left from the first shingle that
    they share. A bag therefore looks for weights from 4 / 5 w up to
    9 / 4 left - w: weights are dealt into narrow cells, and it goes to the
    cells of that range only, which are none where too little is left. The
    classes of a very frequent shingle are dealt over several tasks, each of
    which sees all possible partners.
    """
    cell = lambda w: F.floor(F.log(w) * CELLS_A_FACTOR).cast("int")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("often") / BLOCK)).cast("int")
    rows = rows.withColumn("lowest", F.ceil(F.col("weight") * 4 / 5)).withColumn("highest", F.least(F.floor(F.col("weight") * 5 / 4), F.floor(F.col("left") * 9 / 4) - F.col("weight"))).filter("highest >= lowest")
    x = (
        rows.filter("root <> main")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        .select("token", "block", F.explode(F.sequence(cell(F.col("lowest")), cell(F.col("highest")))).alias("cell"), F.col("node").alias("x"), F.col("root").alias("rx"), "lowest", "highest", F.col("weight").alias("wx"))
    )
    y = rows.select("token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), cell(F.col("weight")).alias("cell"), F.col("node").alias("y"), F.col("root").alias("ry"), "main", F.col("weight").alias("wy"), F.col("highest").alias("highest_y"))
    met = (F.col("rx") != F.col("ry")) & F.col("wy").between(F.col("lowest"), F.col("highest")) & (F.col("wx") <= F.col("highest_y")) & ((F.col("ry") == F.col("main")) | (F.col("y") < F.col("x")))
    return x.join(y, ["token", "block", "cell"]).filter(met).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for node, root, keys, counts in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
            k, c = _unpacked(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), node)), pa.array(np.full(len(k), root)), pa.array(k.astype(np.int64)), pa.array(c)], names=["node", "root", "token", "count"])


def _rarest(nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """node, root, token, weight, left, often: of every bag the shingles, rarest first, without which less than THRESHOLD of its weight remains."""
    rows = nodes.join(bags, F.col("node") == F.col("doc_id")).select("node", "root", "keys", "counts").mapInArrow(_tokens, "node long, root long, token long, count long")
    rows = stored(rows, "near-tokens")
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    in_bag = Window.partitionBy("node")
    before = in_bag.orderBy("often", "token").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("weight", F.sum("count").over(in_bag))
    return ranked.filter((F.col("before") <= F.col("weight") - F.floor((4 * F.col("weight") + 4) / 5)) & (F.col("often") > 1)).select("node", "root", "token", "weight", (F.col("weight") - F.col("before")).alias("left"), "often")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id that links lead to), class_size, kept (the row is that one).

    Null and texts without words have equal, empty bags: one class. A text of
    fewer than five words is one shingle. Rows that repeat an id count as one
    document with the smallest of their bags' prints, and every such row gets
    the same result; rows with a null id are classes of their own (class_id
    null, class_size 1, kept). An empty table gives an empty result; further
    columns are not read.
    """
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = stored(texts.filter("doc_id is not null").mapInArrow(_signed, "doc_id long, print binary, bands array<long>"), "near-signatures")
    one_row_each = signed.count() == signed.select("doc_id").distinct().count()
    if not one_row_each:  # of rows that repeat an id the one with the smallest print speaks
        signed = stored(signed.groupBy("doc_id").agg(F.min(F.struct("print", "bands")).alias("s")).select("doc_id", "s.*"), "near-signatures")
    # equal bags are a class from the start; its smallest id speaks for it
    firsts = stored(signed.groupBy("print").agg(F.min(F.struct("doc_id", "bands")).alias("first")).select("print", F.col("first.doc_id").alias("rep"), F.col("first.bands").alias("bands")), "near-classes")
    members = signed.select("doc_id", "print").join(firsts.select("print", "rep"), "print").select("doc_id", "rep")

    buckets = firsts.select("rep", F.explode("bands").alias("bucket")).distinct()
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("first")).filter("n > 1")
    # one row a bucket on that side, so Spark may split a bucket with many rows
    shared = stored(buckets.join(sizes, "bucket"), "near-buckets")
    # a large bucket is chained in parts; its first class joins the parts
    in_part = Window.partitionBy("bucket", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / PART))).orderBy("rep")
    chained = shared.withColumn("before", F.lag("rep").over(in_part))
    pairs = chained.select(F.explode(F.array_distinct(F.array("before", "first"))).alias("a"), F.col("rep").alias("b"))
    tested = stored(pairs.filter("a < b").distinct(), "near-pairs")
    nodes = shared.select(F.col("rep").alias("node")).distinct()
    wanted = texts.join(nodes.hint("merge"), F.col("doc_id") == F.col("node"), "left_semi")
    bags = stored(wanted.mapInArrow(_bags_of, "doc_id long, keys binary, counts binary"), "near-bags")
    bags = bags if one_row_each else bags.dropDuplicates(["doc_id"])
    links = stored(verified(tested, bags), "near-links")

    roots = stored(components(nodes, links), "near-roots")
    held = shared.select("bucket", F.col("rep").alias("node"), "n").join(roots, "node")
    open_ = stored(_divided(held, "bucket"), "near-open")
    more = _across(open_.filter(F.col("n") <= SMALL))
    large = open_.filter(F.col("n") > SMALL).select("node", "root").distinct()
    more = more.unionByName(_reachable(_divided(_rarest(large, bags), "token")))
    more = stored(more.distinct().join(tested, ["a", "b"], "left_anti"), "near-pairs")
    more = stored(verified(more, bags), "near-links")
    if not more.isEmpty():
        roots = stored(components(nodes, links.unionByName(more)), "near-roots")

    classes = members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    counted = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    found = classes.join(counted, "class_id")
    rows = texts.select("doc_id")
    return rows.join(found, "doc_id", "left").select(
        "doc_id",
        "class_id",
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, one of each class, all columns unchanged. Rows with a null id and rows that repeat a kept id stay."""
    gone = near_classes(docs, key, text).filter("not kept").select(F.col("doc_id").alias("near_gone")).distinct()
    return docs.join(gone.hint("merge"), docs[key].cast("long") == gone["near_gone"], "left_anti")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spread(table(spark, sf_dir, "documents")))
