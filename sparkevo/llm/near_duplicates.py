"""N-gram Jaccard join: MinHash LSH forest with exact verification, and near-duplicate classes from its links.

A text is the set of its runs of ``SHINGLE`` words. Texts with equal sets form a class of copies, of which one
stands for all. Classes are indexed in ``TREES`` prefix tries: each tree has its own ``LONGEST`` MinHash values, 16 bits
of each, so that the first d of them are a prefix of a sortable signature. Classes at one node are candidates.

Prefixes are shortened from the longest as far as ``depth``, where a pair at the threshold shares one in some tree
with probability ``RECALL``; but not into a node of more than ``CROWD`` classes of which less than a quarter of the
pairs share a longest prefix: such a crowd is no family of copies, and its classes stay apart by longer prefixes. A class whose prefixes are then too
long for the target recall stands in ``FURTHER`` more trees, by longest prefixes, where it meets all others of the kind.
(A pair with one class that needs no more trees meets with the target recall, as both stand at the same nodes.)

Candidates of a node are compared exactly, whatever their number: a node with many classes is dealt into
blocks of ``BLOCK``, every pair of blocks is a task of its own, and a task counts common shingles as a product
of 0/1 matrices. Of nodes with the same classes one is taken, and a pair that meets in several trees counts in the
first. Pairs are never written
out: a task returns for each class the number of its links and the local component it belongs to, so rows grow
with classes, not with pairs. Components are then joined by star contraction over these edges, written to the
shared folder at each step.

Defined cases: a text of fewer words than a shingle has one shingle, all its words, and so links to equal texts
alone; texts without words, nulls included, are copies of each other; rows that repeat a doc_id are rows of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from . import common

SHINGLE, THRESHOLD = 5, 0.8
TREES, LONGEST, RECALL = 16, 8, 0.9995
#: Classes of a node that may be a crowd, and trees in which those of crowds stand besides.
CROWD, FURTHER = 1024, 32
BLOCK, SEED, SALTS = 256, 42, 16


def depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, longest: int = LONGEST) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with probability recall."""
    d = longest
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    _, _, words, first = common.word_hashes(data, offsets)
    runs = common.mix(common.rolling(words, width, "window"), width)
    for a, b in zip(first, first[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield common.mix(common.rolling(words[a:b], int(b - a), "window")[:1] if b > a else np.zeros(1, np.uint64), 1000 + int(b - a))


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    return b"".join(int(common.mix(shingles, salt).sum(dtype=np.uint64)).to_bytes(8, "big") for salt in (0xA5A5, 0x5A5A))


class Forest:
    """Signatures of sets: in each tree LONGEST MinHash values of 16 bits, packed in two 64-bit integers."""

    def __init__(self, trees: int, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.trees = trees
        self.a = (random.integers(0, 2**31, trees * LONGEST) * 2 + 1).astype(np.uint32)[:, None]
        self.b = random.integers(0, 2**32, trees * LONGEST).astype(np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The first half of each tree's values, as one integer a tree, then the second."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.trees * LONGEST, 2**32 - 1, np.uint32)
        for at in range(0, len(x), 2048):
            grid = self.a * x[None, at : at + 2048]
            grid += self.b
            least = np.minimum(least, grid.min(1))
        # the order of a product's low bits is poor, so values are mixed before 16 bits of them are taken
        short = (common.mix(least.astype(np.uint64)) >> np.uint64(48)).astype(">u2").reshape(self.trees, 2, LONGEST // 2)
        return np.ascontiguousarray(short.transpose(1, 0, 2)).view(">i8").ravel().astype(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("cls", pa.binary()), ("signature", pa.list_(pa.int64()))])


def _sketch(width: int, trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(trees, seed)
        for batch in batches:
            for rows, data, offsets in common.text_slices(batch):
                cls, signature = [], []
                for s in shingle_sets(data, offsets, width):
                    cls.append(class_key(s))
                    signature.append(forest.signature(s))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(cls, pa.binary()), pa.array(signature, pa.list_(pa.int64()))], schema=_SKETCH)

    return run


def sketch(docs: DataFrame, width: int = SHINGLE, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, cls (key of the shingle set) and signature (see Forest) of every row."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return named.mapInArrow(_sketch(width, trees, seed), "doc_id bigint, text_key bigint, cls binary, signature array<bigint>")


def prefix(signature: Column | str, tree: Column, trees: int, length: Column | int) -> Column:
    """The first length values of a tree's signature, as one integer; those of another length are others."""
    half = LONGEST // 2
    if isinstance(length, int):
        length = F.lit(length)
    first, second = F.get(signature, tree), F.get(signature, tree + F.lit(trees))
    cut = lambda x, n: F.call_function("shiftright", x, (F.lit(half) - n) * 16)
    return F.when(length <= half, F.xxhash64(cut(first, length), length)).otherwise(F.xxhash64(first, cut(second, length - half), length))


_SETS = pa.schema([("cls", pa.binary()), ("body", pa.binary())])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.text_slices(batch):
                cls, body = [], []
                for want, s in zip(rows.column("cls").to_pylist(), shingle_sets(data, offsets, width)):
                    if class_key(s) == want:  # a doc_id may stand at other texts too
                        cls.append(want)
                        body.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(body, pa.binary())], schema=_SETS)

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray], tile: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left and each right set, as products of 0/1 matrices by tiles of shingles."""
    flat = np.concatenate(left + right)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    shared = ~(new & np.append(new[1:], True))  # shingles of one set alone can't be common
    column = np.cumsum(new[shared]) - 1
    owner = owner[shared]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, tile):
        a, b = np.searchsorted(column, (at, at + tile))
        grid = np.zeros((len(left) + len(right), tile), np.float32)
        grid[owner[a:b], column[a:b] - at] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


_LINKS = pa.schema([("cls", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])


def _linked(rows: list[dict], threshold: float) -> list[tuple[bytes, bytes, int]]:
    """(class, root of its component here, links first met here) of the classes of one pair of blocks."""
    tree, lo, hi = rows[0]["tree"], rows[0]["lo"], rows[0]["hi"]
    own = {r["cls"]: r for r in rows}  # repeated rows bring a class more than once
    left = [r for r in own.values() if r["own"] == lo]
    right = [r for r in own.values() if r["own"] == hi]
    if not left or not right or (lo == hi and len(left) < 2):
        return []
    size_a, size_b = (np.array([len(r["body"]) // 8 for r in side]) for side in (left, right))
    # No pair of a far smaller and a larger set is near.
    good = np.minimum.outer(size_a, size_b) >= threshold * np.maximum.outer(size_a, size_b) - 1e-9
    if lo == hi:
        good &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    keys_a, keys_b = (np.array([r["keys"][:tree] for r in side], np.int64).reshape(len(side), tree) for side in (left, right))
    for t in range(tree):  # met there already
        good &= keys_a[:, t, None] != keys_b[None, :, t]
    rows, cols = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
    if not len(rows):
        return []
    a, b = ([np.frombuffer(side[i]["body"], np.uint64) for i in at] for side, at in ((left, rows), (right, cols)))
    both = common_counts(a, b)
    good[np.ix_(rows, cols)] &= both >= threshold * (size_a[rows, None] + size_b[None, cols] - both) - 1e-9
    names = [r["cls"] for r in left] + ([] if lo == hi else [r["cls"] for r in right])
    shift = 0 if lo == hi else len(left)
    n, parent = np.zeros(len(names), np.int64), list(range(len(names)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at_i, at_j = np.nonzero(good)
    np.add.at(n, at_i, 1)
    np.add.at(n, at_j + shift, 1)
    for i, j in zip(at_i.tolist(), (at_j + shift).tolist()):
        x, y = top(i), top(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
    least: dict[int, bytes] = {}
    for k in np.flatnonzero(n):
        least[top(k)] = min(least.get(top(k), names[k]), names[k])
    return [(names[k], least[top(k)], int(n[k])) for k in np.flatnonzero(n)]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out = []
        for _, own in groupby(rows, lambda r: (r["tree"], r["key"], r["lo"], r["hi"])):
            out += _linked(list(own), threshold)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(_LINKS.names, map(list, zip(*out)))), schema=_LINKS)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_LINKS.names, map(list, zip(*out)))), schema=_LINKS)

    return run


def _nodes(entries: DataFrame) -> DataFrame:
    """tree, key and m, the classes, of the nodes of entries (cls, tree, key) with several; one of nodes of the same classes."""
    alike = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    several = entries.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m"), *alike).filter("m > 1")
    return several.groupBy("m", "x0", "x1").agg(F.min(F.struct("tree", "key")).alias("node")).select("node.tree", "node.key", "m")


def forest(docs: DataFrame, classes: DataFrame, width: int, threshold: float, trees: int, recall: float, seed: int) -> DataFrame:
    """cls, doc_id, text_key and keys: the node in which each class stands in each tree, TREES or with the FURTHER ones."""
    short = depth(threshold, trees, recall)
    at_tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    plain = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: prefix("signature", t, trees, short))
    standing = classes.select("cls", "doc_id", "text_key", plain.alias("keys"))
    entries = classes.select("cls", "signature", at_tree).withColumn("key", prefix("signature", F.col("tree"), trees, short))
    crowds = entries.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CROWD)
    crowds = common.saved(crowds, "crowds")
    if crowds.isEmpty() or short == LONGEST:
        return standing
    open_ = common.saved(entries.join(crowds.drop("m"), ["tree", "key"]), "crowded")
    # A family of copies stays together at longer prefixes and gains nothing by them; a crowd falls apart.
    leaves = open_.groupBy("tree", "key", prefix("signature", F.col("tree"), trees, LONGEST).alias("leaf")).agg(F.count(F.lit(1)).alias("n"))
    parted = leaves.groupBy("tree", "key").agg(F.sum("n").alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    parted = parted.filter(4 * F.col("pairs") <= F.col("m").cast("double") * F.col("m")).select("tree", "key")
    open_, done = open_.join(parted, ["tree", "key"], "left_semi"), None
    for length in range(short + 1, LONGEST + 1):
        open_ = open_.withColumn("key", prefix("signature", F.col("tree"), trees, length))
        large = open_.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > CROWD).select("tree", "key", F.lit(True).alias("large"))
        open_ = common.saved(open_.join(large, ["tree", "key"], "left"), "crowded")
        stay = open_ if length == LONGEST else open_.filter(F.col("large").isNull())
        stay = stay.select("cls", "tree", "key", F.lit(length).alias("length"))
        done = stay if done is None else done.unionByName(stay)
        open_ = open_.filter("large").drop("large")
    miss = F.sum(F.log(1 - F.pow(F.lit(threshold), "length")) - F.lit(float(np.log(1 - threshold**short)))) + F.lit(trees * float(np.log(1 - threshold**short)))
    moved = done.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("moved"), (miss > F.lit(float(np.log(1 - recall)))).alias("needs_more"))
    moved = common.saved(moved, "moved")
    needs_more = classes.select("cls", "doc_id", "text_key").join(moved.filter("needs_more").select("cls"), "cls", "left_semi")
    more = sketch(_texts_of(docs, needs_more), width, FURTHER, seed + 1).select("cls", F.transform(F.sequence(F.lit(0), F.lit(FURTHER - 1)), lambda t: prefix("signature", t, FURTHER, LONGEST)).alias("more")).dropDuplicates(["cls"])
    joined = standing.join(moved.select("cls", "moved"), "cls", "left").join(more, "cls", "left")
    own = F.when(F.col("moved").isNull(), F.col("keys")).otherwise(F.transform("keys", lambda k, t: F.coalesce(F.element_at("moved", t), k)))
    return joined.select("cls", "doc_id", "text_key", F.when(F.col("more").isNull(), own).otherwise(F.concat(own, "more")).alias("keys"))


def _texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, text and cls: a text of each of classes (cls, doc_id, text_key)."""
    least = F.lit(-(2**63))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Rows without an id may be many: they are made distinct first, and the key holds the text's hash as well.
    texts = texts.filter("doc_id is not null").unionByName(texts.filter("doc_id is null").distinct())
    texts = texts.select(F.coalesce("doc_id", least).alias("id"), F.xxhash64("text").alias("text_key"), "text")
    wanted = classes.select("cls", F.coalesce("doc_id", least).alias("id"), "text_key")
    return texts.join(wanted, ["id", "text_key"]).select(F.col("id").alias("doc_id"), "text", "cls")


def links(docs: DataFrame, standing: DataFrame, width: int, threshold: float) -> DataFrame:
    """cls, root and links of classes (of forest) that have any, some rows a class."""
    n = common.shuffle_partitions(docs.sparkSession, docs)
    entries = standing.select("cls", F.posexplode("keys").alias("tree", "key"))
    members = common.saved(entries.join(_nodes(entries), ["tree", "key"]), "members")
    wanted = standing.select("cls", "doc_id", "text_key", "keys").join(members.select("cls").distinct(), "cls", "left_semi")
    sets = _texts_of(docs, wanted).select("cls", "text").mapInArrow(_sets(width), "cls binary, body binary")
    blocks = F.ceil(F.col("m") / BLOCK)
    dealt = (
        members.withColumn("own", F.pmod(F.xxhash64("cls"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .select("cls", "tree", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own")
    )
    return (
        dealt.join(wanted.select("cls", "keys"), "cls")
        .join(sets, "cls")
        .repartition(n, "tree", "key", "lo", "hi")
        .sortWithinPartitions("tree", "key", "lo", "hi")
        .select("cls", "tree", "key", "lo", "hi", "own", "keys", "body")
        .mapInArrow(_verify(threshold), "cls binary, root binary, links bigint")
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component, of edges (u, v); by alternating star contraction."""
    edges = common.saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        for large in (True, False):
            # large star: greater neighbours of a node move to the least of its neighbourhood; small star: the others
            sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
            # The centre of a large star is one key with many edges: edges are dealt out by a salt as well.
            salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = sides.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")
            if large:
                moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                moved = met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            old, edges = edges, common.saved(moved.filter("u <> v").distinct(), "edges")
            common.discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _classified(docs: DataFrame, width: int, threshold: float, trees: int, recall: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """doc_id and cls of every row, and cls, class_id, head, n_links and n_copies of every class."""
    common.prepare(docs.sparkSession)
    sketched = common.saved(sketch(docs, width, trees, seed), "sketch")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key"))
    classes = sketched.groupBy("cls").agg(least.alias("head"), F.count(F.lit(1)).alias("n_copies"), F.first("signature").alias("signature"))
    classes = common.saved(classes.select("cls", "head.doc_id", "head.text_key", "n_copies", "signature"), "classes")
    standing = common.saved(forest(docs, classes, width, threshold, trees, recall, seed), "forest")
    linked = common.saved(links(docs, standing, width, threshold), "links")
    counts = linked.groupBy("cls").agg(F.sum("links").alias("n_links"))
    labels = components(linked.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "label")
    known = classes.select("cls", "doc_id", "n_copies").join(counts, "cls", "left").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    heads = known.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cls")).alias("head"))
    info = known.join(heads, "label").select("cls", F.col("head.doc_id").alias("class_id"), F.col("head.cls").alias("head"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return sketched.select("doc_id", "cls"), info


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row of docs (doc_id, text).

    class_id is the least doc_id among all that links join, directly or not; n_links counts the different
    shingle sets with a Jaccard similarity of threshold or more; n_copies the rows with this very set.
    """
    sketched, info = _classified(docs, width, threshold, trees, recall, seed)
    return sketched.join(info, "cls").select("doc_id", "class_id", "n_links", "n_copies")


def _with_class(width: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in common.text_slices(batch):
                cls = pa.array([class_key(s) for s in shingle_sets(data, offsets, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, cls], names=[*rows.schema.names, name])

    return run


def deduplicate(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate class: one with the least doc_id."""
    _, info = _classified(docs, width, threshold, trees, recall, seed)
    lowest = F.lit(-(2**63))
    cls, own, number = (common.free(docs, c) for c in ("cls_", "own_", "number_"))
    heads = info.filter(F.col("cls") == F.col("head")).select(F.col("cls").alias(cls), F.coalesce("class_id", lowest).alias(own))
    marked = docs.mapInArrow(_with_class(width, cls), StructType([*docs.schema.fields, StructField(cls, BinaryType())]))
    kept = marked.withColumn(own, F.coalesce(F.col("doc_id").cast("bigint"), lowest)).join(heads, [cls, own])
    # Repeated rows are rows of the same class and doc_id; the join has brought them together.
    one = Window.partitionBy(cls, own).orderBy("text")
    return kept.withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1).select(*docs.columns)
