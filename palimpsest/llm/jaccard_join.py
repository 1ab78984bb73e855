"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Each text becomes the set of its word shingles; texts with equal sets are one *node*.
2. A node's signature is cut into trees. All paths of a tree are sorted, so that its prefix trie lies in the order of
   rows: neighbours in that order tell how deep a path has company, and the sizes of its trie nodes are counted.
3. Each node walks from full depth up, a level of one tree at a time, and shortens the prefix that costs least by the
   measured sizes, until its trees together reach the target recall for a pair at the threshold. A prefix that very
   many texts share stays long, and other trees are shortened in its place.
4. The members of a chosen trie node are compared in blocks, by whole signatures first; only texts with a likely
   partner there are compared by their exact shingle sets. A pair that meets in several trees belongs to the first.
   A trie node of g members makes ``g * ceil(g / BLOCK)`` rows, never its pairs. Blocks return link counts and a
   spanning forest, and the forest's components are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components, keyed
from palimpsest.llm.textops import Words, map_arrow, mix, shared_checkpoints, shingle_hashes, texts_of

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Trees of the forest, and the longest and shortest prefix of a path.
TREES, DEEPEST, SHALLOWEST = 20, 8, 4
#: Members up to which all trie nodes cost alike. One partner more or less must not decide which prefix is shortened,
#: or the estimate of recall would not hold for it.
CROWD = 256
#: Members of a block; standard deviations below the threshold at which signatures still make a pair likely.
BLOCK, SLACK = 256, 3.5


def shorten(sizes: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> np.ndarray:
    """Prefix length of each tree (n, trees) for nodes whose trie nodes have ``sizes`` (n, trees, depths SHALLOWEST to DEEPEST).

    Estimated recall: a pair at the threshold shares a prefix of d values of one tree with probability threshold ** d.
    """
    n, trees, _ = sizes.shape
    gain = -np.log1p(-(threshold ** np.arange(SHALLOWEST, DEEPEST + 1)))
    cost = np.maximum(sizes, CROWD).astype(np.float64)
    level = np.full((n, trees), DEEPEST - SHALLOWEST)
    enough = -math.log(1 - recall)
    rows = np.arange(n)
    while True:
        todo = (gain[level].sum(1) < enough) & (level > 0).any(1)
        if not todo.any():
            return level + SHALLOWEST
        price = np.take_along_axis(cost, np.maximum(level - 1, 0)[:, :, None], 2)[:, :, 0] * (DEEPEST + 1) - level
        price[level == 0] = np.inf
        step = price.argmin(1)
        level[rows[todo], step[todo]] -= 1


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Rows of n 32-bit minima, for the texts that have shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), n), np.uint32)
    for j, (a, b) in enumerate(zip(*hash_family(n))):
        if len(starts):
            out[:, j] = np.minimum.reduceat(((values * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def node_ids(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each shingle set, for the texts that have shingles."""
    sizes = np.diff(bounds)
    starts = bounds[:-1][sizes > 0]
    if not len(starts):
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(values), starts) + sizes[sizes > 0].astype(np.uint64)).view(np.int64)


def digest(text: str) -> F.Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest")


def sketches(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """``doc_id``, ``digest`` of the text, ``node`` (null for a text without words) and ``sig``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_hashes(Words(texts_of(batch.column(1))), shingle)
        some = np.diff(bounds) > 0
        node = np.zeros(len(some), np.int64)
        node[some] = node_ids(values, bounds)
        rows = iter(signatures(values, bounds, width))
        sig = [next(rows).tobytes() if s else None for s in some]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, mask=~some), pa.array(sig, pa.binary())], ["doc_id", "digest", "node", "sig"])

    return map_arrow(docs.select("doc_id", F.lower("text").alias("text"), digest("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, digest string, node bigint, sig binary")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node`` and ``shingles`` (sorted 64-bit hashes as binary) of texts with words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_hashes(Words(texts_of(batch.column(0))), shingle)
        some = np.diff(bounds) > 0
        sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1][some], bounds[1:][some])]
        return pa.RecordBatch.from_arrays([pa.array(node_ids(values, bounds)), pa.array(sets, pa.binary())], ["node", "shingles"])

    return map_arrow(docs.select("text"), run, "node bigint, shingles binary")


def paths(nodes: DataFrame, trees: int) -> DataFrame:
    """(node, tree, ids): names of the trie nodes of a path, from SHALLOWEST down as far as it has company.

    The paths of all trees are sorted over the cluster by range, the node last, so that a prefix shared by very many
    texts spreads over tasks. The first and the last path of a task, whose other neighbour is not seen, count as having company.
    """
    cut = F.array(*[F.substring("sig", 1 + t * DEEPEST * 4, DEEPEST * 4) for t in range(trees)])
    rows = nodes.select(F.posexplode(cut).alias("tree", "path"), "node")
    ordered = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")

    def company(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values each path shares with the path of the same row, from the first on (column 0 is the tree)."""
        return np.minimum(np.cumprod(a == b, 1).sum(1) - 1, DEEPEST)

    def of(values: np.ndarray, node: np.ndarray, depth: np.ndarray):
        keep = depth >= SHALLOWEST
        values, node, depth = values[keep], node[keep], depth[keep]
        ids, acc = [], values[:, 0].astype(np.uint64)
        for d in range(1, DEEPEST + 1):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + values[:, d].astype(np.uint64) + np.uint64(1))
            if d >= SHALLOWEST:
                ids.append(acc)
        named = np.stack(ids, 1).view(np.int64)
        inside = np.arange(SHALLOWEST, DEEPEST + 1)[None, :] <= depth[:, None]
        bounds = pa.array(np.r_[0, np.cumsum(inside.sum(1))], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(values[:, 0].astype(np.int32)), pa.ListArray.from_arrays(bounds, pa.array(named[inside]))], ["node", "tree", "ids"])

    def run(batches):
        held = None  # the last path so far, and its company before it
        for batch in batches:
            if not batch.num_rows:
                continue
            path = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, DEEPEST)
            values = np.concatenate([batch.column(0).to_numpy()[:, None].astype(np.int64), path.astype(np.int64)], 1)
            node, before = batch.column(2).to_numpy(), np.zeros(0, np.int64)
            if held is not None:
                values, node, before = np.concatenate([held[0], values]), np.r_[held[1], node], held[2]
            near = company(values[1:], values[:-1])
            before = np.r_[before if len(before) else [DEEPEST], near]
            yield of(values[:-1], node[:-1], np.maximum(before[:-1], near))
            held = values[-1:], node[-1:], before[-1:]
        if held is not None:
            yield of(held[0], held[1], np.array([DEEPEST]))

    return ordered.mapInArrow(run, "node bigint, tree int, ids array<bigint>")


def chosen(sized: DataFrame, trees: int, threshold: float, recall: float) -> DataFrame:
    """(id): the trie nodes that some node's prefixes end at, from rows (node, steps): array of (tree, depth, id, size)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            tree, depth, ids, size = (lists.flatten().field(i).to_numpy() for i in range(4))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            sizes = np.ones((len(lists), trees, DEEPEST - SHALLOWEST + 1), np.int64)
            sizes[row, tree, depth - SHALLOWEST] = size
            ends = shorten(sizes, threshold, recall)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[depth == ends[row, tree]]))], ["id"])

    return sized.select("steps").mapInArrow(run, "id bigint").distinct()


def members_of(nodes: DataFrame, trees: int, threshold: float, recall: float) -> DataFrame:
    """(node, tries): array of (tree, id, size) of the trie nodes in which a node is compared, one a tree at most.

    Of a path's chosen trie nodes the shallowest holds the others' members. Trie nodes with the same members are compared once.
    """
    steps = paths(nodes, trees).checkpoint().select("node", "tree", F.posexplode("ids").alias("depth", "id")).withColumn("depth", F.col("depth") + SHALLOWEST)
    crowds = steps.groupBy("id").agg(F.count("*").alias("size")).where("size > 1")
    known = keyed(steps, "id").join(keyed(crowds, "id").drop("id"), "k").drop("k")
    by_node = known.groupBy("node").agg(F.collect_list(F.struct("tree", "depth", "id", "size")).alias("steps"))
    ends = chosen(by_node, trees, threshold, recall)
    met = keyed(steps, "id").join(keyed(ends, "id").drop("id"), "k").groupBy("node", "tree").agg(F.min(F.struct("depth", "id")).alias("end")).select("node", "tree", "end.id").checkpoint()
    tries = met.groupBy("id").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("who")).where("size > 1")
    tries = tries.groupBy("who", "size").agg(F.min("id").alias("id")).select("id", "size")
    own = keyed(met, "id").join(keyed(tries, "id").drop("id"), "k")
    return own.groupBy("node").agg(F.collect_list(F.struct("tree", "id", "size")).alias("tries"))


def block_pairs(members: DataFrame, group: str, size: str) -> DataFrame:
    """Deals the members of each group into pairs of blocks: adds ``pair`` (a block pair's name) and ``side``.

    Blocks hold about BLOCK members, by hash of the node. A pair of equal blocks has one side, 0; all others 0 and 1.
    """
    parts = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", group), parts).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("pair", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other")


def by_pair(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on the rows of each ``pair``, as numpy and Python columns; it returns a list of rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        pending = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            if pending is not None:
                held = pa.concat_tables([pending, held])
            keys = held.column(0).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if not len(cuts):
                pending = held
                continue
            pending = held.slice(int(cuts[-1]))
            yield from handle(held.slice(0, int(cuts[-1])), np.r_[0, cuts])
        if pending is not None and pending.num_rows:
            yield from handle(pending, np.array([0, pending.num_rows]))

    def handle(held: pa.Table, cuts: np.ndarray):
        keys, side, tree, node, weight = (held.column(i).to_numpy() for i in range(5))
        tries, data = held.column(5).to_pylist(), held.column(6).to_pylist()
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                mine = comparable(side[a:b]) & first_met(tries[a:b], int(tree[a]))
                rows += fn(int(keys[a]), side[a:b], node[a:b], weight[a:b], data[a:b], mine)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)

    return df.select("pair", "side", "tree", "node", "weight", "ids", "data").repartition("pair").sortWithinPartitions("pair").mapInArrow(run, schema)


def first_met(tries: list[list[int]], tree: int) -> np.ndarray:
    """Which pairs share no trie node of a tree before this one (0: none in that tree)."""
    ids = np.array(tries, np.int64)
    met = np.zeros((len(ids), len(ids)), bool)
    for column in ids[:, :tree].T:
        if column.any():
            met |= (column[:, None] == column[None, :]) & (column != 0)[:, None]
    return ~met


def comparable(side: np.ndarray) -> np.ndarray:
    """Which pairs of a block pair's members are its own: all pairs of one side, or those across two."""
    across = side[:, None] != side[None, :]
    return across if side.any() and not side.all() else ~np.eye(len(side), dtype=bool)


def local_roots(linked: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The least node that each node reaches."""
    root = node.copy()
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], root.max()).min(1))
        if (least == root).all():
            return root
        root = least


def likely(width: int, threshold: float):
    floor = (threshold - SLACK * (threshold * (1 - threshold) / width) ** 0.5) * width

    def partners(pair, side, node, weight, data, mine) -> list[tuple[int, int, int]]:
        sig = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), width)
        same = np.zeros((len(data), len(data)), np.int16)
        for column in sig.T:
            same += column[:, None] == column[None, :]
        some = ((same >= floor) & mine).any(1)
        return [(pair, int(s), int(n)) for s, n in zip(side[some], node[some])]

    return partners


def verified(threshold: float):
    def links(pair, side, node, weight, data, mine) -> list[tuple[int, int, int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in data]
        sizes = np.array([len(s) for s in sets])
        common = overlaps(sets)
        union = sizes[:, None] + sizes[None, :] - common
        linked = (common >= threshold * union - 1e-9) & mine
        root = local_roots(linked, node)
        texts = linked.sum(1)
        docs = linked.astype(np.int64) @ weight
        return [(int(n), int(r), int(t), int(d)) for n, r, t, d in zip(node, root, texts, docs) if t]

    return links


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of the incidence matrix over shingles that occur more than once."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m == 2:
        both = np.sort(np.concatenate(sets))
        out[0, 1] = out[1, 0] = int((both[1:] == both[:-1]).sum())
    else:
        _, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        shared = counts > 1
        number = np.cumsum(shared) - 1
        keep = shared[index]
        row, column = row[keep], number[index[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        step = 4096
        for start in range(0, int(shared.sum()), step):
            a, b = np.searchsorted(column, [start, start + step])
            part = np.zeros((m, step), np.float32)
            part[row[a:b], column[a:b] - start] = 1
            out += (part @ part.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked(docs: DataFrame, threshold: float, shingle: int, recall: float, trees: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (node, rep, weight, class, texts, docs) of all nodes: class names a component, counts are of links."""
    shared_checkpoints(docs.sparkSession)
    width = trees * DEEPEST
    own = sketches(docs, shingle, width).checkpoint()
    nodes = own.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("sig").alias("sig")).checkpoint()
    members = members_of(nodes, trees, threshold, recall).join(nodes, "node")
    by_tree = F.map_from_entries(F.transform("tries", lambda x: F.struct(x["tree"], x["id"])))
    aligned = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.coalesce(F.try_element_at(by_tree, t), F.lit(0).cast("bigint")))
    members = members.select("node", "rep", "weight", F.col("sig").alias("data"), aligned.alias("ids"), "tries").checkpoint()
    dealt = block_pairs(members.select("node", "weight", "data", "ids", F.explode("tries").alias("t")).select("*", "t.tree", "t.id", "t.size").drop("t"), "id", "size")
    near = by_pair(dealt, likely(width, threshold), "pair bigint, side bigint, node bigint").checkpoint()
    partners = near.select("node").distinct()
    texts = docs.select("doc_id", F.lower("text").alias("text")).join(members.join(partners, "node").select("rep").distinct(), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    sets = shingle_sets(texts, shingle).groupBy("node").agg(F.first("shingles").alias("data")).join(partners, "node")
    again = dealt.select("node", "weight", "ids", "tree", "pair", "side").join(near.select("pair", "node"), ["pair", "node"]).join(sets, "node")
    exact = by_pair(again, verified(threshold), "node bigint, root bigint, texts bigint, docs bigint").checkpoint()
    classes = components(exact, "node", "root").withColumnRenamed("root", "class")
    counts = exact.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    named = nodes.select("node", "rep", "weight").join(classes, "node", "left").join(counts, "node", "left")
    return own, named.select("node", "rep", "weight", F.coalesce("class", "node").alias("class"), F.coalesce("texts", F.lit(0)).cast("bigint").alias("texts"), F.coalesce("docs", F.lit(0)).cast("bigint").alias("docs"))


def join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` (other documents with similarity of at least the threshold, copies
    included), ``n_text_links`` (of these, how many differ in their shingle sets) for every row.

    Words are runs of letters and numbers in lower case; a text of fewer words than a shingle, but some, is one
    shingle. Classes are connected components of links, named by their least doc_id. A null text, or one without
    words, links to nothing and is its own class. Repeated rows count as copies of each other. A null doc_id can be
    linked, and names a class only if the class has no other. Further columns are not looked at; an empty table gives no rows.
    """
    own, named = linked(docs, threshold, shingle, recall, trees)
    names = named.groupBy("class").agg(F.min("rep").alias("class_id"))
    named = keyed(named, "class").join(keyed(names, "class").drop("class"), "k").select("node", "class_id", (F.col("docs") + F.col("weight") - 1).alias("n_links"), F.col("texts").alias("n_text_links"))
    return own.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("bigint").alias("n_text_links"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class the text of least doc_id (null: last), and of equal ones that of the least digest (all columns).

    Texts decide: of two texts under one doc_id, or without one, each stays or goes with its own class. Texts without
    words have no partner and stay. Of repeated rows (doc_id and text) one stays; an empty table stays empty.
    """
    own, named = linked(docs, THRESHOLD, SHINGLE, RECALL, TREES)
    rows = own.select("doc_id", "digest", "node").distinct()
    classed = keyed(rows.where("node IS NOT NULL"), "node").join(keyed(named.select("node", "class"), "node").drop("node"), "k")
    best = classed.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("b")).select("b.doc_id", "b.digest")
    kept = best.union(rows.where("node IS NULL").select("doc_id", "digest")).select(F.col("doc_id").alias("kept_id"), F.reverse("digest").alias("kept"))
    same = (F.reverse(digest("text")) == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
