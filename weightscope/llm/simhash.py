"""SimHash fingerprints linked through a forest of vantage-point trees.

The 64 bits are cut into blocks. Two fingerprints that differ in at most
``distance`` bits differ in at most ``distance // blocks`` bits of some block,
so each block has a tree of its own over the Hamming distance within the block
and searches it with that small radius. Every node of a tree has a vantage
point and a threshold of its own: what is at most the threshold away goes
inside, the rest outside. Leaves are shards. A fingerprint lives in its home
shard and queries the other shards that the triangle inequality can't exclude,
which are those whose boundaries its ball overlaps. In a shard, pairs are
compared exactly over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import boxed, join_hot, map_batches, short_batches, stored
from weightscope.llm.components import components

WIDTH = 4  # words to a shingle
SEED = 42
DISTANCE = 4
BLOCKS = 3
LEAF = 1024  # fingerprints that a shard should hold
CELL = 8192  # those beyond which a shard is cut into cells
MAX_LEVELS = 24
SAMPLE = 1 << 14  # fingerprints that the upper levels of the trees are fitted on
FITTED = 64  # of them that a node needs to be fitted
BATCH = 1 << 13  # fingerprints that are routed at once


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The SimHash of one text; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, n = b" ".join(words), len(words) - width + 1
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a column ``fp`` of type long; one of that name is replaced."""
    docs = docs.drop("fp")
    place, names = docs.columns.index(text), [*docs.columns, "fp"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t) for t in batch.column(place).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(got)], names)

    return map_batches(docs, work, docs.withColumn("fp", F.lit(0).cast("long")).schema)


def _mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit numbers from small ones (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """A vantage-point tree for each block of bits.

    A node is numbered by the way to it, a bit a level. Upper nodes have the
    vantage point, of some candidates, that parts the sample they are fitted on
    best, and its median distance as threshold; nodes that too little of the
    sample reaches have a point made of their number and half the block's width.
    """

    def __init__(self, levels: int, blocks: int = BLOCKS, distance: int = DISTANCE):
        self.levels, self.blocks, self.radius = levels, blocks, distance // blocks
        cuts = [64 * b // blocks for b in range(blocks + 1)]
        self.masks = [np.uint64(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        self.widths = [hi - lo for lo, hi in zip(cuts, cuts[1:], strict=False)]
        self.fitted = min(levels, max(0, SAMPLE // FITTED).bit_length() - 1)
        self.points = [[self._made(b, k, np.arange(1 << k)) for k in range(self.fitted)] for b in range(blocks)]
        self.cuts = [[np.full(1 << k, self.widths[b] // 2, np.int16) for k in range(self.fitted)] for b in range(blocks)]

    def _made(self, block: int, level: int, node: np.ndarray, salt: int = 0) -> np.ndarray:
        number = ((np.uint64(salt) * np.uint64(self.blocks) + np.uint64(block)) * np.uint64(MAX_LEVELS) + np.uint64(level) << np.uint64(32)) + node.astype(np.uint64)
        return _mix(number) & self.masks[block]

    def _node(self, block: int, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
        """Vantage points and thresholds of nodes."""
        if level < self.fitted:
            return self.points[block][level][node], self.cuts[block][level][node]
        return self._made(block, level, node), self.widths[block] // 2

    def fit_node(self, block: int, level: int, node: int, sample: np.ndarray) -> None:
        """Of eight vantage points take that whose median has the least of the sample within the radius of it, the first of equals."""
        best = None
        for salt in range(8):
            point = self._made(block, level, np.array([node]), salt)[0]
            d = np.sort(np.bitwise_count(sample ^ point).astype(np.int16))
            cut = int(d[(len(d) - 1) // 2])
            inside = np.searchsorted(d, cut, "right")
            near = np.searchsorted(d, cut + self.radius, "right") - np.searchsorted(d, cut - self.radius, "right")
            cost = int(near) + abs(2 * int(inside) - len(d))
            if best is None or cost < best[0]:
                best = (cost, point, cut)
        self.points[block][level][node], self.cuts[block][level][node] = best[1:]

    def fit(self, uniq: DataFrame, total: int) -> None:
        """Fit the upper nodes on about ``SAMPLE`` fingerprints, chosen by a hash, in one task.

        What comes to the driver is the trees: a point and a threshold a node,
        of which there are fewer than ``SAMPLE / FITTED`` a block. Every
        fingerprint is indexed; the sample bears on balance alone.
        """
        if not self.fitted:
            return
        names = ("block", "level", "node", "point", "cut")

        def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b.column("fp").to_numpy().view(np.uint64) for b in batches]
            fps, rows = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64), []
            for b in range(self.blocks):
                own, here = fps & self.masks[b], np.zeros(len(fps), np.int64)
                for k in range(self.fitted):
                    order = np.argsort(here, kind="stable")
                    edges = np.searchsorted(here[order], np.arange((1 << k) + 1))
                    for node in np.flatnonzero(np.diff(edges) >= FITTED).tolist():
                        self.fit_node(b, k, node, own[order[edges[node] : edges[node + 1]]])
                        rows.append((b, k, node, int(self.points[b][k][node].view(np.int64)), int(self.cuts[b][k][node])))
                    point, cut = self._node(b, k, here)
                    here = 2 * here + (np.bitwise_count(own ^ point) > cut)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

        chosen = uniq.select("fp").where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(max(1, total // SAMPLE))) == 0)
        for r in chosen.repartition(1).mapInArrow(grow, ", ".join(f"{n} long" for n in names)).collect():
            self.points[r["block"]][r["level"]][r["node"]] = np.array([r["point"]], np.int64).view(np.uint64)[0]
            self.cuts[r["block"]][r["level"]][r["node"]] = r["cut"]

    def home(self, fps: np.ndarray, block: int) -> np.ndarray:
        """The leaf that each fingerprint lives in."""
        own, leaf = fps & self.masks[block], np.zeros(len(fps), np.int64)
        for k in range(self.levels):
            point, cut = self._node(block, k, leaf)
            leaf = 2 * leaf + (np.bitwise_count(own ^ point) > cut)
        return leaf

    def visits(self, fps: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of row and leaf: all leaves that may hold something within the radius.

        By the triangle inequality, what is within the radius of a fingerprint
        at distance d from the vantage point is at d - radius to d + radius
        from it: only where that overlaps the threshold both sides are visited.
        For radius 1 the ball has one member for each bit, d - 1 away where
        the bit differs from the vantage point's and d + 1 where it doesn't,
        so that it is known which members go to which side, and a side with
        none is passed over. That bounds the visits by the ball's size.
        """
        own = fps & self.masks[block]
        who, leaf = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        flips, center = np.full(len(fps), self.masks[block]), np.ones(len(fps), bool)
        for k in range(self.levels):
            point, cut = self._node(block, k, leaf)
            differ = own[who] ^ point
            d = np.bitwise_count(differ).astype(np.int16)
            inside, outside = d - self.radius <= cut, d + self.radius > cut
            sides = []
            if self.radius == 1:
                nearer, farther, none = flips & differ, flips & ~differ, np.uint64(0)
                for bound, near, far, middle in ((inside, d - 1 <= cut, d + 1 <= cut, d <= cut), (outside, d - 1 > cut, d + 1 > cut, d > cut)):
                    left, mid = np.where(near, nearer, none) | np.where(far, farther, none), center & middle
                    at = np.flatnonzero(bound & (mid | (left != 0)))
                    sides.append((at, left[at], mid[at]))
            else:
                sides = [(at := np.flatnonzero(bound), flips[at], center[at]) for bound in (inside, outside)]
            who = np.concatenate([who[at] for at, _, _ in sides])
            leaf = np.concatenate([2 * leaf[at] + side for side, (at, _, _) in enumerate(sides)])
            flips, center = (np.concatenate([x[i] for x in sides]) for i in (1, 2))
        return who, leaf


def _in_lots(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Fingerprints of many short batches together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch.column("fp").to_numpy().view(np.uint64))
        size += batch.num_rows
        if size >= BATCH:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _popcount_links(rows: np.ndarray, others: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(rows[:, None] ^ others[None, :]) <= distance


def link_locally(home: np.ndarray, guests: np.ndarray, distance: int = DISTANCE, block: int = 64, among: bool = True) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``guests`` and ``home`` and, if ``among``, among ``home``."""
    nodes = np.concatenate([home, guests])
    label, out, n = np.arange(len(nodes)), [], len(home)
    for start in range(0 if among else n, len(nodes), block):
        near = _popcount_links(nodes[start : start + block], home, distance)
        for k in np.flatnonzero(near.sum(1) > (np.arange(start, start + len(near)) < n)):
            i = start + int(k)
            js = np.flatnonzero(near[k])
            strange = label[js] != label[i]
            if strange.any():
                new, first = np.unique(label[js[strange]], return_index=True)
                out += [(int(nodes[i]), int(nodes[j])) for j in js[strange][first]]
                label[np.isin(label, new)] = label[i]
    return out


#: What a routed fingerprint is to a cell.
GUEST, HOME, HOST = 0, 1, 2  # a host meets guests only: hosts were compared in other cells


def links(uniq: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, leaf: int = LEAF, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect all that belong together.

    Every pair within ``distance`` meets in some shard, and no more than a
    spanning forest leaves a shard. A shard with more than ``cell`` fingerprints
    at home or as guests, such as a large group of near copies, is cut into
    chunks of that size by a hash, and each pair of chunks is a cell of its own.
    Cells are sorted and streamed: a task holds one at a time.
    """
    short_batches(uniq.sparkSession)
    total = uniq.count()
    forest = Forest(min(MAX_LEVELS, max(0, int(np.ceil(np.log2(max(1, total) / leaf))))), blocks, distance)
    forest.fit(uniq, total)

    def routes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shard, who, at_home = [], [], []
        for b in range(blocks):
            own = forest.home(fps, b)
            row, to = forest.visits(fps, b)
            keep = to >= own[row]  # of two shards that a pair could meet in, one is enough
            row, to = row[keep], to[keep]
            shard.append(to + (b << 40))
            who.append(row)
            at_home.append(to == own[row])
        return np.concatenate(shard), np.concatenate(who), np.concatenate(at_home)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _in_lots(batches):
            shard, _, at_home = routes(fps)
            known, which = np.unique(shard, return_inverse=True)
            homes = np.bincount(which, at_home, len(known)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(homes), pa.array(np.bincount(which, minlength=len(known)) - homes)], ["shard", "homes", "guests"])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in _in_lots(batches):
            shard, who, at_home = routes(fps)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[who].view(np.int64)), pa.array(at_home)], ["shard", "fp", "home"])

    fps = uniq.select("fp")
    sizes = fps.mapInArrow(count, "shard long, homes long, guests long").groupBy("shard").agg(F.sum("homes").alias("homes"), F.sum("guests").alias("guests"))
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / cell)).alias(c)
    large = stored(sizes.where((F.col("homes") > cell) | (F.col("guests") > cell)).select("shard", parts("homes"), parts("guests")), "large-shards")

    routed = fps.mapInArrow(route, "shard long, fp long, home boolean").join(large, "shard", "left")
    c, g = F.col("homes"), F.col("guests")
    mine, dealt = F.pmod(F.xxhash64("fp"), c), F.pmod(F.xxhash64(F.lit(1), "fp"), g)
    entry = lambda no, role: F.struct(no.cast("long").alias("no"), F.lit(role).alias("role"))
    among = F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda j: entry(F.least(j, mine) * c + F.greatest(j, mine), HOME))
    hosting = F.transform(F.sequence(F.lit(0).cast("long"), g - 1), lambda j: entry(c * c + mine * g + j, HOST))
    visiting = F.transform(F.sequence(F.lit(0).cast("long"), c - 1), lambda j: entry(c * c + j * g + dealt, GUEST))
    whole = F.when(F.col("home"), F.array(entry(F.lit(0), HOME))).otherwise(F.array(entry(F.lit(0), GUEST)))
    cells = F.when(c.isNull(), whole).when(F.col("home"), F.concat(among, hosting)).otherwise(visiting)
    rows = routed.select("shard", "fp", F.explode(cells).alias("cell")).select("shard", F.col("cell.no").alias("cell"), "fp", F.col("cell.role").cast("tinyint").alias("role"))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One cell after the other."""

        def found(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            fps, role = (np.concatenate(x) for x in zip(*parts, strict=True))
            guest = role == GUEST
            pairs = np.array(link_locally(fps[~guest], fps[guest], distance, among=not (role == HOST).any()), np.uint64).reshape(-1, 2).view(np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, no, fps, role = (batch.column(i).to_numpy() for i in range(4))
            edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(no) != 0)) + 1).tolist(), len(fps)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if (shard[lo], no[lo]) != last:
                    if held:
                        yield from found(held)
                    held, last = [], (shard[lo], no[lo])
                held.append((fps[lo:hi].view(np.uint64), role[lo:hi]))
        if held:
            yield from found(held)

    return rows.repartition("shard", "cell").sortWithinPartitions("shard", "cell").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp and component_id of every row: who is a near copy of whom.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    component_id is the least doc_id that links reach, the document's own
    included. Null and empty texts have fingerprint zero and link like any
    other. Rows that repeat keep their number; a null doc_id is never the
    least, and its component_id is null only if all that it reaches are null.
    An empty table gives an empty one. Copies share a fingerprint and take part
    in the search once, however many they are.
    """
    made = fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp")
    return _rooted(stored(made, "fingerprints"), distance, blocks).select("doc_id", "fp", "component_id")


def _rooted(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """``prints`` (doc_id, fp) with component_id and ``root``: the fingerprint that stands for the component."""
    uniq = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    roots = components(stored(links(uniq, distance, blocks), "links")).withColumnRenamed("node", "fp")
    rooted = stored(uniq.join(roots, "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = stored(join_hot(rooted, stored(names, "names"), "root", "members").drop("members"), "named")
    return join_hot(prints, named, "fp", "copies").drop("copies")


def hex_digits(fp) -> object:
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each component, that of the least doc_id.

    Of a component's rows with that same doc_id, or with none where none has
    one, the least text stays (null before all), and of equal rows any one.
    Components that share a doc_id keep a row each. Null and empty texts are
    near copies of each other; other columns may have any name; an empty table
    gives an empty one.

    Rows are fingerprinted once and stored with a key of their own. Keys,
    fingerprints and doc_ids decide; texts are shuffled once, to be kept, and
    looked at only where doc_ids tie.
    """
    inner, text = boxed(docs)
    rows = stored(fingerprints(inner, text).withColumn("key", F.monotonically_increasing_id()), "fingerprinted")
    prints = rows.select("key", "fp", F.col(f"c{docs.columns.index('doc_id')}").cast("long").alias("doc_id"))
    least = stored(_rooted(prints, distance, blocks).where("doc_id <=> component_id").select("key", "root"), "least")
    counts = least.groupBy("root").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    ties = stored(least.join(counts.where("n > 1").select("root"), "root", "left_semi"), "ties")
    keep = counts.where("n = 1").select("key")
    if not ties.isEmpty():
        first = rows.select("key", F.col(text).alias("text")).join(ties, "key").groupBy("root").agg(F.min(F.struct("text", "key")).alias("first"))
        keep = keep.union(first.select("first.key"))
    return rows.join(keep, "key", "left_semi").select(*inner.columns).toDF(*docs.columns)
