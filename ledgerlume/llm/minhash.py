"""Near-duplicate classes by DartMinHash and exact shingle similarity.

Darts (Christiani, 2020): every element owns an unbounded region of weight x rank; hashes place a
Poisson number of darts into its cells, so equal elements throw equal darts everywhere. A document
keeps the darts that fall below its elements' weights and, for each of K coordinates, the one of the
earliest rank: two signatures agree in a coordinate with the probability of the documents' weighted
Jaccard similarity. The cost is one hash per element plus about K ln K darts per document.

The steps, all over whole texts and all rows:

1. documents with equal words are one node (exact classes, combined before the shuffle);
2. each node gets a signature and BANDS band keys of ROWS coordinates; two nodes with similarity 0.8
   miss all bands with probability (1 - 0.8**4)**24 = 3e-6;
3. buckets of up to SMALL nodes give all their pairs, less those whose signatures agree so little
   that a similarity of 0.8 is out of the question (LEAST_AGREEMENT, five deviations below); larger
   buckets give one edge per member, unfiltered;
4. the components of these edges are super-groups: links exist only inside them. In super-groups too
   large for one block, LEADERS nodes one after the other are compared with all that aren't linked to
   an earlier one: most of a large group of copies hangs on its first leader, at one comparison a node;
5. pairs of a super-group whose nodes don't hang on the same leader are compared exactly, in blocks of
   cells of BLOCK nodes or BLOCK_BYTES at most, of sizes near enough for the threshold; a block emits a
   spanning forest of its links, never all pairs;
6. the components of the links are the classes.

No bucket or group is capped: large ones are only cut into blocks. What is left of the square of a
group's size are the nodes that none of its leaders holds, times the group. Similarity is the Jaccard
similarity of sets of five lower-case words between white space (a shorter text is one shingle).

Defined results: null and empty texts have no words and form one class; the class id is the smallest
doc_id of the class, the document that stays; rows that repeat an id belong to one document; a row
with a null id gets a negative class id of its own words unless its class has an id; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .joins import row_key, sized, with_ids, without_rows
from .storage import bounded_batches, materialise
from .words import MIX_B, U, mix, word_hashes
from .workers import claim

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 24
K = ROWS * BANDS
#: LEAST_AGREEMENT of 0 compares every pair of a small bucket.
SMALL, LEAST_AGREEMENT = 16, 0.6
BLOCK, BLOCK_BYTES, LEADERS = 256, 8 << 20, 3
#: Shingles that one step of the signature works on at once.
PART = 1 << 16
#: Rows in one file of an intermediate table: ids alone, with signatures, with shingles.
IDS, SIGNED, WIDE = 1 << 20, 1 << 17, 1 << 14

STEP = U(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, with repeats; of all words if there are fewer."""
    n = min(len(words), WORDS)
    if not n:
        return words
    last = len(words) - n + 1
    out = np.zeros(last, U)
    for i in range(n):
        out = out * STEP + words[i : i + last]
    return mix(out + U(n))


# Poisson(1): the chance of at most n darts in a cell.
_poisson = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, n + 1), dtype=float) for n in range(12)])
POISSON = (_poisson * 2.0**32).astype(np.uint64)


def throw(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, k: int, reach: np.ndarray) -> np.ndarray:
    """For each document and coordinate the earliest dart of rank below the document's reach.

    A dart is packed as the bits of its rank (float32) above 32 bits of its identity; all ones: none.
    Weight cells double in width (0-1, 1-3, 3-7, ...) while rank cells halve, so each holds one dart on average.
    """
    best = np.full(docs * k, ~U(0))
    level = 0
    while len(elements):
        start, width = float(2**level - 1), float(2**level)
        inside = weights > start
        elements, weights, doc = elements[inside], weights[inside], doc[inside]
        if not len(elements):
            break
        cells = np.ceil(reach[doc] * width).astype(np.int64)
        of = np.repeat(np.arange(len(elements)), cells)
        row = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        cell = mix(elements[of] + (row.astype(U) * U(64) + U(level + 1)) * STEP)
        darts = np.searchsorted(POISSON, cell >> U(32), side="right")
        at = np.repeat(np.arange(len(of)), darts)
        number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        h = mix(cell[at] + (number.astype(U) + U(1)) * MIX_B)
        rank = (row[at] + (h & U(0xFFFFFFFF)).astype(np.float64) / 2.0**32) / width
        weight = start + (h >> U(32)).astype(np.float64) * (width / 2.0**32)
        owner = of[at]
        keep = (weight < weights[owner]) & (rank < reach[doc[owner]])
        h, rank, owner = mix(h[keep] ^ STEP), rank[keep], owner[keep]
        packed = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (h >> U(32))
        np.minimum.at(best, doc[owner] * k + (h & U(0xFFFFFFFF)).astype(np.int64) % k, packed)
        level += 1
    return best.reshape(docs, k)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """32-bit signatures (docs x k) of weighted sets; `doc` numbers each element's document.

    A document without weight gets zeros. Repeats of an element within a document change nothing.
    """
    total = np.bincount(doc, weights=weights, minlength=docs)
    reach = k * (np.log(k) + 3) / np.maximum(total, 1e-12)
    out, pending = np.zeros((docs, k), np.uint32), total > 0
    while pending.any():
        chosen = pending[doc]
        number = np.cumsum(pending) - 1
        best = throw(elements[chosen], weights[chosen], number[doc[chosen]], int(pending.sum()), k, reach[pending])
        full = (best != ~U(0)).all(1)
        ids = np.flatnonzero(pending)
        out[ids[full]] = (best[full] & U(0xFFFFFFFF)).astype(np.uint32)
        pending[ids[full]] = False
        reach *= 2
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    by_band = signatures.reshape(len(signatures), BANDS, ROWS).astype(U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), by_band.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * STEP + by_band[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the words), sketch (a byte per coordinate), bands, row_key of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            at, words = 0, word_hashes(batch.column(1).to_pylist())
            while at < batch.num_rows:
                start, digests, sets, size = at, [], [], 0
                while at < batch.num_rows and size < PART:
                    digests.append(xxhash.xxh3_128_digest(words[at].tobytes()))
                    sets.append(shingles(words[at]))
                    size, at = size + len(sets[-1]), at + 1
                doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                sig = dart_signatures(np.concatenate(sets), np.ones(len(doc)), doc, len(sets))
                bands = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, band_keys(sig).ravel())
                sketch = [row.tobytes() for row in (sig & np.uint32(255)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), pa.array(digests, pa.binary()), pa.array(sketch, pa.binary()), bands, batch.column(2).slice(start, at - start)],
                    names=["doc_id", "digest", "sketch", "bands", "row_key"],
                )

    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(run, "doc_id long, digest binary, sketch binary, bands array<long>, row_key binary")


def agreeing(pairs: DataFrame) -> DataFrame:
    """u, v of the pairs (u, v, su, sv) whose sketches agree in LEAST_AGREEMENT of all coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, K) for i in (2, 3))
                batch = batch.filter(pa.array((a == b).mean(1) >= LEAST_AGREEMENT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"])

    return pairs.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def candidate_edges(nodes: DataFrame, rows: int) -> DataFrame:
    """u, v: edges whose components hold every pair that shares a band (but for hopeless small-bucket pairs)."""
    entries = nodes.select("node", F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    members = materialise(entries.join(buckets, "band").select("band", "node", "n", "first"), "bucket-members", rows * BANDS, IDS)
    large = members.filter(F.col("n") > SMALL).select(F.col("first").alias("u"), F.col("node").alias("v")).filter("u <> v").distinct()
    small = members.filter(F.col("n") <= SMALL).groupBy("band").agg(F.sort_array(F.collect_list("node")).alias("m"))  # at most SMALL
    rest = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, SMALL), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    pairs = small.select(F.explode(rest).alias("p")).select("p.u", "p.v").distinct()
    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("su")), "u")
    both = both.join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sv")), "v")
    return agreeing(both).unionByName(large)


def shingle_sets(docs: DataFrame, groups: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """node, size, shingles (sorted distinct hashes as bytes) of one row of every grouped node.

    The ids of the nodes only narrow down the rows to read; the digest of a row's words tells its node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("minhash")
        for batch in batches:
            words = word_hashes(batch.column(1).to_pylist())
            sets = [np.unique(shingles(w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in words], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["digest", "size", "shingles"],
            )

    grouped = materialise(nodes.join(groups.select("node"), "node", "left_semi").select("digest", "node", "own"), "grouped-nodes", rows, IDS)
    found = with_ids(docs.select("doc_id", "text"), grouped.select("own")).mapInArrow(run, "digest binary, size int, shingles binary")
    return found.join(sized(grouped.select("digest", "node"), grouped.count()), "digest").select("node", "size", "shingles").dropDuplicates(["node"])


def large_groups(groups: DataFrame, sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """group, node, size of nodes in super-groups that fit a block, and of those in larger ones."""
    rows = groups.select(F.col("component").alias("group"), "node").join(sizes.select("node", "size"), "node")
    per_group = rows.groupBy("group").agg((F.count(F.lit(1)) > BLOCK).alias("many"), (F.sum("size") * 8 > BLOCK_BYTES).alias("wide"))
    rows = materialise(rows.join(per_group, "group").select("group", "node", "size", (F.col("many") | F.col("wide")).alias("large")), "sized-nodes", most, IDS)
    return rows.filter("NOT large").drop("large"), rows.filter("large").drop("large")


def led(rows: DataFrame, sets: DataFrame, most: int) -> DataFrame:
    """group, node, size, leader (0: none), head: nodes of large groups with the number and the node of their leader.

    In each round the node of the least hash among those without a leader leads. Its shingles are
    dealt out once for every BLOCK nodes of its group, so no task gets a whole group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, theirs = batch.column(1), batch.column(2)
            linked = [similar(np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)) for a, b in zip(own, theirs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(linked, pa.bool_())], names=["node", "linked"])

    # only the shingles of large groups go through the rounds; narrow tables of nodes are broadcast to them while they are small
    wanted = rows.select("node")
    sets = materialise(sets.select("node", "shingles").join(sized(wanted, wanted.count()), "node", "left_semi"), "large-sets", most, WIDE)
    rows = rows.withColumns({"leader": F.lit(0), "head": F.lit(None).cast("long")})
    for n in range(1, LEADERS + 1):
        free = rows.filter("leader = 0")
        heads = free.groupBy("group").agg(F.min_by("node", F.xxhash64("node", F.lit(n))).alias("lead"), F.min_by("size", F.xxhash64("node", F.lit(n))).alias("lead_size"), F.count(F.lit(1)).alias("n"))
        near = (F.col("size") >= THRESHOLD * F.col("lead_size") - 1e-6) & (F.col("lead_size") >= THRESHOLD * F.col("size") - 1e-6)
        heads = materialise(heads, "leaders", most // BLOCK, IDS)
        narrow = sized(heads, heads.count(), BLOCK * BLOCK)
        copies = F.ceil(F.col("n") / BLOCK).cast("int")
        told = narrow.join(sets.select(F.col("node").alias("lead"), F.col("shingles").alias("theirs")), "lead")
        told = told.select("group", "lead", "theirs", "n", F.explode(F.sequence(F.lit(0), copies - 1)).alias("slot"))
        asked = free.join(narrow, "group").filter(near)
        asked = asked.select("group", "node", F.pmod(F.xxhash64("node"), copies).cast("int").alias("slot"))
        asked = sets.join(sized(asked, asked.count()), "node")
        both = asked.join(told.select("group", "slot", "theirs"), ["group", "slot"])
        linked = both.select("node", "shingles", "theirs").mapInArrow(run, "node long, linked boolean").filter("linked").select("node", F.lit(True).alias("linked"))
        rows = rows.join(linked, "node", "left").join(narrow.select("group", "lead"), "group", "left")
        hangs = F.col("linked").isNotNull() | (F.col("node") == F.col("lead")) & (F.col("leader") == 0)
        rows = rows.select("group", "node", "size", F.when(hangs, n).otherwise(F.col("leader")).alias("leader"), F.when(hangs, F.col("lead")).otherwise(F.col("head")).alias("head"))
        rows = materialise(rows, "led-nodes", most, IDS)
    return rows


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted hashes, have a Jaccard similarity of THRESHOLD or more."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = np.count_nonzero(b[at] == a)
    return bool(both >= THRESHOLD * (len(a) + len(b) - both) - 1e-6)


def block_rows(small: DataFrame, large: DataFrame) -> DataFrame:
    """group, a, b, side, node: every node once for each block it takes part in.

    A small group is one block. Nodes of large groups are dealt into cells by size class (classes grow
    by 1 / THRESHOLD, so links stay within a class or reach the next), leader and slot; a block compares
    two cells, or one without a leader with itself. Cells of one leader are never compared.
    """
    step = float(np.log(1 / THRESHOLD))
    rows = large.withColumn("level", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / step).cast("int"))
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), BLOCK_BYTES / (8 * F.exp((F.col("level") + 1) * step))))  # nodes a cell
    cells = rows.groupBy("group", "level", "leader").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("group", F.struct("level", "leader", F.ceil(F.col("n") / F.floor(room)).cast("int").alias("slots")).alias("cell"))
    cells = cells.groupBy("group").agg(F.collect_list("cell").alias("cells"))  # by the logarithm of the sizes, whatever the group's
    rows = rows.join(cells, "group")
    name = lambda level, leader, slot: ((level.cast("long") * (LEADERS + 1) + leader) * (1 << 32)) + slot
    level, leader = F.col("level"), F.col("leader")
    own = F.element_at(F.filter("cells", lambda c: (c["level"] == level) & (c["leader"] == leader)), 1)["slots"]
    me = name(level, leader, F.pmod(F.xxhash64("node"), own))
    met = F.filter("cells", lambda c: (F.abs(c["level"] - level) <= 1) & ((c["leader"] != leader) | (c["leader"] == 0)))
    others = F.flatten(F.transform(met, lambda c: F.transform(F.sequence(F.lit(0), c["slots"] - 1), lambda i: name(c["level"], c["leader"], i))))
    dealt = rows.select("group", "node", me.alias("me"), F.explode(others).alias("other"))
    side = F.when(F.col("me") == F.col("other"), 2).when(F.col("me") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("group", F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), side.alias("side"), "node")
    whole = small.select("group", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(2).alias("side"), "node")
    return whole.unionByName(dealt)


def links_of(side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets (within side 2, or between sides 0 and 1), as index pairs."""
    n = len(sets)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(values) else first
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for low in range(0, int(column[-1]) + 1, 8192):
            a, b = np.searchsorted(column, [low, low + 8192])
            part = np.zeros((n, min(8192, int(column[-1]) + 1 - low)), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
    union = size[:, None] + size[None, :] - common
    link = np.triu((common >= THRESHOLD * union - 1e-6) & ((side[:, None] != side[None, :]) | (side[:, None] == 2)), 1)
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(link), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            out.append((int(i), int(j)))
    return out


KEYS = ["group", "a", "b"]


def exact_links(docs: DataFrame, groups: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """u, v: links (Jaccard similarity of THRESHOLD or more) that span each super-group's classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, side, sets = None, [], [], []

        def close() -> list[tuple[int, int]]:
            return [(nodes[i], nodes[j]) for i, j in links_of(np.array(side), sets)]

        def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for k, node, s, raw in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if k != key:
                    found += close()
                    key, nodes, side, sets = k, [], [], []
                nodes.append(node)
                side.append(s)
                sets.append(np.frombuffer(raw.as_buffer(), U))
            yield out(found)
        yield out(close())

    sets = materialise(shingle_sets(docs, groups, nodes, rows), "shingles", rows, WIDE)
    small, large = large_groups(groups, sets, rows)
    large = led(large, sets, rows) if large.limit(1).count() else large.withColumns({"leader": F.lit(0), "head": F.lit(None).cast("long")})
    blocks = block_rows(small, large).join(sets.select("node", "shingles"), "node")
    dealt = blocks.repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = dealt.select(*KEYS, "node", "side", "shingles").mapInArrow(run, "u long, v long")
    return found.unionByName(large.filter("head <> node").select(F.col("head").alias("u"), F.col("node").alias("v")))


def row_classes(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, class_id, named (whether the class has an id) of every row.

    A node is a distinct sequence of words. It goes by its smallest id; where it has none, or another
    node goes by that id, by a negative number made from its digest.
    """
    bounded_batches(docs.sparkSession)
    rows = materialise(signatures(docs), "signatures")
    total = rows.count()
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sketch", "bands")).alias("x")
    nodes = rows.groupBy("digest").agg(least).select("digest", F.col("x.doc_id").alias("own"), "x.sketch", "x.bands")
    nodes = materialise(nodes, "named-nodes", total, SIGNED)
    first = nodes.filter("own IS NOT NULL").groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("first")).filter("n > 1")
    first = first.select(F.col("own").alias("shared"), "first")
    nodes = nodes.join(first, F.col("own") == F.col("shared"), "left")
    made = -1 - F.abs(F.xxhash64("digest") % (1 << 62))
    node = F.when(F.col("own").isNull() | F.coalesce(F.col("digest") != F.col("first"), F.lit(False)), made).otherwise(F.col("own"))
    nodes = materialise(nodes.select("digest", "own", node.alias("node"), "sketch", "bands"), "nodes", total, SIGNED)
    groups = components(candidate_edges(nodes, total), total * BANDS)
    links = materialise(exact_links(docs, groups, nodes, total), "links", total, IDS)
    classes = components(links, total * BANDS).select("node", "component")
    known = nodes.select("digest", "node", "own").join(classes, "node", "left")
    linked = known.filter("component IS NOT NULL").groupBy(F.col("component").alias("linked")).agg(F.min("own").alias("least"))
    known = known.join(sized(linked, linked.count()), F.col("component") == F.col("linked"), "left")
    name = F.when(F.col("component").isNull(), F.col("own")).otherwise(F.col("least"))
    known = known.select("digest", F.coalesce(name, "component", "node").alias("class_id"), name.isNotNull().alias("named"))
    return rows.select("doc_id", "row_key", "digest").join(known, "digest").select("doc_id", "row_key", "class_id", "named")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row."""
    return row_classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows with the class id of each class, with all their columns; rows without an id stay if their class has none."""
    return without_rows(docs, row_classes(docs).filter("named AND NOT (doc_id <=> class_id)"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, kept of every document."""
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
