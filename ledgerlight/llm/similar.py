"""Near duplicates of similar shingles: SimHash links and MinHash bands propose, the shingles themselves decide.

Fingerprints of texts whose shingle sets have a Jaccard similarity of 0.8 differ in about ten of 64 bits, up to twenty;
an index of byte positions that reaches so far would hold nearly all pairs. So the links at four bits are taken as
they are found there, and farther pairs come from an index of ``BANDS`` positions, each a hash of ``ROWS`` least
hashes of the shingle set: at 0.8 a pair shares none with a probability of one in a million, above it less. Pairs in
a band's list are proposed if a byte of each of their ``BANDS * ROWS`` least hashes agrees in ``AGREE`` places, which a pair at 0.8
misses once in ten million; sets that share but a passage are told apart by that, so proposals don't chain through the corpus. Within the
components of what is proposed all sets are compared by their shingles, and a link needs the similarity.

Sets that are equal are one node, however many documents have it. Long lists and large components are cut into blocks, of
bounded numbers and bytes, and compared tile by tile; none is capped. A tile returns the components it has found, not its pairs.

Defined cases: null, empty and blank texts are alike; texts of fewer words than a shingle hash as a whole; a long text is taken
whole; repeated rows are linked; of documents that tie for the least id that of the least text hash stays; an empty table gives an
empty one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace, whole_tiles
from ledgerlight.llm.components import components
from ledgerlight.llm.simhash import SEED, chosen, groups, links

LEAST = 0.8
BANDS, ROWS = 26, 4
#: Of the bytes of a set's least hashes, those that agree in a proposed pair; 0.8 of them are expected at a similarity of 0.8.
AGREE = 62
#: Sets in a block of a long list; sets, and bytes of them, in a block of a large component.
LIST_BLOCK, BLOCK, BLOCK_BYTES = 1024, 256, 2 << 20
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64, seed 42, of each shingle of ``width`` words, A-Z lower-cased, as often as it comes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint that ``simhash.fingerprint`` gives."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # no sum of a byte overflows
        bits = np.unpackbits(hashes[at : at + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def bands(distinct: np.ndarray) -> tuple[list[int], bytes]:
    """Hashes of the least hashes of a set, signed, one of each band; and a byte of each least hash. Nothing for an empty set."""
    import xxhash

    if not len(distinct):
        return [], bytes(BANDS * ROWS)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(distinct), 1024):
        np.minimum(least, (distinct[None, at : at + 1024] * FACTORS[:, None]).min(1), out=least)
    parts = least.astype("<u8").reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(p.tobytes(), b) for b, p in enumerate(parts)], np.uint64).view(np.int64).tolist()
    return keys, (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def released() -> None:
    """Give back what this worker has freed: it is used again, and stays beside the JVM meanwhile."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, text) to doc_id, text_hash, node, fp, bands, marks; node is a hash of the set."""
    import xxhash

    for batch in batches:
        node, fp, keys, marks = [], [], [], []
        texts = batch.column(2)
        for i in range(batch.num_rows):
            hashes = shingles(texts[i].as_py(), width)
            distinct = np.unique(hashes)
            node.append(xxhash.xxh64_intdigest(distinct.astype("<u8").tobytes(), SEED))
            fp.append(simhash(hashes))
            found, mark = bands(distinct)
            keys.append(found)
            marks.append(mark)
        new = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], names=["doc_id", "text_hash", "node", "fp", "bands", "marks"])
    released()


def sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Put the set of shingles, as bytes, in place of the text, the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = [np.unique(shingles(texts[i].as_py(), width)).astype("<u8").tobytes() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], names=[*batch.schema.names[:-1], "hashes"])
    released()


def alike(parts: list[np.ndarray], least: float) -> np.ndarray:
    """For each of the sets, none empty, the first of its component by links of Jaccard ``least`` or more."""
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    known, at = np.unique(np.concatenate(parts), return_inverse=True)
    label, left = np.arange(len(parts)), np.ones(len(parts), bool)
    for first in range(len(parts)):
        todo = [first] if left[first] else []
        left[first] = False
        while todo and left.any():
            one = todo.pop()
            has = np.zeros(len(known), np.int64)
            has[at[starts[one] : starts[one] + sizes[one]]] = 1
            shared = np.add.reduceat(has[at], starts)
            near = np.flatnonzero(left & (shared / (sizes + sizes[one] - shared) >= least))
            label[near], left[near] = first, False
            todo += near.tolist()
    return label


def tile(key: tuple, table: pa.Table, least: float) -> pa.Table:
    """Edges from each set to the first of its component within a tile."""
    table = table.filter(pc.greater(pc.binary_length(table.column("hashes")), 0))
    nodes = table.column("node").to_numpy()
    label = alike([np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()], least) if len(nodes) > 1 else np.arange(len(nodes))
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"u": nodes[own], "v": nodes[label[own]]})


def agreeing(group: np.ndarray, marks: np.ndarray, least: int = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) that join, within each group, whatever is joined by pairs whose marks agree in ``least`` places. Rows are sorted by group."""
    n, links = len(group), []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    small = np.repeat(sizes <= 16, sizes)
    for shift in range(1, 16):
        same = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:]) if n > shift else np.zeros(0, int)
        for at in range(0, len(same), 1 << 16):
            part = same[at : at + (1 << 16)]
            near = part[(marks[part] == marks[part + shift]).sum(1) >= least]
            links.append((near, near + shift))
    for start, size in zip(starts[sizes > 16], sizes[sizes > 16], strict=True):
        mine, left = marks[start : start + size], np.ones(size, bool)
        for first in range(size):
            todo = [first] if left[first] else []
            left[first] = False
            while todo and left.any():
                one, rest = todo.pop(), np.flatnonzero(left)
                near = rest[(mine[rest] == mine[one]).sum(1) >= least]
                left[near] = False
                links.append((np.full(len(near), start + one), start + near))
                todo += near.tolist()
    return tuple(np.concatenate([p[i] for p in links]) if links else np.zeros(0, int) for i in (0, 1))


def alike_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, i, j, node, marks), sorted, to edges."""
    for table in whole_tiles(batches, ["band", "i", "j"]):
        nodes = table.column("node").to_numpy()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(nodes), -1)
        a, b = agreeing(groups(table, ["band", "i", "j"]), marks)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["u", "v"])
    released()


def proposed(work: Workspace, marks: DataFrame) -> DataFrame:
    """(node, part): nodes that share a part with others; all links are within a part."""
    nodes = work.table(marks.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "bands", "marks")]), "nodes")
    postings = work.table(nodes.select("node", F.explode("bands").alias("band")), "bands")
    shared = postings.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / LIST_BLOCK).cast("long").alias("blocks"))
    listed = postings.join(shared, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    listed = listed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    listed = listed.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node")
    tiles = listed.join(nodes.select("node", "marks"), "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    edges = work.table(tiles.mapInArrow(alike_marks, "u long, v long").distinct(), "band_edges")
    work.drop("bands")
    prints = work.table(nodes.select("fp").distinct(), "prints")
    close = links(work, prints, 4)
    work.drop("postings")
    # fingerprints that are linked or have several sets join them as nodes of their own
    busy = close.select(F.col("u").alias("fp")).union(close.select("v")).union(nodes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")).distinct()
    held = nodes.select("node", "fp").join(busy, "fp").select(F.col("node").alias("u"), F.col("fp").alias("v"))
    roots = components(work, work.table(edges.union(close).union(held), "proposed"))
    return work.table(nodes.select("node").join(roots, "node").select("node", F.col("root").alias("part")), "parts")


def deduplicated(docs: DataFrame, width: int = 5, least: float = LEAST) -> DataFrame:
    """One document of each component of similar texts, that of the least (doc_id, hash of its text), null ids last; same columns."""
    work = Workspace(docs.sparkSession, "similar")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    marks = work.table(texts.mapInArrow(partial(signed, width=width), "doc_id long, text_hash long, node long, fp long, bands array<long>, marks binary"), "marks")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    parts = proposed(work, marks)
    named = marks.join(parts, "node").groupBy("node", "part").agg(F.min(rank).alias("one"))
    named = named.select("node", "part", F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("hash"))
    whole = texts.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("part", "node", "text")
    whole = work.table(whole.dropDuplicates(["node"]).mapInArrow(partial(sets, width=width), "part long, node long, hashes binary"), "sets")
    sizes = whole.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("hashes")).alias("bytes")).where("n > 1")
    sizes = sizes.select("part", F.least("n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("long").alias("blocks"))
    dealt = whole.join(sizes, "part").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = dealt.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "hashes")

    def compared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return tile(key, table, least)

    compared.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    found = work.table(tiles.groupBy("part", "i", "j").applyInArrow(compared, "u long, v long"), "found")
    work.drop("sets")
    again = Workspace(docs.sparkSession, "similar-links")
    roots = components(again, found)
    rooted = marks.drop("fp", "bands", "marks").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min(rank).alias("one")).select(F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash"))
    return chosen(docs, kept.distinct())
