"""SimHash near-duplicates: fingerprints of word shingles, and links at few differing bits.

A byte-position inverted index finds the pairs. Two fingerprints of eight bytes that differ in at most four
bits agree in at least four bytes, whatever their positions. A list for each single byte would hold a 256th
of all fingerprints and its pairs would grow with their square; so a list is kept for three positions
at once. Of the 56 triples the 20 in ``TRIPLES`` suffice: among any four positions is one of them. Lists of one fingerprint go.
A list is three postings at once, so a pair in it has three votes; the postings of the other positions add theirs, and pairs
that don't get a fourth go. Only the survivors are verified by their differing bits. Long lists are cut into blocks and compared tile by tile, in
as many tasks as there are tiles; none is capped. A tile returns the components it has found, not
its pairs, so the output is no longer than the input.

Copies share a fingerprint and count once in the index, however many there are.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; texts of fewer
words than a shingle hash as a whole; rows without doc_id get their group's id, null where no row of
the group has one; repeated rows are linked; a text of any length is hashed whole, 16,384 shingles at a time; ties can't change a
result, as a component's id is a minimum; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace, whole_tiles, wrapped
from ledgerlight.llm.components import components, least_places

SEED = 42
#: Fingerprints in a block of a long list.
BLOCK = 1024
POSITIONS = 8


def covering(positions: int = POSITIONS) -> list[tuple[int, int, int]]:
    """Triples of positions of which every four positions hold at least one.

    Positions fall into three groups in a ring. Of four positions, two groups at most are missing a
    pair, so some three lie in one group or as two in a group and one in the next.
    """
    group = [p * 3 // positions for p in range(positions)]

    def taken(triple: tuple[int, int, int]) -> bool:
        g = sorted(group[p] for p in triple)
        if g[0] == g[2]:
            return True
        pair = g[1]
        other = g[0] if g[2] == pair else g[2]
        return len(set(g)) == 2 and other == (pair + 1) % 3

    return [t for t in combinations(range(positions), 3) if taken(t)]


TRIPLES = covering()


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of a text's shingles of ``width`` words, A-Z lower-cased, by XXH64 with seed 42."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last, votes = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), np.zeros(64, np.int64)
    for at in range(0, n, 16_384):
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(first[at : at + 16_384], last[at : at + 16_384], strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # no sum of a byte overflows
            votes += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Put the fingerprint, as a signed long, in place of the text, the last column."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        found = [fingerprint(texts[i].as_py(), width) for i in range(batch.num_rows)]
        column = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*batch.schema.names[:-1], "fp"])


def tallied(bytes_: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the pairs (a, b) share: a vote from each position's postings. bytes_: (position, place)."""
    shared = np.zeros(len(a), np.uint8)
    for posting in bytes_:
        shared += posting[a] == posting[b]
    return shared


def survivors(fp: np.ndarray, bytes_: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that reach the least number of shared bytes; then, of those alone, the ones that differ in few enough bits."""
    kept = np.flatnonzero(tallied(bytes_, a, b) >= POSITIONS - bits)
    a, b = a[kept], b[kept]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
    return a[near], b[near]


def linked(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the least of its component, among those of equal group. Rows are sorted by group."""
    n, pairs = len(fp), []
    bytes_ = np.ascontiguousarray(fp.astype("<u8").view(np.uint8).reshape(-1, POSITIONS).T)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    small = np.repeat(sizes <= 32, sizes)
    for shift in range(1, 32):
        same = np.flatnonzero((group[shift:] == group[:-shift]) & small[shift:]) if n > shift else np.zeros(0, int)
        if not len(same):
            break
        pairs.append(survivors(fp, bytes_, same, same + shift, bits))
    for start, size in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        for at in range(0, size, 64):
            a, b = np.meshgrid(np.arange(start + at, start + min(at + 64, size)), np.arange(start + at, start + size), indexing="ij")
            later = a < b
            pairs.append(survivors(fp, bytes_, a[later], b[later], bits))
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, int) for i in (0, 1))
    label = least_places(n, a, b)
    own = np.flatnonzero(label != np.arange(n))
    return fp[own], fp[label[own]]


def groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of the group of equal ``keys``, of sorted rows."""
    new = np.any([(c := table.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0)
    return np.concatenate(([0], np.cumsum(new)))


def compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(list, i, j, fp), sorted, to edges."""
    for tile in whole_tiles(batches, ["list", "i", "j"]):
        u, v = linked(groups(tile, ["list", "i", "j"]), tile.column("fp").to_numpy().view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def links(work: Workspace, nodes: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) that join the same components as all pairs of ``nodes`` (fp, distinct) within ``bits``."""
    if not 0 <= bits <= POSITIONS - 4:
        raise ValueError("pairs of more than four differing bits may share fewer than four bytes")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(POSITIONS)]
    keys = [F.lit(t << 24).cast("long") + byte[a] * 65536 + byte[b] * 256 + byte[c] for t, (a, b, c) in enumerate(TRIPLES)]
    postings = work.table(nodes.select("fp", F.explode(F.array(*keys)).alias("list")), "postings")
    lists = postings.groupBy("list").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    dealt = postings.join(lists, "list").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    tiled = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiled.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    sorted_tiles = tiles.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    return work.table(sorted_tiles.mapInArrow(partial(compare, bits=bits), "u long, v long"), "links")


def grouped(docs: DataFrame, width: int = 4, bits: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` of every document, with fp (signed) and component_id, the least doc_id reachable over links."""
    work = Workspace(docs.sparkSession, "simhash")
    named = docs.select(*[F.xxhash64("text").alias("text_hash") if c == "text_hash" else F.col(c) for c in keep], "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    marks = work.table(named.mapInArrow(partial(fingerprints, width=width), f"{kinds}, fp long"), "fingerprints")
    nodes = work.table(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(work, links(work, nodes, bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = work.table(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = work.table(rooted.join(ids, "root").select("fp", "component_id"), "components")
    return marks.join(of, "fp").select(*keep, "fp", "component_id")


def hexadecimal(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return grouped(docs, width, bits).select("doc_id", hexadecimal().alias("fingerprint"), "component_id")


def chosen(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each of ``kept`` (doc_id, text_hash)."""
    hashed = wrapped(docs).withColumns({"own_id": F.col("row.doc_id"), "own_hash": F.xxhash64("row.text")})
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash"))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_hash"]).select("row.*")


def deduplicated(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """One document of each component, that of the least (doc_id, hash of its text), null ids last; same columns."""
    found = grouped(docs, width, bits, ("doc_id", "text_hash"))
    group = F.coalesce("component_id", F.lit(-1)), F.when(F.col("component_id").isNull(), F.col("fp"))
    first = found.groupBy(*[g.alias(f"g{i}") for i, g in enumerate(group)]).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"))
    kept = first.select(F.col("one.doc_id").alias("doc_id"), F.col("one.text_hash").alias("text_hash")).distinct()
    return chosen(docs, kept)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Shingles of 4 words over all documents; links at 4 differing bits or fewer."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
