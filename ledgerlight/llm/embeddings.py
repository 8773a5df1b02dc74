"""Near-duplicate embeddings by product quantisation, within equal labels.

Vectors are put into inverted lists around coarse centroids; their residuals are coded by subspace. A query looks its
subspace products up in tables, adds them along the codes and gets each vector's approximate cosine. The
true one is off by no more than the stored coding error, so what cannot reach the threshold goes; the
others are ranked again by the exact cosine in double precision.

Two vectors in different lists lie on both sides of the border between the lists, so their distances to it add up to no more than
their own distance, and one of them is within half of it. A query therefore probes every list whose border is within half the
distance at the threshold: no pair is missed, whatever way the vectors spread. Where both ends probe each other's list the pair
counts in the list of the larger number alone. What is found is credited to both ends.

The quantisers, one for each length of vectors, are fitted on a bounded sample by a hash of the vectors; every vector is indexed and is
a query. Lists grow in number with the vectors, up to centres of ``MODEL_BYTES``, which each task holds; beyond that they grow
longer, which costs time and loses nothing. Equal vectors of a label count once, with their number. Long lists are cut into blocks
and compared tile by tile; a tile returns counts of links and the components it has found, not pairs.

Defined cases: vectors that are null, empty, zero or hold a null or a number that isn't finite, and rows without label or vec_id, link with
nothing; vectors of different lengths aren't compared; rows that repeat a vec_id are vectors of their own, each with its own links and
component; a cosine at the threshold links; very long vectors cost their length; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import Workspace
from ledgerlight.llm.components import components, least_places

#: Vectors to fit on: as many in all, but no fewer than ``LEAST_SAMPLE`` of a length and ``SAMPLE_A_LIST`` for each list.
SAMPLE, LEAST_SAMPLE, SAMPLE_A_LIST = 8192, 64, 8
#: Vectors in a list, about, and bytes of the centres of all lists at most.
LIST_SIZE, MODEL_BYTES = 1024, 64 << 20
SUBSPACES, CODES = 8, 256
BLOCK = 2048


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, steps: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return np.unique(centres, axis=0)


@dataclass
class Quantiser:
    """For vectors of one length: ``centres`` of the lists and ``books`` of (subspace, code, part)."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of unit vectors."""
        own = nearest(x, self.centres)
        rest = self.pad(x - self.centres[own])
        parts = rest.reshape(len(x), *self.books.shape[::2])
        codes = np.stack([nearest(parts[:, m], self.books[m]) for m in range(len(self.books))], 1).astype(np.uint8)
        decoded = np.concatenate([self.books[m][codes[:, m]] for m in range(len(self.books))], 1)
        return own, codes, np.linalg.norm(rest - decoded, axis=1)

    def probes(self, x: np.ndarray, own: np.ndarray, distance: float) -> np.ndarray:
        """Whether each list's border with the vector's own list is nearer than ``distance``."""
        d = ((x**2).sum(1)[:, None] + (self.centres**2).sum(1)[None, :] - 2 * x @ self.centres.T)
        between = np.linalg.norm(self.centres[own][:, None, :] - self.centres[None, :, :], axis=2)
        out = d - d[np.arange(len(x)), own][:, None] <= 2 * between * distance + 1e-9  # what rounding may add
        out[np.arange(len(x)), own] = True
        return out

    def products(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries with coded vectors of list ``at``, by table look-up."""
        tables = np.einsum("bmd,mcd->bmc", self.pad(x).reshape(len(x), *self.books.shape[::2]), self.books)
        out = np.repeat((x @ self.centres[at])[:, None], len(codes), 1)
        for m in range(codes.shape[1]):
            out += tables[:, m][:, codes[:, m]]
        return out


def quantiser(x: np.ndarray, lists: int) -> Quantiser:
    centres = k_means(x, min(lists, len(x)))
    rest = x - centres[nearest(x, centres)]
    subspaces = min(SUBSPACES, x.shape[1])
    part = -(-x.shape[1] // subspaces)
    rest = np.pad(rest, ((0, 0), (0, subspaces * part - x.shape[1]))).reshape(len(x), subspaces, part)
    size = min(CODES, len(x))
    books = np.zeros((subspaces, size, part))
    for m in range(subspaces):
        book = k_means(rest[:, m], size)
        books[m] = book[np.arange(size) % len(book)]
    return Quantiser(centres, books)


def unit(raw: list[bytes], dim: int, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


CLASS = ["node", "weight", "label", "dim", "least", "h1", "h2"]


def packed(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """CLASS's columns and the vectors, as bytes."""
    for batch in batches:
        lists = batch.column("embedding")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
        ends = np.cumsum(batch.column("dim").to_numpy(zero_copy_only=False))
        raw = [part.tobytes() for part in np.split(flat, ends[:-1])] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CLASS), pa.array(raw, pa.binary())], names=[*CLASS, "vector"])


def indexed(batches: Iterator[pa.RecordBatch], models: dict[int, Quantiser], kind: str, distance: float) -> Iterator[pa.RecordBatch]:
    """Add list, codes, error and probes to (node, weight, label, dim, vector)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            dims, raw = part.column("dim").to_numpy(zero_copy_only=False), part.column("vector").to_pylist()
            rows: list = [None] * part.num_rows
            for dim in np.unique(dims):
                which, model = np.flatnonzero(dims == dim), models[int(dim)]
                x = unit([raw[i] for i in which], int(dim), kind)
                own, codes, error = model.encode(x)
                near = model.probes(x, own, distance)
                for k, i in enumerate(which):
                    rows[i] = (int(own[k]), codes[k].tobytes(), float(error[k]), np.flatnonzero(near[k]).tolist())
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "home", "codes", "error", "probes"])


FOUND = "node long, links long, root long"


def counted_here(at: int, q_home: np.ndarray, q_node: np.ndarray, v_node: np.ndarray, v_probes: pa.Array) -> np.ndarray:
    """Which pairs of a query and a vector of list ``at`` count in it, so that each counts in one list and once."""
    homes, which = np.unique(q_home, return_inverse=True)
    back = np.zeros((len(v_node), len(homes)), bool)  # whether the vector probes the query's list
    flat = v_probes.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(v_node)), v_probes.value_lengths().to_numpy(zero_copy_only=False))
    place = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
    hit = homes[place] == flat
    back[of[hit], place[hit]] = True
    elsewhere = (~back | (homes < at)[None, :]).T
    return np.where((q_home == at)[:, None], q_node[:, None] < v_node[None, :], elsewhere[which])


def tile(key: tuple, table: pa.Table, models: dict[int, Quantiser], kind: str, least: float) -> pa.Table:
    """Links of a block of queries with a block of a list: (node, links, root of the component within the tile)."""
    dim, at = key[1].as_py(), key[2].as_py()
    table = table.combine_chunks()
    role = table.column("query").to_numpy().astype(bool)
    nodes, weight, home = (table.column(c).to_numpy() for c in ("node", "weight", "home"))
    q, v = np.flatnonzero(role), np.flatnonzero(~role)
    if not len(q) or not len(v):
        return pa.table({n: pa.array([], pa.int64()) for n in ("node", "links", "root")})
    raw, codes, error = table.column("vector").to_pylist(), table.column("codes").to_pylist(), table.column("error").to_numpy()
    x, y, model = unit([raw[i] for i in q], dim, kind), unit([raw[i] for i in v], dim, kind), models[dim]
    coded = np.frombuffer(b"".join(codes[i] for i in v), np.uint8).reshape(len(v), -1)
    probes = table.column("probes").take(pa.array(v)).combine_chunks()
    links, pairs = np.zeros(len(nodes), np.int64), []
    for start in range(0, len(q), 256):
        mine = q[start : start + 256]
        maybe = model.products(x[start : start + 256], at, coded) + error[v][None, :] >= least - 1e-9
        maybe &= counted_here(at, home[mine], nodes[mine], nodes[v], probes)
        rows, columns = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
        if not len(rows):
            continue
        true = (x[start + rows] @ y[columns].T >= least) & maybe[np.ix_(rows, columns)]
        links[mine[rows]] += true @ weight[v[columns]]
        links[v[columns]] += weight[mine[rows]] @ true
        a, b = np.nonzero(true)
        pairs.append((mine[rows[a]], v[columns[b]]))
    every, place = np.unique(nodes, return_inverse=True)  # a vector may be query and held at once
    a, b = (place[np.concatenate([p[i] for p in pairs])] if pairs else np.zeros(0, int) for i in (0, 1))
    root, total = every[least_places(len(every), a, b)], np.zeros(len(every), np.int64)
    np.add.at(total, place, links)
    kept = np.flatnonzero(total > 0)
    return pa.table({"node": every[kept], "links": total[kept], "root": root[kept]})


def fitted(classes: DataFrame, kind: str, sample: int) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors, on a sample by a hash; a length of few vectors is taken whole."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    lists = {r.dim: max(1, min(max(4, r.most // LIST_SIZE), MODEL_BYTES // (8 * max(1, r.dim)))) for r in sizes}
    shares = [(r.dim, min(1.0, max(sample // len(sizes), LEAST_SAMPLE, SAMPLE_A_LIST * lists[r.dim]) / r.n)) for r in sizes]
    if not shares:
        return {}
    chances = F.broadcast(classes.sparkSession.createDataFrame(shares, "dim int, share double"))
    drawn = classes.join(chances, "dim").where(F.pmod(F.xxhash64("h2", "h1"), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("dim", "h1", "h2", "vector").toArrow()
    drawn = drawn.sort_by([("dim", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
    dims, raw = drawn.column("dim").to_numpy(), drawn.column("vector").to_pylist()
    models = {}
    for dim, most in lists.items():
        which = np.flatnonzero(dims == dim)
        models[dim] = quantiser(unit([raw[i] for i in which], dim, kind), most) if len(which) else quantiser(np.zeros((1, dim)), 1)
    return models


def near_duplicates(vectors: DataFrame, least: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. vectors: vec_id, embedding, label."""
    spark = vectors.sparkSession
    work = Workspace(spark, "embeddings")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    sound = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("embedding", lambda e: e != 0)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("dim", F.size("embedding")).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(7), "embedding"))
    same = ["label", "dim", "h1", "h2"]
    alike = rows.where("sound").groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    label = vectors.schema["label"].dataType.simpleString()
    head = f"node long, weight long, label {label}, dim int, least long, h1 long, h2 long, vector binary"
    numbered = alike.select(F.monotonically_increasing_id().alias("node"), *CLASS[1:], "embedding")  # the node is no vec_id: those may repeat
    classes = work.table(numbered.mapInArrow(partial(packed, kind=kind), head), "classes")

    models, distance = fitted(classes, kind, sample), sqrt(2 - 2 * least)
    core = f"node long, weight long, label {label}, dim int, vector binary"
    marked = classes.select("node", "weight", "label", "dim", "vector").mapInArrow(partial(indexed, models=models, kind=kind, distance=distance / 2), f"{core}, home int, codes binary, error double, probes array<int>")
    index = work.table(marked, "index")
    place = ["label", "dim", "list"]
    kept = index.withColumn("list", F.col("home"))
    held = kept.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("held"))
    queries = index.withColumn("list", F.explode("probes"))
    asked = queries.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asked"))
    sizes = work.table(held.join(asked, place), "sizes")

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str], query: bool) -> DataFrame:
        out = side.join(sizes, place).withColumn(names[0], F.pmod(F.xxhash64("node"), F.col(own)).cast("int")).withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        none = (F.lit(None).cast("binary"), F.lit(0.0), F.array().cast("array<int>"))
        coded = none if query else (F.col("codes"), F.col("error"), F.col("probes"))
        return out.select(*place, "i", "j", F.lit(query).alias("query"), "node", "weight", "home", "vector", *[c.alias(n) for c, n in zip(coded, ("codes", "error", "probes"), strict=True)])

    both = dealt(queries, "asked", "held", ("i", "j"), True).union(dealt(kept, "held", "asked", ("j", "i"), False))

    def compared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return tile(key, table, models, kind, least)

    compared.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    found = work.table(both.groupBy(*place, "i", "j").applyInArrow(compared, FOUND), "found")
    roots = components(work, found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "weight", "least", *same).join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classed = named.join(least_id, "root").select(*[F.col(c).alias(f"_{c}") for c in same], (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    slim = rows.select("vec_id", *same, "sound")
    joined = slim.join(classed, slim.sound & (slim.label == F.col("_label")) & (slim.dim == F.col("_dim")) & (slim.h1 == F.col("_h1")) & (slim.h2 == F.col("_h2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embeddings(spark, sf_dir: str) -> DataFrame:
    """All embeddings of equal label at a cosine of 0.93 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
