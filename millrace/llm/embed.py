"""Embedding near-duplicates by randomised-rotation binary codes with correction factors.

A unit vector o is rotated at random and kept as the signs of its coordinates, o' = signs / sqrt(d), with the factor
f = <o', o>. For any unit vector q, <o', q> / f estimates <o, q> without bias, and its error is at most
sqrt(1 - <o, q>^2) * sqrt(1 - f^2) / f. Here q is kept too, as four bits for each rotated coordinate, with the sum of what
they leave out, which bounds the error that they add. A pair whose estimate lies further below the threshold than both
bounds allow cannot be a link; every other pair is recomputed from the vectors in double precision, so no pair that meets
is lost or wrongly linked.

Pairs meet in hash tables: runs of sign bits of such codes within one label. Bits per table and tables follow from
the largest label's size and from the wanted chance to miss a pair at the threshold (MISS; closer pairs are missed
less). The number of tables grows as a small power of the size, so the work per vector does too. Only codes, four-bit
coordinates and factors go through the tables. The rows that have a pair left by the estimates are few where few
vectors are alike, and only they fetch their vectors, for the tiles in which they have one.

Equal vectors are one node with a weight. Buckets are wide (about BUCKET rows): comparing codes within one is a matrix
product, while every table moves all vectors once, so few tables with wide buckets are cheaper than many narrow ones.
A bucket of over CHUNK rows is cut into chunks whose pairs are compared in tiles, each a task-sized group of its own. Pairs are counted in the first table in which they meet; a tile sends one
row per vector with its number of links and the smallest id that it reaches there, never the pairs.

Defined results: a null label, and a vector that is null, empty, zero, or holds null or non-finite numbers, links with
nothing; components count as they are, so 64-bit ones are not rounded; vectors of different lengths never link; repeated rows are linked with each other; an empty table gives no
rows; further columns are ignored; a null vec_id is kept and stands in no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.store import cut, released

CHUNK = 4096
BUCKET = 2048
ROWS_AT_ONCE = 512
MISS = 1e-4
SEED = 20240229
PAIRS_AT_ONCE = 50_000


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of this dimension."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(largest: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits per table, for buckets of about BUCKET unrelated vectors, and the number of tables."""
    bits = min(40, max(1, math.ceil(math.log2(max(1, largest / BUCKET)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - meet))


def codes(vectors: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit rows: packed signs under the first rotation, correction factors, and the tables' packed sign bits."""
    dim = vectors.shape[1]
    turned = [vectors @ rotation(dim, k).T for k in range(-(-bits * tables // dim))]
    signs = np.concatenate(turned, 1) >= 0
    factors = np.abs(turned[0]).sum(1) / math.sqrt(dim)
    return np.packbits(signs[:, :dim], axis=1), factors, np.packbits(signs[:, : bits * tables], axis=1)


def keys_of(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The tables' keys, one column for each, from their packed sign bits."""
    signs = np.unpackbits(packed, axis=1, count=bits * tables)
    return signs.reshape(len(packed), tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, d1, d2, vec): usable vectors with a digest and their numbers as they came; null where not usable."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            dims, digests, raw = [], [], []
            labels = batch.column("label").to_pylist()
            for label, x in zip(labels, batch.column("embedding"), strict=True):
                values = x.values if x.is_valid else None
                ok = label is not None and values is not None and len(values) > 0 and values.null_count == 0
                if ok:
                    v = values.to_numpy(zero_copy_only=False).astype("<f4" if single else "<f8")
                    ok = bool(np.isfinite(v).all() and v.any())
                dims.append(len(v) if ok else None)
                raw.append(v.tobytes() if ok else None)
                digests.append(xxhash.xxh128_digest(raw[-1]) if ok else bytes(16))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [batch.column("vec_id").cast(pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32())]
            columns += [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "dim", "d1", "d2", "vec"])

    chosen = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    return chosen.mapInArrow(of_task, "vec_id long, label long, dim int, d1 long, d2 long, vec binary")


def _scaled(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors in double precision, times a power of two, and their lengths; so squares neither vanish nor overflow and no digit changes."""
    x = np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dim else "<f8").reshape(len(raw), dim).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def four_bits(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated coordinates in four bits: packed levels, the lowest value and the step of each row, and sum |left out| / sqrt(d)."""
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / 15, 1e-30)
    levels = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    left = np.abs(turned - (low[:, None] + step[:, None] * levels)).sum(1) / math.sqrt(turned.shape[1])
    even = np.pad(levels, ((0, 0), (0, levels.shape[1] % 2)))
    return even[:, ::2] << 4 | even[:, 1::2], low, step, left


def from_four_bits(packed: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int) -> np.ndarray:
    """The rotated coordinates that the levels stand for."""
    levels = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(packed), -1)[:, :dim]
    return (low[:, None] + step[:, None] * levels).astype(np.float32)


def _coded(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x, length = _scaled(part.column("vec").to_pylist(), int(dim))
                x /= length[:, None]
                packed, factors, runs = codes(x, bits, tables)
                levels, low, step, left = four_bits(x @ rotation(int(dim), 0).T)
                extra = {
                    "code": pa.array([c.tobytes() + v.tobytes() for c, v in zip(packed, levels, strict=True)], pa.binary()),
                    "about": pa.array([v.tobytes() for v in np.stack([factors, low, step, left], 1).astype("<f4")], pa.binary()),
                    "runs": pa.array([r.tobytes() for r in runs], pa.binary()),
                    "keys": pa.array([*keys_of(runs, bits, tables)], pa.list_(pa.int64())),
                }
                part = part.select([c for c in part.schema.names if c != "vec"])
                for name, column in extra.items():
                    part = part.append_column(name, column)
                yield part

    return nodes.mapInArrow(of_task, "id long, d1 long, label long, dim int, weight long, code binary, about binary, runs binary, keys array<long>")


class _Tile:
    """The rows of a tile, whose pairs are those of its two chunks."""

    def __init__(self, rows: pa.Table, bits: int, tables: int):
        self.ids, self.weight, self.chunk, self.label, self.dims = (rows.column(c).to_numpy() for c in ("id", "weight", "chunk", "label", "dim"))
        self.table, self.ti, self.tj = (int(rows.column(c)[0].as_py()) for c in ("t", "ti", "tj"))
        self.dim = int(self.dims[0])
        self.keys = keys_of(np.frombuffer(b"".join(rows.column("runs").to_pylist()), np.uint8).reshape(len(self.ids), -1), bits, tables)
        self.left, self.right = np.flatnonzero(self.chunk == self.ti), np.flatnonzero(self.chunk == self.tj)

    def pairs(self, near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that ``near(rows of the left side)`` leaves and that meet here first, some at a time."""
        for start in range(0, len(self.left), ROWS_AT_ONCE):
            some = self.left[start : start + ROWS_AT_ONCE]
            found = near(some)
            if self.ti == self.tj:
                found &= self.right[None, :] < some[:, None]
            p, q = (side[at] for side, at in zip((some, self.right), np.nonzero(found), strict=True))
            for a in range(0, len(p), PAIRS_AT_ONCE):
                i, j = p[a : a + PAIRS_AT_ONCE], q[a : a + PAIRS_AT_ONCE]
                ok = (self.keys[i, self.table] == self.keys[j, self.table]) & (self.label[i] == self.label[j]) & (self.dims[i] == self.dims[j])
                ok &= ~(self.keys[i, : self.table] == self.keys[j, : self.table]).any(1)
                yield i[ok], j[ok]


def _hopeful(rows: pa.Table, threshold: float, bits: int, tables: int) -> np.ndarray:
    """Which rows of a tile are in a pair that may be a link, by codes and bounds alone."""
    tile = _Tile(rows, bits, tables)
    d = tile.dim
    both = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(tile.ids), -1)
    f, low, step, left_out = np.frombuffer(b"".join(rows.column("about").to_pylist()), "<f4").reshape(len(tile.ids), 4).astype(np.float64).T
    signs = np.unpackbits(both[:, : -(-d // 8)], axis=1)[:, :d]
    coded = (signs.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
    kept = from_four_bits(both[:, -(-d // 8) :], low, step, d)
    bound = threshold - math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - f * f)) / f
    # Of the two errors, one belongs to the right row's code and one to the left row's four bits, divided by the right row's factor.
    least = (bound[tile.right] - 1e-4).astype(np.float32)
    scaled = np.ascontiguousarray((coded[tile.right] / f[tile.right, None].astype(np.float32)).T)
    slack = (1 / f[tile.right]).astype(np.float32)
    out = np.zeros(len(tile.ids), bool)
    for i, j in tile.pairs(lambda some: kept[some] @ scaled >= least - left_out[some, None].astype(np.float32) * slack):
        out[i] = out[j] = True
    return out


def _exact(rows: pa.Table, threshold: float, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, target) of a tile: links met here for the first time, and the smallest id reached by them."""
    tile = _Tile(rows, bits, tables)
    x, length = _scaled(rows.column("vec").to_pylist(), tile.dim)
    narrow = (x / length[:, None]).astype(np.float32)
    across = np.ascontiguousarray(narrow[tile.right].T)
    kept = []
    for i, j in tile.pairs(lambda some: narrow[some] @ across >= np.float32(threshold - 1e-4)):
        ok = np.einsum("ij,ij->i", x[i], x[j]) / (length[i] * length[j]) >= threshold
        kept.append(np.stack([i[ok], j[ok]]))
    i, j = np.concatenate(kept, 1) if kept else (np.empty(0, np.int64),) * 2
    ids, weight = tile.ids, tile.weight
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    target = ids.copy()
    while len(i):
        before = target.copy()
        np.minimum.at(target, i, before[j])
        np.minimum.at(target, j, before[i])
        if (target == before).all():
            break
    some = links > 0
    return ids[some], links[some].astype(np.int64), target[some]


def _tiles(rows: DataFrame, made_of, schema: str) -> DataFrame:
    """What ``made_of`` gives for each tile, the rows of one ``g``; rows come sorted by it."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            g = table.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    yield from made_of(table.slice(a, b - a).combine_chunks()).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
            if last or (held and held[-1].column("g")[-1].as_py() != g[-1]):
                yield from groups(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from groups(pa.Table.from_batches(held))

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(released(of_task), schema)


#: What a row of a tile carries besides its code or its vector.
PLACE = "g long, id long, d1 long, label long, dim int, weight long, runs binary, t int, chunk long, ti long, tj long"


def _linked(placed: DataFrame, nodes: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """(id, links, target) of all tiles: codes leave the rows that fetch their vectors, and these are compared."""
    place = [c.split()[0] for c in PLACE.split(", ")]

    def hopeful(tile: pa.Table) -> pa.Table:
        return tile.filter(pa.array(_hopeful(tile, threshold, bits, tables))).select(place)

    def exact(tile: pa.Table) -> pa.Table:
        return pa.table(dict(zip(("id", "links", "target"), map(pa.array, _exact(tile, threshold, bits, tables)), strict=True)))

    left = cut(_tiles(placed.select(*place, "code", "about"), hopeful, PLACE))
    with_vectors = left.join(nodes.select("id", "d1", "vec"), ["id", "d1"])
    return cut(_tiles(with_vectors.select(*place, "vec"), exact, "id long, links long, target long"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    prepared = _prepared(vectors)
    rows = cut(prepared.drop("vec"))
    usable = prepared.where("dim is not null and vec_id is not null")
    nodes = usable.groupBy("label", "dim", "d1", "d2").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec")
    )
    nodes = cut(nodes)
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = table_plan(largest, threshold, miss)
    coded = _coded(nodes.select("id", "d1", "label", "dim", "weight", "vec"), bits, tables)
    each = coded.select("*", F.posexplode("keys").alias("t", "key"))
    hot = each.groupBy("label", "dim", "t", "key").count().where(F.col("count") > CHUNK)
    hot = hot.withColumn("chunks", F.expr(f"(count + {CHUNK - 1}) div {CHUNK}")).drop("count")
    each = each.join(hot, ["label", "dim", "t", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    each = each.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.col("chunks")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    each = each.withColumns({"ti": F.least("chunk", "other"), "tj": F.greatest("chunk", "other")})
    each = each.withColumn("g", F.xxhash64("label", "dim", "t", "key", "ti", "tj"))
    found = _linked(each, nodes, threshold, bits, tables)
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("src"), F.col("target").alias("dst")))
    of_node = nodes.join(degree, "id", "left").join(comp, "id", "left")
    of_node = of_node.select(
        *["label", "dim", "d1", "d2"],
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    own = ["vec_id", "label", "dim", "d1", "d2"]
    out = rows.select(*own).join(of_node, ["label", "dim", "d1", "d2"], "left")
    usable_row = F.col("vec_id").isNotNull()
    n_links = F.when(usable_row, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links")
    component = F.when(usable_row, F.coalesce("component_id", "vec_id")).alias("component_id")
    return out.select("vec_id", n_links, component).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
