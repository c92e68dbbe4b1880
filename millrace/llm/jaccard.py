"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Two sets of sizes up to n with a Jaccard similarity of t share at least ceil(t * n) shingles, so under any order of
all shingles, the first n - ceil(t * n) + 2 of each set (its prefix) have two in common. Light sets enumerate the
two-element subsets of their prefix as keys; heavy sets put the elements of theirs into inverted lists, which are
scanned for partners that are met twice. A set near the boundary does both. The boundary is the largest size at which
enumerating costs no more than scanning, by the measured mean length of a list.

The order puts shingles seen often late (a sketch of fixed size, filled from all texts), then short ones, so prefixes
hold what few texts share. It decides the cost only; any order finds all links.

Links are wanted up to components, so a group of near copies needs no pair of all its members: each list and size
class has one leader, a member is compared with the leader it meets most, and what is then in one component is not
compared again. In the last pass, every list that still holds two components is led by the member with the largest
share of common prefix elements, and each member goes to the ball of every leader it meets; two sets that meet in a
list share a ball. A small
ball compares its members across components. In a ball with more pairs than shingles, sets are told by their
differences from the leader: for sets S, B and differences dS, dB from leader L, the sizes of S xor B and of dS xor dB
are the same, so similar sets that the leader does not link already must share at least half of the smaller
difference; elements of one difference alone are of no use, and the same prefix rule as before, now on the
differences, finds all pairs left. Where these outnumber their sets, the likeliest pair of each set is compared first,
and the rest only where it still parts two components. No link between components is lost. Equal sets are one node throughout. Candidates
are compared by their whole sets of 64-bit hashes.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle give one
shingle of them all; repeated rows are linked with each other; rows with one doc_id and different texts count as one
document in components (n_shingles is that of each row); an empty table gives no rows; further columns are ignored; a
row without doc_id links no other rows, and has the component of the documents with its set, or null if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.store import Scratch, narrow_batches, released
from millrace.llm.tokens import slices

SLOTS = 1 << 22
BLOCKS = 16
CHUNK_SHINGLES = 1 << 20
SAMPLED = 128
SAMPLED_LEAST = 3
SEEN_OFTEN = tuple(4 << i for i in range(15))
PAIRS_FOR_SPANNING = 2.0
HEAVY_BALL = 2.0
OFTEN = 64
CELLS, CELL_LEVELS = 512, 16
SLICE_BYTES = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; multiplications wrap around."""
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the distinct hashes of its shingles, ascending, and their lengths in bytes."""
    import pandas as pd

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.values.dictionary_encode()
    index = flat.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    names = pc.ascii_lower(flat.dictionary)  # of distinct words: it is wrong on slices of an array
    hashes = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False)[index]
    sizes = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    full = sizes > 0  # splitting leaves empty pieces at the ends of a text
    ends = np.concatenate([[0], np.cumsum(full)])[bounds]
    hashes, sizes = hashes[full], sizes[full]
    if len(hashes) >= words:
        k = len(hashes) - words + 1
        whole, length = mix(hashes[:k]), sizes[:k].copy()
        for j in range(1, words):
            whole = mix(whole + hashes[j : j + k])
            length += sizes[j : j + k]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= words:
            found, at = np.unique(whole[a : b - words + 1], return_index=True)
            yield found, length[a : b - words + 1][at]
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for x in hashes[a:b]:
                short = mix(short + x)
            yield short, sizes[a:b].sum(keepdims=True)
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)


def cells_of(found: np.ndarray) -> bytes:
    """How many shingles fall into each of CELLS cells, modulo CELL_LEVELS, two cells in a byte."""
    n = np.bincount((found >> np.uint64(17)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint8) % CELL_LEVELS
    return (n[::2] << 4 | n[1::2]).tobytes()


def cells_apart(a: pa.Array, b: pa.Array) -> np.ndarray:
    """For each pair of cell counts a number that the symmetric difference of the sets reaches at least."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS // 2) for c in (a, b))
    out = np.zeros(len(x), np.int64)
    for p, q in ((x >> 4, y >> 4), (x & 15, y & 15)):
        d = (p - q) % CELL_LEVELS
        out += np.minimum(d, CELL_LEVELS - d).sum(1, dtype=np.int64)
    return out


def least_shared(n: int, percent: int) -> int:
    """The least number of shingles that a set of n shares with any partner."""
    return -(-percent * n // 100)


def prefix(found: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The first n - least_shared(n) + 2 shingles: rarely seen before often seen ones, then long before short ones."""
    often = sketch[(found % np.uint64(SLOTS)).astype(np.int64)].astype(np.uint64)
    short = np.uint64(31) - np.minimum(sizes // 4, 31).astype(np.uint64)
    key = often << np.uint64(60) | short << np.uint64(55) | found >> np.uint64(9)
    p = min(len(found), len(found) - least_shared(len(found), percent) + 2)
    return found[np.argpartition(key, p - 1)[:p]] if p < len(found) else found


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bytes_of_slots(slots: DataFrame) -> np.ndarray:
    """An array of SLOTS bytes with the highest level of each slot, from rows (slot, level); BLOCKS short rows reach the driver."""
    each = SLOTS // BLOCKS

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slot, level = (batch.column(c).to_numpy() for c in ("slot", "level"))
            for b in np.unique(slot // each):
                here = held.setdefault(int(b), np.zeros(each, np.uint8))
                mine = slot // each == b
                here[slot[mine] % each] = level[mine]
        for b, x in held.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bytes": pa.array([x.tobytes()])})

    one = slots.groupBy("slot").agg(F.max("level").alias("level"))
    rows = one.repartition(BLOCKS, F.expr(f"slot div {each}")).mapInArrow(of_task, "block int, bytes binary").collect()
    out = np.zeros(SLOTS, np.uint8)
    for r in rows:
        out[r.block * each : (r.block + 1) * each] |= np.frombuffer(r.bytes, np.uint8)
    return out


def summaries(docs: DataFrame, words: int) -> DataFrame:
    """One pass over the texts. Rows with a ``doc_id`` hold a set's size and digest; others count shingles in a chunk.

    A chunk is a bounded number of shingles. Of its distinct sets it reports shingles in at least SEEN_OFTEN[0] of
    them (``slot`` and ``n``), and in a row without slot the sums that give the mean length of a list. Shingles that
    are spread thinly over many chunks show in ``sampled``: their number in one of SAMPLED sets, chosen by digest.
    These counts decide the order and the dealing of shingles only, never which links are found.
    """

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["doc_id", "n", "d1", "d2", "cells", "slot", "squares", "sampled"]
        seen: set[bytes] = set()
        chunk: list[np.ndarray] = []
        some: list[np.ndarray] = [np.empty(0, np.uint64)]
        held = 0

        def counted() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(chunk), return_counts=True)
            often = times >= SEEN_OFTEN[0]
            slot = (found[often] % np.uint64(SLOTS)).astype(np.int64)
            thin, few = np.unique(np.concatenate(some) % np.uint64(SLOTS), return_counts=True)
            slots = pa.concat_arrays([pa.array(slot, pa.int64()), pa.array(thin.astype(np.int64)), pa.nulls(1, pa.int64())])
            n = np.concatenate([times[often], np.zeros(len(thin), np.int64), [times.sum()]])
            squares = np.append(np.zeros(len(n) - 1, np.int64), (times.astype(np.int64) ** 2).sum())
            sampled = np.concatenate([np.zeros(len(slot), np.int64), few, [0]])
            none = pa.nulls(len(n), pa.int64())
            own = [slots, pa.array(squares), pa.array(sampled)]
            return pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none, none, pa.nulls(len(n), pa.binary()), *own], names)

        for part in slices(batches, "text", SLICE_BYTES):
            sizes, digests, cells = [], [], []
            for found, _ in shingles(part.column("text"), words):
                cells.append(cells_of(found) if len(found) else None)
                digest = xxhash.xxh128_digest(found.tobytes())
                sizes.append(len(found))
                digests.append(digest)
                if len(found) and digest not in seen:
                    seen.add(digest)
                    chunk.append(found)
                    if digest[0] % SAMPLED == 0:
                        some.append(found)
                    held += len(found)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = pa.nulls(len(sizes), pa.int64())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cells, pa.binary()), none, none, none], names)
            if held >= CHUNK_SHINGLES:
                yield counted()
                seen.clear()
                chunk, some, held = [], [np.empty(0, np.uint64)], 0
        if held:
            yield counted()

    schema = "doc_id long, n long, d1 long, d2 long, cells binary, slot long, squares long, sampled long"
    return docs.select("doc_id", "text").mapInArrow(released(of_task), schema)


def boundary(mean_list: float, percent: int) -> int:
    """The largest size whose subsets cost no more than scanning its lists: p (p - 1) / 2 keys against p lists."""
    n = 1
    while True:
        p = n + 1 - least_shared(n + 1, percent) + 2
        if p * (p - 1) / 2 > p * (1 + mean_list):
            return n
        n += 1


def dealt_level(sketch: np.ndarray) -> int:
    """The least level from which shingles are dealt out evenly: at most one slot of 16 may be marked by it.

    With more slots marked, shingles that are not seen often would be taken for such; a shingle of a lower level has
    rows for few tasks only by comparison with the number of slots.
    """
    marked = np.bincount(sketch, minlength=len(SEEN_OFTEN) + 1)[::-1].cumsum()[::-1]
    return next((k for k in range(1, len(marked)) if marked[k] <= SLOTS // 16), len(marked))


def postings(docs: DataFrame, words: int, percent: int, sketch: np.ndarray, light: int, firsts: np.ndarray) -> DataFrame:
    """(doc_id, n, keys, weights) for the documents in slots marked in ``firsts`` (a few others may come along).

    Subset keys count for two common elements, list keys for one; OFTEN is added for shingles known to be seen often.
    """
    least = dealt_level(sketch)
    sc = docs.sparkSession.sparkContext
    sent, chosen = sc.broadcast(sketch), sc.broadcast(firsts)  # SLOTS bytes each, whatever the input's size

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_heavy = least_shared(light + 1, percent)  # the smallest partner of a heavy set
        for part in slices((_marked(b, "doc_id", chosen.value) for b in batches), "text", SLICE_BYTES):
            sizes, keys, weights = [], [], []
            for found, length in shingles(part.column("text"), words):
                n, mine, count = len(found), [], []
                if n >= 2:
                    head = np.sort(prefix(found, length, sent.value, percent))
                    often = (sent.value[(head % np.uint64(SLOTS)).astype(np.int64)] >= least).astype(np.int8) * OFTEN
                    if n <= light:
                        i, j = np.triu_indices(len(head), 1)
                        mine.append(mix(head[i] + mix(head[j])))
                        count.append(np.minimum(often[i], often[j]) + np.int8(2))
                    if n >= first_heavy:
                        mine.append(head)
                        count.append(often + np.int8(1))
                sizes.append(n)
                keys.append(np.concatenate(mine) if mine else np.empty(0, np.uint64))
                weights.append(np.concatenate(count) if count else np.empty(0, np.int8))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            flat = pa.array(_signed(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(offsets, flat),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(weights), pa.int8())),
                ],
                ["doc_id", "n", "keys", "weights"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(of_task), "doc_id long, n int, keys array<long>, weights array<byte>")


def sets_of(docs: DataFrame, words: int, live: np.ndarray) -> DataFrame:
    """(id, set) for the documents in slots marked in ``live`` (a few others may come along); sets as 64-bit bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(live)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices((_marked(b, "doc_id", sent.value) for b in batches), "text", SLICE_BYTES):
            sets = [found.tobytes() for found, _ in shingles(part.column("text"), words)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])

    return docs.select("doc_id", "text").mapInArrow(released(of_task), "id long, set binary")


def _marked(batch: pa.RecordBatch, column: str, slots: np.ndarray) -> pa.RecordBatch:
    """The rows whose id lies in a marked slot; a null id does not."""
    ids = batch.column(column).cast(pa.int64())
    known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    slot = (mix(known) % np.uint64(SLOTS)).astype(np.int64)
    return batch.filter(pc.and_(ids.is_valid(), pa.array(slots[slot] > 0)))


def _met(rows: DataFrame) -> DataFrame:
    """Rows (g, id, n, key, w) with a neighbour of the same ``g``, and all rows of shingles seen often, in one streaming pass."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "key", "w"]
        held: pa.RecordBatch | None = None  # the last row, whose successor is not known yet
        before = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            same = g[1:] == g[:-1]
            kept = np.concatenate([[before is not None and g[0] == before], same])[: len(g) - 1] | same
            kept |= batch.column("w").to_numpy()[:-1] >= OFTEN
            yield batch.slice(0, len(g) - 1).filter(pa.array(kept)).select(names)
            held, before = batch.slice(len(g) - 1), (g[-2] if len(g) > 1 else before)
        if held is not None:
            if held.column("g")[0].as_py() == before or held.column("w")[0].as_py() >= OFTEN:
                yield held.select(names)

    return rows.mapInArrow(released(of_task), "id long, n int, key long, w byte")


def _live_slots(ids: DataFrame) -> np.ndarray:
    """The slots of the ids, as :func:`sets_of` looks them up."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            slot = (mix(ids.view(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "level": pa.array(np.ones(len(slot), np.int8))})

    return _bytes_of_slots(ids.mapInArrow(of_task, "slot long, level byte"))


def _sets_in(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, set) for the documents in ``ids`` (a few others may come along).

    Where most slots are marked, they tell little, and the texts are joined with the ids before sets are made.
    """
    live = _live_slots(ids)
    if np.count_nonzero(live) > SLOTS // 2:
        docs = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    return sets_of(docs, words, live)


def verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity; only sets of documents in a pair are made and moved."""
    sets = _sets_in(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                shared = int((large[at] == small).sum())
                kept.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(released(of_task), "a long, b long")


def similar(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text); two texts link at ``percent`` or more."""
    narrow_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    told = scratch.cut(summaries(docs, words))
    sets = told.where("slot is null and squares is null").select("doc_id", "n", "d1", "d2")
    cells = told.where("cells is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "cells")
    sums = told.where("squares is not null")
    s = sums.where("slot is null").agg(F.sum("n"), F.sum("squares")).first()
    mean_list = (s[1] / s[0] - 1) if s[0] else 0.0
    level = F.lit(0)
    for i, least in enumerate(SEEN_OFTEN):
        level = F.when(F.col("n") >= least, i + 1).otherwise(level)
    often = sums.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("sampled").alias("sampled"))
    spread = F.when(F.col("sampled") >= SAMPLED_LEAST, F.col("sampled") * SAMPLED).otherwise(0)
    often = often.select("slot", F.greatest("n", spread).alias("n")).select("slot", level.cast("byte").alias("level"))
    sketch = _bytes_of_slots(often.where("level > 0"))
    light = boundary(mean_list, percent)

    firsts = sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    named = sets.join(firsts, ["d1", "d2"], "left")
    reps = firsts.select(F.col("rep").alias("id"))
    posted = postings(docs, words, percent, sketch, light, _live_slots(reps))
    flat = posted.select(F.col("doc_id").alias("id"), "n", F.explode(F.arrays_zip("keys", "weights")).alias("k"))
    flat = flat.select("id", "n", F.col("k.keys").alias("key"), F.col("k.weights").alias("w"))
    # Keys that one document alone has are of no use. Those seen often need no look and are dealt out evenly.
    g = F.when(F.col("w") >= OFTEN, F.xxhash64("key", "id")).otherwise(F.col("key")).alias("g")
    dealt = flat.select(g, "id", "n", "key", "w").repartition("g").sortWithinPartitions("g")
    met = _met(dealt).withColumn("w", F.expr(f"cast(w % {OFTEN} as byte)"))
    # Copies that came along go. What a document has in its lists is counted where the join has brought its rows.
    live = scratch.cut(_with_common(met.join(reps, "id", "left_semi")).withColumn("component", F.col("id")))
    pairs = scratch.cut(_by_cells(_leader_pairs(live, percent), cells, percent))
    links = scratch.cut(verified(docs, pairs, words, percent))
    rows = scratch.cut(_open_rows(live, _components(links)))
    scratch.free(live, pairs)
    near = scratch.cut(_balls(rows, scratch))
    scratch.free(rows)
    pairs = _across(near, percent).unionByName(_by_differences(docs, near, words, percent, scratch)).distinct()
    pairs = scratch.cut(_by_cells(pairs, cells, percent))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).agg(F.countDistinct("id")).first()[0]
    if pairs.count() > PAIRS_FOR_SPANNING * ids:
        best = pairs.groupBy("b").agg(F.min(F.struct("apart", F.xxhash64("a").alias("h"), "a")).alias("m"))
        best = scratch.cut(best.select("m.a", "b"))
        links = scratch.cut(links.unionByName(verified(docs, best, words, percent)))
        comp = _components(links)
        rest = pairs.join(best, ["a", "b"], "left_anti")
        for k in "ab":
            rest = rest.join(comp.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")), k, "left")
        pairs = scratch.cut(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "apart"))
    comp = _components(links.unionByName(verified(docs, pairs, words, percent)))
    out = named.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    own = F.coalesce("component", "rep", "doc_id").alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own)


def _may_reach(percent: int, c: Column | None = None) -> Column:
    """Whether sets of ``na`` and ``nb`` shingles can reach the similarity, by what their prefixes share.

    ``k1`` counts common list keys and ``k2`` common subset keys, so c = max(k1, (1 + sqrt(1 + 8 k2)) / 2) shingles are in
    both prefixes. All of a set's prefix that the other holds is in the other's prefix for the set whose prefix ends
    first, so the sets share at most c and what lies behind that prefix.
    """
    c = _common("k1", "k2") if c is None else c
    # A set of n has least_shared(n) - 2 shingles behind its prefix, the larger set has more.
    behind = F.greatest(F.expr(f"(greatest(na, nb) * {percent} + 99) div 100 - 2"), F.lit(0))
    needed = F.expr(f"(na + nb) * {percent} + {99 + percent}") / (100 + percent)
    fits = F.expr(f"na * 100 >= nb * {percent} and nb * 100 >= na * {percent}")
    return fits & (c >= 2) & (c + behind >= F.floor(needed))


def _common(k1: str, k2: str) -> Column:
    """The number of shingles behind so many list keys and subset keys."""
    pairs = F.when(F.col(k2) > 0, F.floor((1 + F.sqrt(1 + 8.0 * F.col(k2))) / 2 + 1e-6)).otherwise(0)
    return F.greatest(F.col(k1), pairs)


def _components(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _with_common(rows: DataFrame) -> DataFrame:
    """The rows (key, id, n, w) with ``c``, which bounds what a document's prefix shares with any one partner; a link needs two at least.

    A window holds the rows of one document, at most a few for each of its shingles.
    """
    own = Window.partitionBy("id")
    counts = [F.count_if(F.col("w") == k).over(own).alias(f"k{k}") for k in (1, 2)]
    out = rows.select("key", "id", "n", "w", *[c for c in ("component",) if c in rows.columns], *counts)
    return out.withColumn("c", _common("k1", "k2").cast("int")).where("c >= 2").drop("k1", "k2")


def _leader_pairs(live: DataFrame, percent: int) -> DataFrame:
    """For each document the leader that it meets most, at least twice.

    A leader is the member of a list and size class with the largest share of common elements; classes are as wide as
    partners may differ. This decides which pairs are compared early; pairs that it leaves out are left to the last pass.
    """
    scale = 1 / float(np.log(100 / percent))
    rows = live.withColumn("class", F.floor(F.log(F.col("n").cast("double")) * scale).cast("int"))
    first = F.max(F.struct((F.col("c") / F.col("n")).cast("float").alias("o"), "id", "n")).alias("l")
    met = rows.join(rows.groupBy("key", "class").agg(first), ["key", "class"]).where("id <> l.id")
    met = met.groupBy(F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb"))
    met = met.agg(F.count_if(F.col("w") == 1).alias("k1"), F.count_if(F.col("w") == 2).alias("k2")).where(_may_reach(percent))
    met = met.withColumn("c", F.col("k1") + F.col("k2"))
    best = met.groupBy("b", "nb").agg(F.max_by(F.struct("a", "na"), F.struct("c", F.xxhash64("a"))).alias("l"))
    return best.select("l.a", "l.na", "b", "nb")


def _open_rows(live: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows of the lists with more than one component."""
    named = live.select("key", "id", "n", "w").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return _with_common(named.join(mixed.select("key"), "key"))


def _balls(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(leader, ln, lc, lcomponent, id, n, component, c, heavy): each document under every leader of its lists.

    A list is led by the member with the largest share of common elements, so the lists of a group of near copies
    mostly agree. A ball is heavy where its pairs outnumber all shingles of its members and leader.
    """
    first = F.max(F.struct((F.col("c") / F.col("n")).cast("float").alias("o"), "id", "n", "c", "component")).alias("l")
    led = rows.join(rows.groupBy("key").agg(first), "key").where("id <> l.id")
    names = [F.col("l.id").alias("leader"), F.col("l.n").alias("ln"), F.col("l.c").alias("lc"), F.col("l.component").alias("lcomponent")]
    near = scratch.cut(led.select(*names, "id", "n", "component", "c").distinct())
    size = near.groupBy("leader").agg((F.count("*") > HEAVY_BALL * F.avg(F.col("n") + F.col("ln"))).alias("heavy"))
    return near.join(size, "leader")


def _across(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of different components: each leader with its ball, and the members of light balls."""
    names = {"id": "", "n": "n", "component": "c", "c": "most_"}
    own = near.withColumnsRenamed({"leader": "a", "ln": "na", "lcomponent": "ca", "lc": "most_a", "id": "b", "n": "nb", "component": "cb", "c": "most_b"})
    left, right = (near.where("not heavy").select("leader", *[F.col(x).alias(y + k) for x, y in names.items()]) for k in "ab")
    apart = (F.col("ca") != F.col("cb")) & _may_reach(percent, F.least("most_a", "most_b"))
    both = left.join(right, "leader").where((F.col("a") < F.col("b")) & apart)
    return own.where(apart).select("a", "na", "b", "nb").unionByName(both.select("a", "na", "b", "nb"))


def _by_differences(docs: DataFrame, near: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, na, b, nb) of members of heavy balls that may be similar and are not both linked with the leader.

    Sets of na and nb shingles are similar if they differ in at most q (na + nb), q = (1 - t) / (1 + t). With
    differences of da and db shingles from a leader of l, they share (da + db - |a xor b|) / 2 of these, so at least
    (da + db - q (na + nb)) / 2. ``least`` is the smallest such number over all partners: (da - q (na + l)) / (1 + q)
    where the leader does not link a, as a partner's nb - l and da - |a xor b| are at most db, and more than
    (da + q (l - na)) / 2 where it does, as then it must not link b. Both are 1 or more.
    """
    q, whole = 100 - percent, 100 + percent
    heavy = near.where("heavy").select("leader", "id", "component")
    sets = _sets_in(docs, heavy.select(F.explode(F.array("leader", "id")).alias("id")).distinct(), words)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d, linked, least, found = [], [], [], [], []
            for x, y in zip(batch.column("set"), batch.column("own"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                apart = np.setxor1d(x, y, assume_unique=True)
                n.append(len(y))
                d.append(len(apart))
                beyond = len(apart) * whole - q * (len(x) + len(y))
                linked.append(beyond <= 0)
                if beyond <= 0:
                    least.append(max(1, (len(apart) * whole + q * (len(x) - len(y))) // (2 * whole) + 1))
                else:
                    least.append(max(1, -(-beyond // 200)))
                found.append(apart)
            offsets = pa.array(np.concatenate([[0], np.cumsum(d, dtype=np.int64)]), pa.int32())
            flat = pa.array(_signed(np.concatenate(found) if found else np.empty(0, np.uint64)))
            columns = [pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(linked, pa.bool_()), pa.array(least, pa.int32())]
            own = [batch.column(c) for c in ("leader", "id", "component")]
            yield pa.RecordBatch.from_arrays([*own, *columns, pa.ListArray.from_arrays(offsets, flat)], [*"lik", "n", "d", "linked", "least", "x"])

    both = heavy.join(sets.select(F.col("id").alias("leader"), "set"), "leader")
    both = both.join(sets.select("id", F.col("set").alias("own")), "id").select("leader", "id", "component", "set", "own")
    each = both.mapInArrow(released(of_task), "l long, i long, k long, n int, d int, linked boolean, least int, x array<long>")
    each = scratch.cut(each.withColumn("x", F.explode("x")))
    shared = each.groupBy("l", "x").agg(F.count("*").alias("times")).where("times > 1")
    each = each.join(shared, ["l", "x"])
    of_set = Window.partitionBy("l", "i")
    each = each.withColumn("useful", F.count("*").over(of_set)).where("useful >= least")
    place = F.row_number().over(of_set.orderBy("times", "x"))
    each = scratch.cut(each.withColumn("place", place).where("place <= useful - least + 1"))
    names = {"i": "", "k": "c", "n": "n", "d": "d", "linked": "linked_", "useful": "useful_"}
    left, right = (each.select("l", "x", *[F.col(x).alias(y + k) for x, y in names.items()]) for k in "ab")
    apart = F.expr("a < b and ca <> cb and not (linked_a and linked_b)")
    fits = F.expr(f"na * 100 >= nb * {percent} and nb * 100 >= na * {percent}")
    needed = F.expr(f"2 * {whole} * least(useful_a, useful_b) >= (da + db) * {whole} - {q} * (na + nb)")
    return left.join(right, ["l", "x"]).where(apart & fits & needed).select("a", "na", "b", "nb").distinct()


def _by_cells(pairs: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, apart) that can still be similar by the counts of their cells, with what these differ by.

    Sets differ in at least as many shingles as their cells do; similar sets of na and nb shingles differ in at most
    (na + nb)(1 - t) / (1 + t). Only cells of documents in a pair are moved.
    """
    pairs = pairs.select("a", "na", "b", "nb")
    live = cells.sparkSession.sparkContext.broadcast(_live_slots(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _marked(batch, "id", live.value)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = cells_apart(batch.column("x"), batch.column("y"))
                most = (batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()) * (100 - percent)
                kept = pa.array(apart * (100 + percent) <= most)
                out = batch.select(["a", "b"]).append_column("apart", pa.array(apart, pa.int32()))
                yield out.filter(kept)

    near = cells.mapInArrow(some, "id long, cells binary")
    both = pairs.join(near.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b")
    both = both.join(near.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a")
    return both.select("a", "na", "b", "nb", "x", "y").mapInArrow(released(of_task), "a long, b long, apart int")
