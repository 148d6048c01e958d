"""Near-duplicates by SimHash and BK-trees."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitspark.llm.common import key_map, lean, maybe_in, small_batches, text_of, written
from fitspark.llm.components import connected_components
from fitspark.llm.exact_dedup import suspect_fingerprints

SHINGLE = 5
#: The share of shingles that texts must have in common for a link beyond the radius.
SIMILARITY = 0.8
RADIUS = 3
BITS = 64
#: A shard of more fingerprints is dealt again by further bits.
MAX_SHARD = 512
#: Rounds of dealing; what is still large after the last is searched as it is.
LEVELS = 3


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of words in lower case; of all words if there are fewer; none of none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(42)), np.uint64, max(1, len(words) - shingle + 1))


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of a text, as an unsigned 64-bit integer."""
    return _majority(shingle_hashes(text, shingle))


def _majority(h: np.ndarray) -> int:
    n = len(h)
    ones = np.zeros(BITS, np.int64)
    for part in range(0, n, 1 << 16):  # bounds the memory of a very long text
        ones += np.unpackbits(h[part : part + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return mapped


class BKTree:
    """A BK-tree of integers under Hamming distance: children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Indices of the values within the radius; afterwards `value` is in the tree too."""
        values, children = self.values, self.children
        found = []
        stack = [0] if values else []
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            edges = children[node]
            if len(edges) <= 2 * radius + 1:
                stack += [child for e, child in edges.items() if d - radius <= e <= d + radius]
            else:
                stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        new = len(values)
        values.append(value)
        children.append({})
        node = 0
        while new:
            d = (values[node] ^ value).bit_count()
            if (child := children[node].get(d)) is None:
                children[node][d] = new
                break
            node = child
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """For each value that is linked within the shard, directly or over others, (value, root of its part)."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in tree.near_then_add(v, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [(values[i], values[t]) for i in range(len(values)) if (t := top(i)) != i]


def _linked(radius: int):
    """Walk shards that come sorted by key, one at a time."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_held, held = None, []

        def out(pairs):
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

        for b in batches:
            keys, fps = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(keys):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            values, pairs = fps.view(np.uint64).tolist(), []
            for lo, hi in zip(cuts, cuts[1:]):
                if keys[lo] != key_held:
                    if len(held) > 1:
                        pairs += shard_links(held, radius)
                    key_held, held = keys[lo], []
                held += values[lo:hi]
            if pairs:
                yield out(np.array(pairs, np.uint64).view(np.int64))
        if len(held) > 1:
            yield out(np.array(shard_links(held, radius), np.uint64).view(np.int64))

    return mapped


def _segments(width: int, radius: int) -> list[tuple[int, int]]:
    cuts = [width * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(cuts, cuts[1:]))


def _dealt(rows: DataFrame, width: int, radius: int) -> tuple[DataFrame, int]:
    """Rows (key, rest, fp) once for each of radius + 1 segments of rest; the key takes in the segment, rest loses it.

    Two rests that differ in at most `radius` bits agree on a whole segment, so each
    close pair meets in at least one of the new shards.
    """
    options: list[Column] = []
    most = max(hi - lo for lo, hi in _segments(width, radius))
    for i, (lo, hi) in enumerate(_segments(width, radius)):
        part = F.shiftrightunsigned("rest", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if hi - lo < 64 else F.col("rest")
        upper = F.shiftleft(F.shiftrightunsigned("rest", hi), lo) if hi < 64 else F.lit(0).cast("long")
        # Shards of different levels, segments and values never share a key: it holds them all.
        options.append(F.struct(F.xxhash64("key", F.lit(i), part).alias("key"), upper.bitwiseOR(F.col("rest").bitwiseAND(F.lit((1 << lo) - 1))).alias("rest")))
    return rows.select("fp", F.explode(F.array(*options)).alias("x")).select("x.key", "x.rest", "fp"), width - most


def close_links(distinct: DataFrame, *, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that chains of links within the radius connect.

    `distinct` has a column fp of distinct fingerprints. Shards are dealt by
    whole segments of the bits; one of more than `max_shard` fingerprints is dealt
    again by the bits left, so no shard grows with the input and no pair is lost.
    A shard gives one edge for each fingerprint at most, not its pairs.
    """
    rows, width = distinct.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp"), BITS
    small: list[DataFrame] = []
    for level in range(LEVELS):
        rows, width = _dealt(rows, width, radius)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        last = level == LEVELS - 1
        small.append(rows.join(sizes.where("n > 1" if last else f"n between 2 and {max_shard}").select("key"), "key", "left_semi").select("key", "fp"))
        if not last:
            rows = written(rows.join(sizes.where(f"n > {max_shard}").select("key"), "key", "left_semi"), "deep")
            if rows.isEmpty():
                break
    every = small[0]
    for s in small[1:]:
        every = every.union(s)
    spark = distinct.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(lean(_linked(radius)), "a long, b long")


#: Shingles are ranked by how often they occur in about so many documents; of them, so many at most are told apart.
RANKED_DOCS = 20_000
RANKED = 1 << 18
#: Room for rounding in bounds that must not shut out a pair.
EPSILON = 1e-9


def _distinct_shingles(shingle: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *(np.unique(shingle_hashes(t, shingle)) for t in b.column(0).to_pylist())]).view(np.int64))], ["gram"])

    return mapped


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several documents of a sample share, and their numbers of documents.

    They only put the shingles of each set in an order. Every order gives the same
    links; one that has rare shingles first gives fewer candidates.
    """
    share = min(1.0, RANKED_DOCS / max(1, docs.count()))
    some = (docs.sample(share, seed=5) if share < 1 else docs).select(text_of().alias("text"))
    counted = some.mapInArrow(lean(_distinct_shingles(shingle)), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = counted.orderBy(F.desc("n"), "gram").limit(RANKED).toArrow()
    grams, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix_of(grams: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of rank and hash: sets of this similarity have one of them in common.

    The partner of a set of s shingles holds at least similarity * s of them, so it
    cannot lack more than the rest.
    """
    rank = np.zeros(len(grams), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        rank = np.where(common[at] == grams, times[at], 0)
    most = len(grams) - int(np.ceil(similarity * len(grams) - EPSILON)) + 1
    return grams[np.lexsort((grams, rank))[:most]]


#: Longs of a set's sketch.
SKETCH = 8


def odd_sketch(grams: np.ndarray) -> np.ndarray:
    """Bits that say of which of the 64 * SKETCH classes of shingles a set has an odd number.

    Two sketches differ in no more bits than their sets have shingles that the other lacks.
    """
    odd = np.bincount((grams >> np.uint64(16)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCHES = [f"sk{i}" for i in range(SKETCH)]
PREFIXES = "doc_id long, fp long, sid long, size int, text_key long, prefix array<bigint>, " + ", ".join(f"{c} long" for c in SKETCHES)


def _prefixes(shingle: int, similarity: float, common: np.ndarray, times: np.ndarray):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sids, sizes, prefixes, sketches = [], [], [], [], np.zeros((b.num_rows, SKETCH), np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                h = shingle_hashes(t, shingle)
                grams = np.unique(h)
                fps.append(_majority(h))
                sids.append(xxhash.xxh3_64_intdigest(grams.tobytes()))
                sizes.append(len(grams))
                prefixes.append(prefix_of(grams, similarity, common, times).view(np.int64) if len(grams) else np.zeros(0, np.int64))
                sketches[i] = odd_sketch(grams)
            signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            columns = [b.column(0), signed(fps), signed(sids), pa.array(sizes, pa.int32()), b.column(2), pa.array(prefixes, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "sid", "size", "text_key", "prefix", *SKETCHES])

    return mapped


def _alike(shingle: int, similarity: float):
    """Those pairs of texts (a, b, text_a, text_b) whose sets have the similarity, as (a, b)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, held, grams = [], None, None
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if a != held:  # pairs with the same first set often follow each other
                    held, grams = a, np.unique(shingle_hashes(x, shingle))
                other = np.unique(shingle_hashes(y, shingle))
                shared = len(np.intersect1d(grams, other, assume_unique=True))
                if shared >= similarity * (len(grams) + len(other) - shared):
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    return mapped


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) of fingerprints for those pairs (a, b) of sets that have the similarity, from the whole texts.

    One text of each set asked for is shuffled and written; a pair then takes its
    texts along, which compress better than their shingles' hashes.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = written(asked.join(sets.select("sid", "fp", "text_key"), "sid"), "wanted")
    rows = docs.select(text_of().alias("sim_text")).withColumn("sim_key", F.xxhash64("sim_text"))
    some = maybe_in(rows, "sim_key", key_map(wanted, "text_key", wanted.count()), "sim_maybe").where("sim_maybe")
    one = some.groupBy("sim_key").agg(F.min("sim_text").alias("text"))
    texts = written(one.join(wanted, F.col("sim_key") == F.col("text_key")).select("sid", "text"), "texts")
    side = lambda k: texts.select(F.col("sid").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    good = written(both.mapInArrow(lean(_alike(shingle, similarity)), "a long, b long"), "similar")
    fp = lambda k: wanted.select(F.col("sid").alias(k), F.col("fp").alias(f"fp_{k}"))
    return good.join(fp("a"), "a").join(fp("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


#: Bits of a shingle's hash by which partitions ask each other whether others have it.
GRAM_BITS = 48


def shared_postings(light: DataFrame) -> DataFrame:
    """Rows (gram, sid, size, pos) of the prefixes in `light`, but for shingles that one set alone has.

    Most shingles of a prefix are nobody else's. Partitions learn which by the
    exchange of exact_dedup: some four bytes for each shingle go to its owner. Those
    that another has are few; a map of them picks their postings, and equal sets
    become one posting on the map side.
    """
    exploded = light.select("sid", "size", F.posexplode("prefix").alias("pos", "gram")).withColumn("key", F.expr(f"gram & {(1 << GRAM_BITS) - 1}L"))
    twice = written(suspect_fingerprints(exploded.select(F.col("key").alias("fp"), F.monotonically_increasing_id().alias("uid")), fingerprint_bits=GRAM_BITS).distinct(), "twice")
    some = maybe_in(exploded, "key", key_map(twice, "fp", twice.count()), "maybe").where("maybe")
    return some.groupBy("gram", "sid").agg(F.min("size").alias("size"), F.min("pos").alias("pos"))


#: Rounds of comparing with one set of each shingle.
ROUNDS = 3


def merged(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (fp, label) after further edges (a, b) of fingerprints."""
    at = lambda k: parts.select(F.col("fp").alias(k), F.col("label").alias(f"l{k}"))
    between = edges.join(at("a"), "a").join(at("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(parts.join(found, "label", "left").select("fp", F.coalesce("to", "label").alias("label")), "labelled")


def similar_parts(docs: DataFrame, light: DataFrame, parts: DataFrame, *, shingle: int, similarity: float) -> DataFrame:
    """The labels (fp, label) of `parts` after adding the links of all pairs of texts of this similarity.

    `light` has fp, sid (a hash of the set of shingles), size, text_key, prefix and
    sketch of each document. Two sets of the similarity share a shingle of their
    prefixes (see prefix_of()), whatever the number of documents. In some rounds each
    set is compared with one set of each of its shingles that it is not connected to
    yet; that connects nearly all that belongs together, by a comparison for each
    copy of a large group, not for each pair. Then all sets that share a shingle
    and are still not connected are compared with each other. Sizes, places in the
    prefixes and sketches rule out pairs that cannot have the similarity before any
    text is read; none of these bounds shuts out a pair that has it. Texts without
    words have no links.
    """
    light = light.where("size > 0")
    first = [F.any_value(c).alias(c) for c in SKETCHES]
    sets = written(light.groupBy("sid").agg(F.min("fp").alias("fp"), F.min("text_key").alias("text_key"), F.min("size").alias("size"), *first), "shingle_sets")
    same = light.select("sid", F.col("fp").alias("b")).distinct().join(sets.select("sid", F.col("fp").alias("a")), "sid").where("a != b").select("a", "b")
    parts = merged(parts, same)
    shares = similarity / (1 + similarity)  # of the sizes of two sets in all, they have this much in common

    def fits(x: str, y: str) -> Column:
        n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
        left = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))  # more they cannot share if this is the first shingle they do
        return (F.least(n, m) >= similarity * F.greatest(n, m) - EPSILON) & (left >= shares * (n + m) - EPSILON)

    def near(x: str, y: str) -> Column:
        bits = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCHES[1:]), F.bit_count(F.col(f"{x}.{SKETCHES[0]}").bitwiseXOR(F.col(f"{y}.{SKETCHES[0]}"))))
        return bits <= (1 - 2 * shares) * (F.col(f"{x}.size") + F.col(f"{y}.size")) + EPSILON

    def pairs_of(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
        both = x.alias("x").join(y.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & on & fits("x", "y"))
        return both.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()

    def untried(pairs: DataFrame) -> DataFrame:
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        return pairs

    def labelled(rows: DataFrame) -> DataFrame:
        """Written, so that joins by shingle are of plain exchanges and can be split at hot ones."""
        return written(rows.select("gram", "sid", "size", "pos", "fp").join(parts, "fp"), "postings")

    tried: list[DataFrame] = []
    sketch = sets.select("sid", "size", *SKETCHES)
    each = labelled(shared_postings(light).join(sets.select("sid", "fp"), "sid"))
    for r in range(ROUNDS):
        # First the same set leads wherever it is; later another at each shingle.
        rank = F.xxhash64("sid") if r == 0 else F.xxhash64("sid", "gram", F.lit(r))
        leaders = each.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("sid", "size", "pos", "label"), rank).alias("y"))
        leaders = written(leaders.where("low != high").select("gram", "y.*"), "leaders")
        pairs = untried(pairs_of(each, leaders, F.lit(True)))
        x, y = sketch.alias("x"), sketch.alias("y")
        likely = pairs.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid")).where(near("x", "y")).select("a", "b")
        tried.append(written(likely, "candidates"))
        parts = merged(parts, _similar(docs, sets, tried[-1], shingle=shingle, similarity=similarity))
        each = labelled(each.join(leaders, "gram", "left_semi"))
    counts = each.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n"))
    main = written(counts.groupBy("gram").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("gram", "main"), "main")
    # Of two sets with different labels one at least has not the label that is most common at their shingle.
    full = written(each.join(main, "gram").drop("fp").join(sketch.drop("size"), "sid"), "sketched")
    fewer = full.where("label != main")
    rest = pairs_of(fewer, full, near("x", "y") & ((F.col("y.label") == F.col("x.main")) | (F.col("x.sid") < F.col("y.sid"))))
    last = written(untried(rest), "candidates")
    return merged(parts, _similar(docs, sets, last, shingle=shingle, similarity=similarity))


def simhash_groups(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float | None = None, max_shard: int = MAX_SHARD) -> DataFrame:
    """Near-duplicate groups of `docs` (doc_id, text, ...).

    Returns one row per row: doc_id, fp (the fingerprint as a signed long),
    component_id (the smallest doc_id of the group, itself included). Fingerprints that
    differ in `radius` bits or fewer are linked, and with `similarity` those of all
    texts that have this share of shingles in common; a group is what links connect. Texts without words have
    fingerprint zero, null ones too. A group of rows with null doc_id only has null
    as component_id. Rows with equal fingerprints are one node from the start, so
    a hot group of copies is one node. Other columns are ignored; no rows: no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    if similarity is None:
        light = written(rows.mapInArrow(lean(_fingerprints(shingle)), "doc_id long, fp long"), "fingerprints", light=True)
    else:
        made = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(lean(_prefixes(shingle, similarity, *common_shingles(docs, shingle))), PREFIXES)
        light = written(made, "fingerprints")
    distinct = written(light.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct", rows=light.count())
    n = distinct.count()
    linked = connected_components(close_links(distinct, radius=radius, max_shard=max_shard)).select(F.col("node").alias("fp"), "label")
    parts = written(distinct.select("fp").join(linked, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "parts", rows=n)
    if similarity is not None:
        parts = similar_parts(docs, light, parts, shingle=shingle, similarity=similarity)
    labelled = distinct.join(parts, "fp")
    # Both written, so that the join is of plain exchanges and a giant component can be split.
    labelled = written(labelled, "labelled", rows=n)
    least = written(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "least", rows=n)
    node = labelled.join(least, "label").select("fp", "component_id")
    return light.join(node, "fp").select("doc_id", "fp", "component_id")


def near_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one document of each near-duplicate group: the one with the smallest doc_id.

    Groups are those of simhash_groups(), by default with further links between texts
    that share four fifths of their shingles. Returns the columns of `docs`. Documents are told apart by doc_id: rows that
    share a doc_id stay or go together; if some of them would stay, all do. A row
    with null doc_id stays. A map of bounded size lets most rows pass without a
    shuffle; only those it may hold are compared with the dropped ids.
    """
    groups = simhash_groups(docs, **{"similarity": SIMILARITY} | options).where("doc_id is not null")
    fate = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    dropped = written(fate.where("not stays").select(F.col("doc_id").alias("drop_id"), F.xxhash64("doc_id").alias("drop_key")), "dropped")
    rows = docs.select(F.struct(*docs.columns).alias("near_row"), F.col("doc_id").cast("long").alias("near_id")).withColumn("near_key", F.xxhash64("near_id"))
    marked = maybe_in(rows, "near_key", key_map(dropped, "drop_key", dropped.count()), "near_maybe")
    asked = marked.where("near_maybe").join(dropped, F.col("near_id") == F.col("drop_id"), "left_anti")
    return marked.where("not near_maybe").select("near_row.*").union(asked.select("near_row.*"))
