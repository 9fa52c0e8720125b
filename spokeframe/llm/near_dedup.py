"""Near duplicates: fast similarity sketching, banding, and verification on full sets.

A document is the set of its word shingles. A sketch has one value per bin. In round i
of the first ``bins`` rounds every shingle falls into a random bin and leaves a value
above i; the smallest value stays, so a bin filled in one round is settled by it, and a
round only has to serve the documents with empty bins. In the rounds after that bin by
bin gets the smallest value of all shingles: every coordinate fills. Agreement of two
sketches is concentrated about the sets' similarity like that of independent draws.

Documents with the same set are one class. Classes that share a band of coordinates
are candidates. First each class is compared with one other member of each of its
buckets, and what is linked becomes a component. Where a bucket still holds several
components, all its pairs of different components are compared, in blocks, once per
pair, on full sets. So no link between classes that share a band is lost, however large
the bucket, and no pair is emitted that is not a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .tables import column, free_name, kept, read_table
from .workers import forget

WORDS = 5
BANDS, ROWS = 24, 4  #: sets of similarity 0.85 share no band with a chance of 2e-8, of 0.8 with 3e-6
BLOCK = 256  #: members of a bucket that are compared with each other at once
REMEMBERED = 500_000  #: words whose hash a worker remembers
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _seed(i: int) -> np.uint64:
    return np.uint64(i * int(_ODD) % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """64-bit hashes of the distinct shingles of a text, sorted."""

    def __init__(self, words: int):
        self.words, self.memo = words, {}

    def of(self, text: str) -> np.ndarray:
        found = text.encode().lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D part
        memo = self.memo
        if len(memo) > REMEMBERED:
            memo.clear()
        for word in found:
            if word not in memo:
                memo[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        hashes = np.array([memo[w] for w in found], np.uint64)
        if not len(hashes):
            return hashes
        n = min(self.words, len(hashes))
        total = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            total = _mix(total * _ODD + hashes[k : k + len(total)])
        return np.unique(total)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` values per set, all filled; sets must not be empty."""
    out = np.full(len(sets) * bins, np.iinfo(np.uint64).max, np.uint64)
    if not sets:
        return out.reshape(0, bins)
    filled = np.zeros(len(out), bool)
    elements = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(bins):
        empty = ~filled.reshape(-1, bins).all(axis=1)
        if not empty.any():
            break
        stay = empty[owner]
        elements, owner = elements[stay], owner[stay]
        value = _mix(elements + _seed(i + 1))
        place = owner * bins + (((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        # The low half orders the shingles of a bin; the round tells where a value comes from.
        value = (_mix(value) & np.uint64(0xFFFFFFFFFFFF)) | (np.uint64(i & 0xFFFF) << np.uint64(48))
        new = ~filled[place]
        np.minimum.at(out, place[new], value[new])
        filled[place[new]] = True
    if not filled.all():
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        flat = np.concatenate(sets)
        for place in np.flatnonzero(~filled).tolist():
            row, b = divmod(place, bins)
            value = _mix(flat[begin[row] : begin[row + 1]] + _seed(bins + b + 1))
            out[place] = value.min()
    return out.reshape(-1, bins)


def _band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for k in range(rows):
        total = _mix(total * _ODD + sketch.reshape(len(sketch), bands, rows)[:, :, k])
    return total.view(np.int64)


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, set_key (128 bits of the whole set) and bands of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingles = Shingles(words)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles.of(t.as_py() or "") for t in batch.column(1)]
                some = [s for s in sets if len(s)]
                hashes = iter(_band_hashes(sketches(some, bands * rows), bands, rows).tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(hashes) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "n_shingles", "set_key", "bands"],
                )

    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    return texts.mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and shingles of the classes in ``wanted`` (node, id, set_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingles = Shingles(words)
        for batch in batches:
            found = []
            for node, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                one = shingles.of(text.as_py() or "")
                if len(one) and _key(one) == key.as_py():  # another text may share the id
                    found.append((node.as_py(), one.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))],
                names=["node", "shingles"],
            )

    texts = docs.select(column(id_col).cast("long").alias("id"), column(text_col).alias("text"))
    return (
        texts.join(wanted, texts.id.eqNullSafe(wanted.wanted_id))
        .select("node", "set_key", "text")
        .mapInArrow(run, "node long, shingles array<long>")
        .dropDuplicates(["node"])
    )


def _block_links(percent: int):
    """Links between different components among the rows of one pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        component = table.column("component").to_numpy()
        side = table.column("side").to_numpy()
        own, other = table.column("block").to_numpy(), table.column("other").to_numpy()
        band = table.column("band_number").to_numpy()
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        _, dense = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(dense.max() + 1 if len(dense) else 1, bool)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        links = []
        for i in np.flatnonzero(side == 0).tolist():
            # Within one block each pair once; across blocks left with right.
            partners = np.flatnonzero((side == 1) & ((own[i] != other[i]) | (node > node[i])))
            partners = partners[component[partners] != component[i]]
            if not len(partners):
                continue
            # Only in the first band that two share.
            shared = bands[partners] == bands[i]
            partners = partners[shared.argmax(axis=1) == band[i]]
            small, large = np.minimum(sizes[partners], sizes[i]), np.maximum(sizes[partners], sizes[i])
            partners = partners[100 * small >= percent * large]
            if not len(partners):
                continue
            mark[dense[begin[i] : begin[i + 1]]] = True
            for j in partners.tolist():
                common = np.count_nonzero(mark[dense[begin[j] : begin[j + 1]]])
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    a, b = root(component[i]), root(component[j])
                    if a != b:
                        links.append((node[i], node[j]))
                        parent[max(a, b)] = min(a, b)
            mark[dense[begin[i] : begin[i + 1]]] = False
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept, first.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A document's set is its
    distinct shingles of ``words`` words, or with fewer words all of them as one. Two are
    linked if 100 * intersection >= percent * union. component_id is the smallest id
    reachable, itself included; kept: the id is that one. Documents without words, or
    NULL, have an empty set, are linked with nothing and are kept. ``first`` is true for
    exactly one row of each component, also where rows or ids are repeated. Ids of NULL
    count as larger than others. An empty table gives no rows; other columns are not read.
    """
    made = signatures(docs, id_col, text_col, words, bands, rows)
    sig = kept(made.withColumn("row", F.monotonically_increasing_id()), "signatures")
    linked = sig.where("set_key IS NOT NULL")
    smallest = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    groups = linked.groupBy("set_key").agg(smallest)
    reps = kept(
        groups.select("set_key", F.col("best.row").alias("node"), F.col("best.id").alias("rep_id")), "classes"
    )
    rep_rows = linked.join(reps.select(F.col("node").alias("row")), "row", "left_semi")
    banded = rep_rows.select(F.col("row").alias("node"), F.posexplode("bands").alias("band_number", "band"))
    # Another leader for each band, so that one odd member does not lead everywhere.
    leader = F.min(F.struct(F.xxhash64("node", "band_number").alias("draw"), "node"))["node"]
    buckets = kept(
        banded.groupBy("band_number", "band").agg(leader.alias("leader"), F.min("node").alias("lowest"), F.count("*").alias("n")).where("n > 1"),
        "buckets",
    )
    members = kept(
        banded.join(buckets.select("band_number", "band", "leader", "lowest"), ["band_number", "band"]), "members"
    )
    in_buckets = members.select("node").distinct()
    wanted = reps.join(in_buckets, "node", "left_semi").select("node", "set_key", F.col("rep_id").alias("wanted_id"))
    sets = kept(_full_sets(docs, wanted, id_col, text_col, words), "sets")

    pairs = members.select("node", F.explode(F.array("leader", "lowest")).alias("leader")).where("node <> leader").distinct()
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")).join(a, "a").join(b, "b")
    sized = both.select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    first_links = kept(
        sized.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b"),
        "first_links",
    )
    found = components(first_links)

    # Buckets that still hold several components: their members in blocks, all pairs of blocks.
    named = members.join(found, "node", "left").select(
        "band_number", "band", "node", F.coalesce("label", "node").alias("component")
    )
    sizes = named.groupBy("band_number", "band", "component").agg(F.count("*").alias("m"))
    # Stored, so that the join with it is broadcast or split at hot buckets.
    open_ = kept(
        sizes.groupBy("band_number", "band")
        .agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("n"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select("band_number", "band", F.col("most.component").alias("main"), F.col("most.m").alias("m"), "n"),
        "open_buckets",
    )
    # Members of the largest component are settled: compared with the others, not among themselves.
    loose_blocks = F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int")
    settled_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    spread = F.xxhash64("node")
    placed = (
        named.join(open_, ["band_number", "band"])
        .withColumn("settled", F.col("component") == F.col("main"))
        .withColumn("loose_blocks", loose_blocks)
        .withColumn("settled_blocks", settled_blocks)
        .withColumn(
            "block",
            F.when(F.col("settled"), F.col("loose_blocks") + F.pmod(spread, F.col("settled_blocks").cast("long"))).otherwise(
                F.pmod(spread, F.col("loose_blocks").cast("long"))
            ),
        )
    )
    # Block pairs (left, right): left is loose, right is any block from left on.
    last = (F.col("loose_blocks") + F.col("settled_blocks") - 1).cast("long")
    as_left = F.when(~F.col("settled"), F.sequence(F.col("block"), last))
    as_right = F.sequence(F.lit(0).cast("long"), F.least("block", F.col("loose_blocks").cast("long") - 1))
    rows_left = placed.select("*", F.explode(as_left).alias("other")).withColumn("left", F.col("block")).withColumn(
        "right", F.col("other")
    ).withColumn("side", F.lit(0))
    rows_right = placed.select("*", F.explode(as_right).alias("other")).withColumn("left", F.col("other")).withColumn(
        "right", F.col("block")
    ).withColumn("side", F.lit(1))
    of_band = rep_rows.select(F.col("row").alias("node"), "bands")
    dealt = (
        rows_left.unionByName(rows_right)
        .join(sets, "node")
        .join(of_band, "node")
        .select("band_number", "band", "left", "right", "node", "component", "block", "other", "side", "bands", "shingles")
    )
    more_links = kept(
        dealt.groupBy("band_number", "band", "left", "right").applyInArrow(_block_links(percent), "a long, b long"),
        "more_links",
    )
    final = components(first_links.unionByName(more_links))

    by_class = reps.join(final, "node", "left").select(
        "set_key", "rep_id", "node", F.coalesce("label", "node").alias("label")
    )
    best = F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "node")).alias("best")
    of_label = by_class.groupBy("label").agg(best)
    classes_ = by_class.join(of_label, "label").select(
        "set_key", F.col("best.rep_id").alias("component"), F.col("best.node").alias("first_row")
    )
    return sig.join(classes_, "set_key", "left").select(
        "id",
        "n_shingles",
        F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("set_key").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("component"))).alias("kept"),
        F.when(F.col("set_key").isNull(), True).otherwise(F.col("row") == F.col("first_row")).alias("first"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    row = free_name(docs, "row_number")
    numbered = kept(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = classes(numbered, row, text_col, percent=percent)
    # By row number: the smallest of a component is its first row, whatever the ids are.
    order = F.min(F.struct(column(id_col).isNull().alias("no_id"), column(id_col).alias("id"), column(row).alias("row")))
    of_row = found.select(F.col("id").alias(row), F.col("component_id").alias("component__"))
    ids = numbered.select(column(id_col), column(row)).join(of_row, row)
    stays = ids.groupBy("component__").agg(order.alias("best")).select(F.col("best.row").alias(row))
    return numbered.join(stays, row, "left_semi").select([column(c) for c in docs.columns])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies, linked from similarity 0.85 on."""
    found = classes(read_table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
