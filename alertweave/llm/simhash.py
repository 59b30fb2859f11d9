"""SimHash near-duplicates: fingerprints by majority vote, linked through forests of vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle
from alertweave.operators.components import connected_components

WORDS = 4
SEED = 42
RADIUS = 4
#: The 64 bits are cut into blocks; RADIUS = 4 differing bits leave a block with at most 1.
BLOCKS = ((0, 22), (22, 21), (43, 21))
SAMPLE = 16_384
LEAF = 1_024
CELL = 8_192
SHINGLES_AT_ONCE = 1 << 16
#: The pipeline's stage: word shingles, and the similarity (5 * common >= 4 * all) from which texts are near-duplicates.
STAGE_WORDS = 5
SIMILAR = (4, 5)
#: Shingles in about 64 documents and more come last in the order of shingles; one document in 16 is looked at for them.
HOT_SAMPLE = 16
HOT_SEEN = 4
HOT_BITS = 24
#: A text that is in more pairs than this is copied for every so many of them, and pairs of shingle groups are looked at by this many
#: centres at first, then by GROWTH times as many each turn.
PAIRS_A_COPY = 1_000
GROWTH = 4


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The digests of all shingles of one whole text, one row of 8 bytes each; no rows for null and wordless texts."""
    # On bytes, lower() turns A-Z only and split() cuts at \x20 and \x09-\x0D only.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(found))
    first, last = starts[: len(found) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_digest
    hashes = []
    for at in range(0, len(first), SHINGLES_AT_ONCE):
        a, b = first[at : at + SHINGLES_AT_ONCE].tolist(), last[at : at + SHINGLES_AT_ONCE].tolist()
        hashes.append(b"".join([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)]))
    return np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint that the digests vote for; 0 without any."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        votes += np.unpackbits(hashes[at : at + SHINGLES_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one whole text; 0 for null and wordless texts."""
    return majority(shingles(text, words))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct digests as ascending signed longs."""
    return np.unique(hashes.reshape(-1).view(np.int64))


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. One row per row of `documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    settle(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree over one block of bits, as arrays: node k has a vantage, a bound and two children; children below 0 are leaves."""

    shift: int
    mask: int
    vantage: np.ndarray
    bound: np.ndarray
    inner: np.ndarray
    outer: np.ndarray
    leaves: int

    def block(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> np.uint64(self.shift)) & np.uint64(self.mask)

    def route(self, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf whose region meets the ball of radius `reach` around each fingerprint's block.

        Inside holds distances up to the bound. By the triangle inequality nothing within reach lies inside unless the
        distance to the vantage is at most bound + reach, nor outside unless it is above bound - reach.
        """
        block = self.block(fp)
        found = []
        open_ = [(0, np.arange(len(fp)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                found.append((rows, np.full(len(rows), -node - 1, np.int32)))
            elif len(rows):
                distance = np.bitwise_count(block[rows] ^ self.vantage[node]).astype(np.int64)
                open_.append((int(self.inner[node]), rows[distance <= self.bound[node] + reach]))
                open_.append((int(self.outer[node]), rows[distance > self.bound[node] - reach]))
        return np.concatenate([r for r, _ in found]), np.concatenate([leaf for _, leaf in found])


def plant(sample: np.ndarray, shift: int, bits: int, leaves: int) -> Tree:
    """Split the sample at median distances, breadth first, until there are `leaves` leaves or nothing can be split."""
    tree = Tree(shift, (1 << bits) - 1, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0)
    values = np.unique(tree.block(sample))
    vantage: list[int] = []
    bound: list[int] = []
    children: list[list[int]] = []
    waiting = [(values, -1, 0)]
    done: list[tuple[int, int]] = []
    while waiting:
        part, parent, side = waiting.pop(0)
        split = None
        if len(part) >= 2 and len(waiting) + len(done) + 1 < leaves:
            # Of a few candidates, the vantage that cuts nearest to the middle.
            for pick in part[:: max(1, len(part) // 8)][:8]:
                distance = np.bitwise_count(part ^ pick).astype(np.int64)
                cut_at = int(np.median(distance))
                for at in (cut_at - 1, cut_at):
                    inside = int((distance <= at).sum())
                    if 0 < inside < len(part) and (split is None or abs(2 * inside - len(part)) < split[0]):
                        split = (abs(2 * inside - len(part)), pick, at, distance <= at)
        if split is None:
            done.append((parent, side))
            continue
        node = len(vantage)
        vantage.append(int(split[1]))
        bound.append(split[2])
        children.append([0, 0])
        if parent >= 0:
            children[parent][side] = node
        waiting.append((part[split[3]], node, 0))
        waiting.append((part[~split[3]], node, 1))
    for leaf, (parent, side) in enumerate(done):
        if parent >= 0:
            children[parent][side] = -leaf - 1
    if not vantage:  # a single leaf
        vantage, bound, children = [0], [64], [[-1, -1]]
    pairs = np.array(children, np.int64)
    return Tree(shift, tree.mask, np.array(vantage, np.uint64), np.array(bound, np.int64), pairs[:, 0], pairs[:, 1], max(1, len(done)))


def _forest(classes: DataFrame, rows: int, sample: int, leaf: int) -> list[Tree]:
    """One tree per block, from at most `sample` fingerprints (those with the smallest hashes)."""
    some = classes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    leaves = int(np.clip(rows // leaf, 1, max(1, sample // 8)))
    return [plant(some, shift, bits, leaves) for shift, bits in BLOCKS]


def _connect(members: np.ndarray, asking: np.ndarray, ids: np.ndarray, asking_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever lies within RADIUS, asking x members; at most one for each row."""
    parent = np.arange(len(members) + len(asking))

    def roots(at: np.ndarray) -> np.ndarray:
        at = parent[at]
        while (parent[at] != at).any():
            at = parent[at]
        return at

    step = max(1, (1 << 22) // max(1, len(members)))
    for start in range(0, len(asking), step):
        near = np.bitwise_count(asking[start : start + step, None] ^ members[None, :]) <= RADIUS
        for k in np.flatnonzero(near.any(axis=1)):
            group = np.append(np.flatnonzero(near[k]), len(members) + start + k)
            tops = np.unique(roots(group))
            parent[tops] = tops[0]
            parent[group] = tops[0]
    everyone = np.concatenate([ids, asking_ids])
    top = roots(np.arange(len(parent)))
    linked = everyone != everyone[top]
    return everyone[linked], everyone[top][linked]


def links(classes: DataFrame, sample: int = SAMPLE, leaf: int = LEAF, cell: int = CELL) -> DataFrame:
    """(a, b): links between classes (rep, fp) of different fingerprints that connect all within RADIUS.

    Every fingerprint lies in its home leaf of each tree and asks in the further leaves that the triangle bounds leave. Leaves
    hold what is near each other, so their sizes vary: large ones are dealt into cells of at most about `cell` members and
    `cell` askers, and each asker meets all members of the leaf cell by cell.
    """
    rows = classes.count()
    forest = classes.sparkSession.sparkContext.broadcast(_forest(classes, rows, sample, leaf))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            for number, tree in enumerate(forest.value):
                row, home = tree.route(fp, 0)
                at = np.empty(len(fp), np.int32)
                at[row] = home
                row, place = tree.route(fp, 1)
                # A pair with two homes is found in the later one; in a common home the members ask each other.
                further = place >= at[row]
                row, place = row[further], place[further]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place.astype(np.int64) * len(BLOCKS) + number), pa.array(place == at[row]), pa.array(rep[row]), pa.array(fp[row].view(np.int64))],
                    ["leaf", "home", "rep", "fp"],
                )

    placed = cut(classes.mapInArrow(assign, "leaf long, home boolean, rep long, fp long"))
    # One row a leaf, of which there are at most len(BLOCKS) * sample / 8.
    sizes = placed.groupBy("leaf").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("home") / cell)).cast("int").alias("_m"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (2 * cell))).cast("int").alias("_q")
    )
    dealt = placed.join(F.broadcast(sizes), "leaf")
    column = F.pmod(F.xxhash64("fp"), F.col("_m"))
    line = F.pmod(F.xxhash64(F.col("fp") + 1), F.col("_q"))
    as_member = dealt.where("home").select("leaf", column.cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("q"), F.lit(True).alias("member"), "rep", "fp")
    as_asker = dealt.select("leaf", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("m"), line.cast("int").alias("q"), F.lit(False).alias("member"), "rep", "fp")

    def meet(key: tuple, cells: pa.Table) -> pa.Table:
        member = cells.column("member").to_numpy(zero_copy_only=False).astype(bool)
        rep = cells.column("rep").to_numpy()
        fp = cells.column("fp").to_numpy().view(np.uint64)
        a, b = _connect(fp[member], fp[~member], rep[member], rep[~member])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return as_member.unionByName(as_asker).groupBy("leaf", "m", "q").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `documents` (doc_id, text).

    Words are runs of anything but \\x20 and \\x09-\\x0D, A-Z lower-cased; a shingle is 4 words joined by spaces, or all words
    of a shorter text. Null, empty and wordless texts have fingerprint 0 and link like any other. component_id is the smallest
    doc_id that can be reached through fingerprints differing in at most 4 bits. Rows without doc_id reach nothing themselves
    and get the component of their fingerprint, null if no row with an id has it. Repeated rows get equal answers; an empty
    table gives no rows; other columns are not read.

    Equal fingerprints form one class, represented by its smallest doc_id, so copies cost one row however many they are.
    """
    marked = cut(fingerprints(documents))
    classes = cut(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected_components(links(classes), "a", "b").select(F.col("signal_id").alias("rep"), F.col("component").alias("_least"))
    named = classes.join(groups, "rep", "left").select("fp", F.coalesce("_least", "rep").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp", "left").select("doc_id", digits, "component_id")


def _hot(documents: DataFrame, words: int) -> np.ndarray:
    """A bitmap of 2^HOT_BITS bits over the first bits of the shingles that a sample of the documents shows to be common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(shingles(text.as_py(), words)))], ["shingle"])

    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select("text").distinct()
    often = some.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= HOT_SEEN)
    bit = F.shiftrightunsigned("shingle", 64 - HOT_BITS)
    packed = often.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(shingle, {64 - HOT_BITS}) & 63))")).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (HOT_BITS - 6), np.uint64)
    bitmap[packed.word.to_numpy(np.int64)] = packed.bits.to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)


def sketch(own: np.ndarray) -> bytes:
    """A bitmap of the set's digests, of the power of two of bits that is twice its size or just above."""
    size = max(64, 1 << max(0, 2 * len(own) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(own.view(np.uint64) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def apart(one: bytes, other: bytes) -> int:
    """How many elements of two sets are in one of them only, at least: bits of one bitmap that the other doesn't have."""
    if len(one) > len(other):
        one, other = other, one
    small, large = np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)
    if len(small) < len(large):  # a smaller bitmap is the larger one folded
        large = np.bitwise_or.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(small ^ large).sum())


def _prefixes(documents: DataFrame, words: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, fp, sig, n, sketch, prefix): n distinct shingles of digest sig; prefix are the first of them, hot ones last."""
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            fp, sig, size, bits, prefix = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingles(text.as_py(), words)
                own = shingle_set(hashes)
                late = common[(own.view(np.uint64) >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
                # Two sets as similar as SIMILAR share one of these, whatever the order, if it is the same for all.
                first = len(own) - -(-len(own) * SIMILAR[0] // SIMILAR[1]) + 1 if len(own) else 0
                fp.append(majority(hashes))
                sig.append(int.from_bytes(xxhash.xxh64_digest(own.tobytes(), SEED), "big", signed=True))
                size.append(len(own))
                bits.append(sketch(own))
                prefix.append(np.concatenate([own[~late], own[late]])[:first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(sig, pa.int64()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "fp", "sig", "n", "sketch", "prefix"],
            )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, sig long, n int, sketch binary, prefix array<long>")


def _beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """`pairs` (a, b) with the columns of `table` (id, ...) for either id, named a_... and b_...

    An id of many pairs is dealt out: its row is copied once per PAIRS_A_COPY of them. There are fewer such ids than pairs / PAIRS_A_COPY,
    and only they are counted out to all tasks.
    """
    told = pairs
    for side, other in ("ab", "ba"):
        many = pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("_copies")).where("_copies > 1")
        copies = F.coalesce("_copies", F.lit(1))
        rows = table.join(F.broadcast(many), "id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        named = rows.select(F.col("id").alias(side), "_copy", *[F.col(c).alias(f"{side}_{c}") for c in table.columns if c != "id"])
        dealt = told.join(F.broadcast(many.withColumnRenamed("id", side)), side, "left").withColumn("_copy", F.pmod(F.xxhash64(other), copies).cast("int")).drop("_copies")
        told = dealt.join(named.hint("merge"), [side, "_copy"]).drop("_copy")
    return told


def _confirmed(pairs: DataFrame, facts: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (a, b) of documents whose shingle sets are as similar as SIMILAR.

    Most others are told by the sketches in `facts` (id, n, sketch), which bound what two sets can have in common; the
    texts of the rest are compared.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit = (batch.column("a_n").to_numpy().astype(np.int64) + batch.column("b_n").to_numpy()) * (SIMILAR[1] - SIMILAR[0])
            least = [apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("a_sketch"), batch.column("b_sketch"), strict=True)]
            keep = pa.array(np.array(least, np.int64) * sum(SIMILAR) <= limit)
            yield batch.select(["a", "b"]).filter(keep)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, np.zeros(0, np.int64)
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column("a").to_pylist(), batch.column("a_text"), batch.column("b_text"), strict=True):
                if name != a:
                    name, held = a, shingle_set(shingles(one.as_py(), words))
                own = shingle_set(shingles(two.as_py(), words))
                common = len(np.intersect1d(held, own, assume_unique=True))
                keep.append(SIMILAR[1] * common >= SIMILAR[0] * (len(held) + len(own) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs)
    near = cut(_beside(pairs, facts).mapInArrow(likely, "a long, b long"))
    # Of rows with one id and different texts, any of the least set stands for the id; see `similar_texts`.
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    involved = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = cut(texts.join(involved, "id", "left_semi").distinct())
    told = _beside(near, texts).select("a", "b", "a_text", "b_text")
    return cut(told.sortWithinPartitions("a").mapInArrow(alike, "a long, b long").distinct())


def _meetings(met: DataFrame, first: int, last: int) -> DataFrame:
    """Pairs (a, b) of different groups that meet at a shingle: a is one of its centres number `first` to `last`, b comes after it.

    At a shingle that both name, what follows in either set bounds what they have in common.
    """
    centre = met.where((F.col("rank") >= first) & (F.col("rank") <= last)).select(
        "shingle", *[F.col(c).alias(f"a_{c}") for c in ("rep", "n", "pos", "rank", "group")]
    )
    most = F.least(F.col("n") - F.col("pos"), F.col("a_n") - F.col("a_pos"))
    may = sum(SIMILAR) * most >= SIMILAR[0] * (F.col("n") + F.col("a_n"))
    sized = (SIMILAR[1] * F.col("n") >= SIMILAR[0] * F.col("a_n")) & (SIMILAR[1] * F.col("a_n") >= SIMILAR[0] * F.col("n"))
    later = (F.col("rank") > F.col("a_rank")) & ~F.col("group").eqNullSafe(F.col("a_group"))
    return met.join(centre, "shingle").where(later & sized & may).select(F.col("a_rep").alias("a"), F.col("rep").alias("b")).distinct()


def similar_texts(documents: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """(doc_id, component_id) for every row of `documents` (doc_id, text): texts whose sets of word shingles have Jaccard
    similarity 0.8 and more are linked, directly or through others; component_id as in near_duplicates.

    Texts of equal sets form one class. SimHash links (4 of 64 bits) are candidates; as 0.8 is about 10 bits, the rest comes
    from prefixes: in one order of all shingles, of n each text names the first n - ceil(0.8 n) + 1, and similar texts share a
    named one. Common shingles are last in the order, so few name them. Those who share a named shingle first meet one
    of them, its centre: the one whose named shingles are the most common, which for a group of copies is their original.
    The next centres meet only who is in another group by then, turn after turn, until all have met or are in
    one group. Candidates are told by sketches, then by their whole texts; words, null texts and rows without doc_id are as in
    near_duplicates, and shingles are equal if 64-bit digests are.
    """
    settle(documents.sparkSession)
    marked = cut(_prefixes(documents, words, _hot(documents, words)))
    classes = cut(marked.where("doc_id is not null").groupBy("sig", "n").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")))
    alike = cut(classes.groupBy("fp").agg(F.min("rep").alias("least")))
    near = links(alike.select("fp", F.col("least").alias("rep"))).unionByName(classes.join(alike, "fp").select(F.col("rep").alias("a"), F.col("least").alias("b")))

    firsts = marked.join(classes.select("sig", "n", F.col("rep").alias("doc_id")), ["sig", "n", "doc_id"], "left_semi")
    facts = firsts.select(F.col("doc_id").alias("id"), "n", "sketch").dropDuplicates(["id", "n"])
    named = firsts.select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "shingle")).distinct()
    at_shingle = Window.partitionBy("shingle")
    met = cut(named.withColumn("names", F.count(F.lit(1)).over(at_shingle)).where("names > 1"))
    common = met.groupBy("rep").agg(F.sum(F.log("names")).alias("_sum"))
    ranked = met.join(common, "rep").withColumn(
        "rank", F.row_number().over(at_shingle.orderBy(F.desc(F.col("_sum") / F.col("n")), F.xxhash64("rep"), "rep"))
    )
    met = cut(ranked.select("shingle", "rep", "n", "pos", "rank"))
    alone = met.withColumn("group", F.col("rep"))
    found = _confirmed(near.unionByName(_meetings(alone, 1, 1)), facts, documents, words)
    first = 2
    while True:
        groups = connected_components(found, "a", "b", keep=lambda df: df).select(F.col("signal_id").alias("rep"), F.col("component").alias("group"))
        placed = met.join(groups, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
        # Shingles whose texts are not in one group yet, and have not all been centres.
        unlike = placed.groupBy("shingle").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi"), F.max("rank").alias("_last"))
        open_ = unlike.where(f"_lo < _hi and _last > {first}").select("shingle")
        met = cut(placed.join(open_, "shingle", "left_semi").drop("group"))
        if met.isEmpty():
            break
        placed = met.join(groups, "rep", "left").withColumn("group", F.coalesce("group", "rep"))
        last = GROWTH * first
        # What was found before goes on as stars: a row per text, already contracted.
        stars = groups.where("rep <> group").select(F.col("rep").alias("a"), F.col("group").alias("b"))
        found = stars.unionByName(_confirmed(_meetings(placed, first, last), facts, documents, words))
        first = last + 1
    least = classes.join(groups, "rep", "left").select("sig", "n", F.coalesce("group", "rep").alias("component_id"))
    return marked.select("doc_id", "sig", "n").join(least, ["sig", "n"], "left").select("doc_id", "component_id")


def keep_representatives(documents: DataFrame) -> DataFrame:
    """The rows of `documents` with one document of each group of similar_texts, all columns kept.

    It is the one with the smallest doc_id; of repeated rows with this id the one with the smallest text stays. Rows without doc_id stay.
    """
    first = similar_texts(documents).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    # A row as one value, so that its columns may have any names.
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), "text", whole)
    found = rows.join(first, "id", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("text")))
    kept = found.where("nth = 1").select("row").unionByName(rows.where("id is null").select("row"))
    return kept.select("row.*")


def brute_force(rows: list[tuple[int, str | None]]) -> pd.DataFrame:
    """near_duplicates by comparing all fingerprints, for tests on small tables."""
    fp = np.array([fingerprint(t) for _, t in rows], np.int64).view(np.uint64)
    least = np.array([d for d, _ in rows])
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= RADIUS
    while True:
        lower = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (lower == least).all():
            break
        least = lower
    return pd.DataFrame({"doc_id": [d for d, _ in rows], "fingerprint": [f"{int(x):016x}" for x in fp], "component_id": least})
