"""SimHash near-duplicate detection over a grid of segment bit counts.

A text's fingerprint has a bit set where over half of its shingles' 64-bit
hashes have it set.  Fingerprints link at a Hamming distance of 2 or less.

Segment-popcount embedding: the 64 bits are cut into 32 segments of two bits,
and a fingerprint is mapped to its 32 counts of set bits.  A differing bit
changes one count by one at most, so the Manhattan distance of two embeddings
is a lower bound of their Hamming distance.  Counts are kept in unary (00, 01,
11), which makes that distance a population count as well.

Grid range-join: the coordinates are dealt to six blocks.  Two points within
Manhattan distance 2 differ in two blocks at most, so they share one of the 15
cells that four blocks span.  Every distinct fingerprint is put into its 15
cells; pairs of a cell are cut by the lower bound and then verified exactly.

A cell with more than ``DENSE`` fingerprints (one large group of near copies)
would give a quadratic number of pairs.  Its fingerprints are linked exactly by
centres instead: two fingerprints within distance 2 both lie within distance 1
of a common centre, and all around one centre are within 2 of each other, so a
star from the smallest to the others keeps every component, with 65 rows a
fingerprint.  No pair is lost: both ends of a pair that meets only in dense
cells are members of dense cells.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesets
from .groups import components
from .shared import discard, keep, located, table, tidy, without

#: Segments (of two bits) in each of the six coordinate blocks.
BLOCKS = (6, 6, 5, 5, 5, 5)
#: Largest number of fingerprints of a cell that are compared pair by pair.
DENSE = 48


def majority(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The fingerprint of each row from the hashes of its shingles; ``row`` ascends; no shingle gives zero."""
    out = np.zeros(rows, np.uint64)
    if len(hashes):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        n = np.diff(np.append(first, len(row)))
        for bit in range(64):
            on = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
            out[row[first]] |= (on * 2 > n).astype(np.uint64) << np.uint64(bit)
    return out


def prints(column: pa.Array, words: int) -> np.ndarray:
    data, offsets = bytesets.raw(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b, row, h in bytesets.shingle_hashes(data, offsets, words):
        out[a:b] = majority(h, row, b - a)
    return out


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and fp (a signed long with the 64 bits) of each row; null and wordless texts have fp 0."""
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints(batch.column(1), words).view(np.int64))], names=["id", "fp"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cell_masks(blocks: tuple[int, ...] = BLOCKS, apart: int = 2) -> list[int]:
    """The bits of the embedding that each cell kind fixes: all blocks but ``apart``."""
    spans, at = [], 0
    for size in blocks:
        spans.append(((1 << (2 * size)) - 1) << (2 * at))
        at += size
    return [_signed(sum(c)) for c in combinations(spans, len(blocks) - apart)]


def embedding(fp):
    """Unary bit counts of the 32 segments: the lower bit of a pair is set from one, the upper at two."""
    low, even = F.shiftright(fp, 1), F.lit(0x5555555555555555)
    one = fp.bitwiseOR(low).bitwiseAND(even)
    two = fp.bitwiseAND(low).bitwiseAND(even)
    return one.bitwiseOR(F.shiftleft(two, 1))


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that keep all components at distance 2.

    Pairs that meet in a sparse cell are all returned; within dense cells, stars.
    """
    cells = fps.select("fp", embedding(F.col("fp")).alias("point"))
    cells = cells.select("fp", "point", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col("point").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(cell_masks())])).alias("at")).select("fp", "point", "at.kind", "at.cell")
    sizes = cells.groupBy("kind", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = keep(cells.join(sizes, ["kind", "cell"]), "simhash-cells")
    near = shared.where(F.col("n") <= dense)
    left, right = near.alias("l"), near.alias("r")
    meet = (F.col("l.kind") == F.col("r.kind")) & (F.col("l.cell") == F.col("r.cell")) & (F.col("l.fp") < F.col("r.fp"))
    bound = F.bit_count(F.col("l.point").bitwiseXOR(F.col("r.point"))) <= 2
    exact = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= 2
    pairs = left.join(right, meet & bound & exact).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    thick = shared.where(F.col("n") > dense).select("fp").distinct()
    around = thick.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("centre"))
    heads = around.groupBy("centre").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(heads, "centre").where("fp != head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    found = keep(pairs.unionByName(stars).distinct(), "simhash-links")
    discard(shared)
    return found


def near_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, dense: int = DENSE) -> DataFrame:
    """id, fp and component_id (the smallest id reachable over links) of each row.

    Null, empty and wordless texts have fingerprint zero and link like others.
    Equal texts have equal fingerprints, hence one component.  A null id is
    never a component's id unless its component has no other.  Repeated rows
    come back as often as they came; other columns do not matter.  An empty
    table gives an empty table.
    """
    rows = keep(fingerprints(df, id_col=id_col, text_col=text_col, words=words), "simhash-prints")
    lowest = rows.groupBy("fp").agg(F.min("id").alias("low"))
    joined = components(links(lowest.select("fp"), dense), "simhash-components")
    roots = lowest.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near copies by similarity ---------------------------------------------

#: Sampled fingerprints a text, and shingles in each of them.
TABLES, SAMPLE = 12, 4
#: Heads that a shared rare shingle has in the first round; four times as many in each later one.
HEADS = 32
#: Words of 64 bits in the parity bits of a set of shingles.
PARITY = 8


def sampled(column: pa.Array, words: int, tables: int, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole fingerprints, rows x tables of fingerprints of samples (zero: the table has no
    shingle), and numbers of distinct shingles.

    The distinct shingles of a text are dealt to the tables by their hashes; a
    table's fingerprint is the SimHash of its ``sample`` least ones.  Texts of
    Jaccard similarity J agree in a table with a chance of about J ** sample.
    """
    data, offsets = bytesets.raw(column)
    whole, parts, sizes = np.zeros(len(column), np.uint64), np.zeros((len(column), tables), np.uint64), np.zeros(len(column), np.int64)
    for a, b, row, h in bytesets.shingle_hashes(data, offsets, words):
        whole[a:b] = majority(h, row, b - a)
        cell = row * tables + ((h >> np.uint64(40)) % np.uint64(tables)).astype(np.int64)
        order = np.lexsort((h, cell))
        cell, h = cell[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (h[1:] != h[:-1])
        cell, h = cell[new], h[new]
        sizes[a:b] = np.bincount(cell // tables, minlength=b - a)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        rank = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        least = rank < sample
        parts[a:b] = majority(h[least], cell[least], (b - a) * tables).reshape(b - a, tables)
    return whole, parts, sizes


def shingle_sets(column: pa.Array, words: int) -> pa.Array:
    """The distinct shingle hashes of each text."""
    data, offsets = bytesets.raw(column)
    values, sizes = [], np.zeros(len(column), np.int64)
    for a, b, row, h in bytesets.shingle_hashes(data, offsets, words):
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        values.append(h[new])
        sizes[a:b] = np.bincount(row[new], minlength=b - a)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat.view(np.int64)))


def parities(sets: pa.Array) -> list[np.ndarray]:
    """``PARITY`` columns of 64 bits: is the number of a set's hashes that fall on a bit odd?

    The bits in which two sets differ are at most the hashes that only one of them has.
    """
    sizes = np.diff(sets.offsets.to_numpy())
    h, out = sets.values.to_numpy().view(np.uint64), np.zeros((len(sizes), PARITY), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(sizes), 256):
        a, b = np.searchsorted(row, (at, at + 256))
        place = (row[a:b] - at) * (64 * PARITY) + ((h[a:b] >> np.uint64(20)) % np.uint64(64 * PARITY)).astype(np.int64)
        odd = np.bincount(place, minlength=min(256, len(sizes) - at) * 64 * PARITY) & 1
        out[at : at + 256] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, PARITY)
    return list(out.T)


def possible(similarity: float):
    """A condition that all pairs of that similarity meet, from sizes and parity bits (columns n, s0.. and hn, h0..)."""
    differ = sum(F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"h{i}"))) for i in range(PARITY))
    sized = F.least("n", "hn") >= F.lit(similarity) * F.greatest("n", "hn") - 1e-6
    return sized & (differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n") + F.col("hn")) + 1e-6)


def prefixes(content: DataFrame, similarity: float) -> DataFrame:
    """uid, token, first: the rarest shingles (a written table) of each text (of ``content``: uid, n, shingles), shared ones only.

    All shingles have one order, rare ones first.  Of two sets of Jaccard
    similarity s, the larger has one of its first n - ceil(s * n) + 1 shingles
    among the first n - ceil(2 * s / (1 + s) * n) + 1 of the smaller (n is each
    one's own size); ``first`` marks the latter.  Empty sets share token 0.
    """
    each = keep(content.select("uid", "n", F.explode_outer("shingles").alias("token")).select("uid", "n", F.coalesce("token", F.lit(0)).alias("token")), "near-tokens")
    often = each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "token")))  # shingles of one text
    ranked = each.join(often, "token", "left").groupBy("uid", "n").agg(order.alias("order"))
    reach = lambda share: (F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-6) + 1).cast("int")
    near = F.slice("order", F.lit(1), F.least(reach(similarity), F.size("order")))
    found = ranked.select("uid", "n", F.posexplode(near).alias("at", "o"), reach(2 * similarity / (1 + similarity)).alias("reach"))
    found = keep(found.where("o.c > 1").select("uid", "o.token", (F.col("at") < F.col("reach")).alias("first")), "near-prefixes")
    discard(each)
    return found


def verified(pairs: DataFrame, content: DataFrame, similarity: float) -> DataFrame:
    """The pairs (uid, head) whose shingle sets are as similar as that; a written table."""
    a, b = content.select(F.col("uid").alias("head"), F.col("shingles").alias("mine")), content.select("uid", "shingles")
    asked = keep(pairs.distinct(), "near-pairs")
    both = asked.join(b, "uid").join(a, "head")
    common = F.size(F.array_intersect("mine", "shingles"))
    alike = F.when(F.size("mine") + F.size("shingles") == 0, 1.0).otherwise(common / (F.size("mine") + F.size("shingles") - common))
    found = keep(both.where(alike >= similarity).select("uid", "head"), "near-found")
    discard(asked)
    return found


def near_links(rows: DataFrame, content_of, tables: int, similarity: float) -> DataFrame | None:
    """uid, root of all texts that are in a group; ``rows``: uid, fp, keys, n; ``content_of``: shingle sets by uids."""
    joined = components(links(rows.select("fp").distinct()), "near-components")
    # sizes of sets as alike as ``similarity`` are in one band or in neighbouring bands
    band = F.floor(F.log(F.col("n") + 1.0) / F.lit(-np.log(similarity))).cast("int") if 0 < similarity < 1 else F.lit(0)
    # ``next``: a row in the bucket of the band above its own; two such rows meet in their own band's bucket
    sized = rows.withColumn("next", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("next"))
    whole = sized.join(joined, sized["fp"] == joined["node"], "left").select("uid", "n", "next", F.lit(tables).alias("t"), F.xxhash64("band", F.lit(tables), F.coalesce("root", "fp")).alias("bucket"))
    part = sized.select("uid", "n", "next", "band", F.posexplode("keys").alias("t", "key")).where("key != 0").select("uid", "n", "next", "t", F.xxhash64("band", "t", "key").alias("bucket"))
    member = part.unionByName(whole)
    shared = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    member = keep(member.join(shared, "bucket"), "near-buckets")
    discard(joined)
    tidy(rows.sparkSession)
    content = content_of(member.select("uid").distinct())
    bits = [f"s{i}" for i in range(PARITY)]
    signs = content.select("uid", "n", *bits)
    other = [F.col(f"best.s{i}").alias(f"h{i}") for i in range(PARITY)]

    # one head a bucket: the member with the most bucket mates, the same one in all buckets of a large group
    ties = member.groupBy("uid").agg(F.sum("m").alias("ties"))
    brief = rows.select("uid", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("brief"))
    placed = member.drop("n").join(ties, "uid").join(brief, "uid").join(signs, "uid").select("uid", "n", "next", "t", "bucket", "brief", *bits, F.struct((-F.col("ties")).alias("less"), "uid").alias("place"))
    heads = placed.groupBy("bucket").agg(F.min(F.struct("place", "n", "next", "brief", *bits)).alias("best"))
    heads = keep(heads.select("bucket", F.col("best.place.uid").alias("head"), F.col("best.n").alias("hn"), F.col("best.next").alias("hnext"), F.col("best.brief").alias("hbrief"), *other), "near-heads")
    close = possible(similarity) & (F.col("next") + F.col("hnext") < 2)
    # most pairs meet in several tables; one that is left out here by a chance likeness stays in an open bucket
    seen = F.exists(F.zip_with(F.slice("brief", 1, F.col("t")), F.slice("hbrief", 1, F.col("t")), lambda x, y: (x == y) & (x != 0)), lambda z: z)
    linked = verified(placed.join(heads, "bucket").where((F.col("uid") != F.col("head")) & close & ~seen).select("uid", "head"), content, similarity)

    discard(heads)

    def groups() -> DataFrame:
        found = components(linked.select(F.col("uid").alias("a"), F.col("head").alias("b")), "near-groups")
        named = found.select(F.col("node").alias("uid"), "root")
        named._stored_at = found._stored_at
        return named

    # all texts of buckets that hold more than one group so far meet again by their rarest shingles
    named = groups()
    labelled = member.select("uid", "bucket").join(named, "uid", "left").withColumn("label", F.coalesce("root", "uid"))
    open_ = F.min("label") < F.max("label")
    mixed = labelled.groupBy("bucket").agg(open_.alias("open")).where("open").select("bucket")
    wanted = labelled.join(mixed, "bucket", "left_semi").select("uid").distinct()
    free = prefixes(content.join(wanted, "uid", "left_semi"), similarity)
    discard(member)
    tidy(rows.sparkSession)
    turn = 0
    while True:
        now = free.join(named, "uid", "left").withColumn("label", F.coalesce("root", "uid"))
        # a shingle is done when all its texts are in one group or none is left to be a head
        left = now.groupBy("token").agg(F.count_if("first").alias("heads"), open_.alias("open")).where("open AND heads > 0").select("token", "heads")
        now = keep(now.join(left, "token").select("token", "uid", "first", "label", "heads"), "near-open")
        discard(free)
        if now.isEmpty():
            discard(content, now)
            return None if linked.isEmpty() else named
        full = now.join(signs, "uid")
        many = HEADS << min(2 * turn, 24)
        salt = F.when(F.col("heads") <= many, F.col("uid")).otherwise(F.pmod(F.xxhash64("uid"), F.lit(many)))
        heads = full.where("first").groupBy("token", salt.alias("salt")).agg(F.min(F.struct("uid", "n", "label", *bits)).alias("best"))
        heads = keep(heads.select("token", F.col("best.uid").alias("head"), F.col("best.n").alias("hn"), F.col("best.label").alias("hlabel"), *other), "near-heads")
        larger = (F.col("hn") < F.col("n")) | ((F.col("hn") == F.col("n")) & (F.col("head") < F.col("uid")))
        pairs = full.join(heads, "token").where(larger & (F.col("label") != F.col("hlabel")) & possible(similarity)).select("uid", "head")
        found = verified(pairs, content, similarity)
        linked = linked.unionByName(found)
        discard(named)
        named = groups()
        # a head has been compared with all larger texts; as a larger one it stays
        was = heads.select("token", F.col("head").alias("uid"), F.lit(True).alias("was"))
        free = keep(now.join(was, ["token", "uid"], "left").select("token", "uid", (F.col("first") & F.col("was").isNull()).alias("first")), "near-free")
        discard(now, heads)
        tidy(rows.sparkSession)
        turn += 1


def near_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, tables: int = TABLES, sample: int = SAMPLE) -> DataFrame:
    """id, locator, group_id and kept of the rows that are in a group of near copies.

    A link joins two texts whose sets of shingles have a Jaccard similarity of at
    least ``similarity``; a group is a connected component of links.

    Candidates share a bucket: a sampled fingerprint, or a component of whole
    fingerprints linked over the grid, among texts of similar size.  First the
    best connected member of each bucket is compared with all others, shingle
    set by shingle set, which takes the large groups by a star.  The texts of
    buckets that still hold several groups then meet by their rarest shingles,
    so chosen that any two texts of that similarity share one; again by heads:
    the smaller texts of a shingle (32 in the first round, then four times as many
    in each) are compared with its larger ones that are not in their group, until
    all texts of it are in one group or all were heads.  Sizes and parity bits of
    the sets rule out most pairs that are no links before any is made.  No link
    between two texts that share a bucket is lost, however wide it is.

    Recall: two texts of similarity 0.8 share a bucket with a chance of 0.998.
    Null, empty and wordless texts are alike (equal empty sets) and form one
    group.  group_id is the smallest id of the group, null if all are null; one
    row of the group is kept: that of the smallest id, of several of them (or of
    null ids only) the first by locator.  Texts may be of any length.  Other
    columns do not matter.
    """
    one = located(df, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = one.schema["id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            whole, parts, sizes = sampled(batch.column(1), words, tables, sample)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, tables, dtype=np.int32)), pa.array(parts.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(whole.view(np.int64)), flat, pa.array(sizes.astype(np.int32))], names=["id", "locator", "fp", "keys", "n"])
        bytesets.trim()

    def sets(batches):
        for batch in batches:
            found = shingle_sets(batch.column(2), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, parities(found)), found], names=["uid", "n", *[f"s{i}" for i in range(PARITY)], "shingles"])
        bytesets.trim()

    def content_of(uids: DataFrame) -> DataFrame:
        wanted = uids.join(rows.select("uid", "n", "locator"), "uid")
        return keep(one.join(wanted, "locator").select("uid", "n", "text").mapInArrow(sets, f"uid long, n int, {', '.join(f's{i} long' for i in range(PARITY))}, shingles array<long>"), "near-sets")

    rows = one.mapInArrow(sketch, f"id {ids}, locator string, fp long, keys array<long>, n int")
    rows = keep(rows.withColumn("uid", F.monotonically_increasing_id()), "near-sketches")
    groups = near_links(rows, content_of, tables, similarity)
    if groups is None:
        return df.sparkSession.createDataFrame([], f"id {ids}, locator string, group_id {ids}, kept boolean")
    named = groups.join(rows.select("uid", "id", "locator"), "uid")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "locator")).alias("best"))
    result = keep(named.join(best, "root").select("id", "locator", F.col("best.id").alias("group_id"), (F.col("locator") == F.col("best.locator")).alias("kept")), "near-result")
    discard(rows, groups)
    return result


def distinct_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near copies: of each group the row of the smallest id stays, columns as they are."""
    return without(df, lambda rows: near_copies(rows, id_col=id_col, text_col=text_col, **options).where("NOT kept").select("locator"))
