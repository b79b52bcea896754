"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigraph.llm.common import connected_components, materialize, slices
from lumigraph.llm.words import distinct_shingles, mix64

# Bands of ROWS minima: two sets of similarity s share one with probability 1 - (1 - s**ROWS)**BANDS, that is
# 1 - 3e-6 at 0.8 and 1 - 2e-9 at 0.85. Unrelated sets (0.05) share one with probability 7e-7.
BANDS, ROWS = 42, 6
MINIMA = 256
BITS = 2
WORDS = MINIMA * BITS // 64
# The estimate's standard deviation is 0.03 at 0.8; a pair must fall short by six of them to be passed over unread.
SLACK = 0.18
# Up to so many members of a bucket that its pivot doesn't link with meet directly.
CROWD = 32
# Bytes of texts whose sets a task holds at once.
SLICE = 2 << 20
_TEXTS = 5_000  # texts that a task reads on average at least, where there are so many
_A = (np.random.RandomState(1).randint(0, 1 << 31, MINIMA).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = np.random.RandomState(2).randint(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)


def minima(elements: np.ndarray, step: int = 512) -> np.ndarray:
    """The least value of each of MINIMA hash functions over a set; memory stays the same however large it is."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), step):
        part = x[i : i + step]
        np.minimum(low, (part[:, None] * _A + _B).min(axis=0), out=low)
    return low


def _signatures(texts: list[bytes], size: int) -> list[pa.Array]:
    n, both, bands, packed = [], [], [], []
    for own in distinct_shingles(texts, size):
        n.append(len(own))
        both.append(xxhash.xxh3_128_digest(own.tobytes()))
        low = minima(own)
        bands.append([xxhash.xxh3_64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)])
        bits = mix64(low.astype(np.uint64)) >> np.uint64(40)
        unpacked = ((bits[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        packed.append(np.packbits(unpacked.ravel()).tobytes())
    empty = np.array(n) == 0
    digests = np.frombuffer(b"".join(both), "<i8").reshape(-1, 2)
    keys = np.array(bands, np.uint64).reshape(len(n), BANDS).view(np.int64)
    sigs = np.frombuffer(b"".join(packed), "<i8").reshape(len(n), WORDS)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, sigs)]
    return [pa.array(n, pa.int64()), pa.array(digests[:, 0], mask=empty), pa.array(digests[:, 1], mask=empty), *lists]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, h, n, d1, d2, bands, sig) of docs (id, text as binary, h). d1 and d2 name the shingle set; they are null for the empty one."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for own, (texts,) in slices(batches, SLICE, 1):
            made = _signatures(texts, size)
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *made], ["id", "h", "n", "d1", "d2", "bands", "sig"])

    return docs.mapInArrow(run, f"id {id_type}, h bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sig array<bigint>")


def _beside(firsts: list, first_texts: list[bytes], texts: list[bytes], size: int):
    """(set of the first text, set of the text) of each row; a first text that rows share one after another is read once."""
    new = [i == 0 or x != firsts[i - 1] for i, x in enumerate(firsts)]
    ahead, of = distinct_shingles([t for t, n in zip(first_texts, new, strict=True) if n], size), None
    for n, own in zip(new, distinct_shingles(texts, size), strict=True):
        of = next(ahead) if n else of
        yield of, own


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: agreeing minima by bit counts, less those that agree by chance."""
    odd = 0x5555555555555555
    same = F.lit(MINIMA)
    for k in range(WORDS):
        x = a[k].bitwiseXOR(b[k])
        same = same - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))
    chance = 1 / (1 << BITS)
    return (same / MINIMA - chance) / (1 - chance)


class _Links:
    """Which of candidate pairs (src, dst) are linked: by estimate first, then on full sets."""

    def __init__(self, sigs: DataFrame, texts: DataFrame, size: int, num: int, den: int):
        self.sigs, self.texts, self.size, self.num, self.den = sigs, texts, size, num, den

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """(src, dst, likeness, near): near unless sizes or signatures put them too far apart."""
        a, b = (self.sigs.select(F.col("id").alias(x), F.col("n").alias(f"{x}_n"), F.col("sig").alias(f"{x}_s")) for x in ("src", "dst"))
        both = pairs.join(a, "src").join(b, "dst")
        sized = F.least("src_n", "dst_n") * self.den >= F.greatest("src_n", "dst_n") * self.num
        both = both.select("src", "dst", estimate(F.col("src_s"), F.col("dst_s")).alias("likeness"), sized.alias("sized"))
        return both.select("src", "dst", "likeness", (F.col("sized") & (F.col("likeness") >= self.num / self.den - SLACK)).alias("near"))

    def confirmed(self, estimated: DataFrame) -> DataFrame:
        """The near pairs whose full shingle sets have den * intersection >= num * union."""
        kind, size, num, den = self.texts.schema["id"].dataType.simpleString(), self.size, self.num, self.den

        def run(batches):
            for own, (a_texts, b_texts) in slices(batches, SLICE, 2, 3):
                ok = []
                for of, other in _beside(own.column(0).to_pylist(), a_texts, b_texts, size):
                    shared = len(np.intersect1d(of, other, assume_unique=True))
                    ok.append(den * shared >= num * (len(of) + len(other) - shared))
                yield own.select([0, 1]).filter(pa.array(ok, pa.bool_()))

        a, b = (self.texts.select(F.col("id").alias(x), F.col("t").alias(f"{x}_t")) for x in ("src", "dst"))
        return estimated.where("near").select("src", "dst").join(b, "dst").join(a, "src").select("src", "dst", "src_t", "dst_t").mapInArrow(run, f"src {kind}, dst {kind}")

    def deltas(self, placed: DataFrame) -> DataFrame:
        """placed (pivot, id, ...) with n and n_pivot, the sizes of both sets, and d, what only one of them has."""
        size, names = self.size, [*placed.columns, "n", "n_pivot", "d"]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", n bigint, n_pivot bigint, d array<bigint>"
        width = len(placed.columns)

        def run(batches):
            for part, (of_texts, own_texts) in slices(batches, SLICE, width, width + 1):
                rows = [(len(own), len(of), np.setxor1d(own, of, assume_unique=True).view(np.int64)) for of, own in _beside(part.column(0).to_pylist(), of_texts, own_texts, size)]
                found = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *found], names)

        own, of = self.texts.select("id", F.col("t").alias("own_t")), self.texts.select(F.col("id").alias("pivot"), F.col("t").alias("pivot_t"))
        return placed.join(own, "id").join(of, "pivot").select(*placed.columns, "pivot_t", "own_t").mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), a row for each row of docs.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set has its distinct runs of
    shingle_words words, or all its words as one run where they are fewer. Documents link if intersection
    over union is similarity or more, on full sets; component_id is the smallest id that links lead to.
    A document without words (null, empty or blank text) has the empty set and links with nothing, nor
    does a row without id. Repeated rows share a set and so a component; of rows that repeat an id with
    different texts one stands for the id, and all get its component. Other columns are ignored.

    Equal sets meet first, by digest, and go on as one document, the one with the smallest id. Each then
    enters BANDS buckets. All members of a bucket are compared with one of them, its pivot (the smallest
    id); what links is joined to components. Where members of a bucket are then still apart, the links
    that remain are found by what members have more or less than the pivot, see _between_components. So a
    bucket of very many copies costs a few rows a member, and no link is lost. b-bit signatures pass over
    pairs that are surely too far apart; texts of the rest are compared in full.
    """
    num, den = similarity
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    signed = materialize(signatures(docs, shingle_words), "signatures")
    sets = signed.where("id is not null and d1 is not null")
    first = F.min(F.struct("id", "h", "n", "bands", "sig")).alias("x")
    firsts = materialize(sets.groupBy("d1", "d2").agg(first).select("d1", "d2", "x.*"), "firsts", signed.count())
    n_sets = firsts.count()
    own = firsts.groupBy("id").agg(F.min(F.struct("d1", "d2", "h", "n", "bands", "sig")).alias("x")).select("id", "x.*")
    own = materialize(own.select("id", "h", "n", "bands", "sig"), "sets", n_sets)
    rows = own.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("pivot")).where("members > 1")
    members = materialize(rows.join(shared, "bucket").select("bucket", "id", "pivot"), "buckets", BANDS * n_sets)
    texts = materialize(docs.where("id is not null").join(own.join(members.select("id").distinct(), "id", "left_semi").select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id"]), "texts", n_sets, _TEXTS)
    links = _Links(own.select("id", "n", "sig"), texts, shingle_words, num, den)
    n_members = members.count()
    pivots = materialize(links.estimated(members.where("pivot < id").select(F.col("pivot").alias("src"), F.col("id").alias("dst")).distinct()), "pivots", max(n_members, n_sets))
    edges = materialize(links.confirmed(pivots), "links", n_sets, _TEXTS)
    components = _between_components(edges, members, pivots, links, n_members, n_sets)
    of_first = firsts.join(components, firsts["id"] == components["node"], "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    out = signed.select("id", "n", "d1", "d2").join(of_first, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that near_duplicates() keeps: one of each group stays.

    Rows that repeat both an id and a text stay once; those of one id with different texts stay, as do rows
    without id, which link with nothing."""
    found = near_duplicates(docs, shingle_words, similarity, id_col, text_col)
    # the ids that go are written first: a short list then needs no shuffle of the texts
    gone = materialize(found.where("not kept").select(F.col(id_col).alias("gone")).distinct(), "gone")
    kept = docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
    again = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias("again")), "again", docs.count())
    if again.isEmpty():
        return kept
    return kept.join(again, kept[id_col] == again["again"], "left_anti").unionByName(kept.join(again, kept[id_col] == again["again"], "left_semi").dropDuplicates([id_col, text_col]))


def _apart(members: DataFrame, pivots: DataFrame, edges: DataFrame, components: DataFrame, far: float) -> DataFrame:
    """(bucket, id, pivot, c, place) of buckets whose members are in several components.

    c is the member's component; place is "linked" with the pivot, "far" from it (surely less alike than
    far) or "between".
    """
    named = members.join(components, members["id"] == components["node"], "left").select("bucket", "id", "pivot", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("bucket").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("bucket")
    known = pivots.select(F.col("src").alias("pivot"), F.col("dst").alias("id"), "likeness").join(edges.select(F.col("src").alias("pivot"), F.col("dst").alias("id"), F.lit(True).alias("linked")), ["pivot", "id"], "left")
    placed = named.join(mixed, "bucket", "left_semi").join(known, ["pivot", "id"], "left")
    place = F.when((F.col("id") == F.col("pivot")) | F.col("linked"), "linked").when(F.col("likeness") + SLACK < far, "far").otherwise("between")
    return placed.select("bucket", "id", "pivot", "c", place.alias("place"))


def _between_components(edges: DataFrame, members: DataFrame, pivots: DataFrame, links: _Links, n_members: int, n_sets: int) -> DataFrame:
    """(node, component) by edges and by the links between members of a bucket that its pivot has left in different components.

    Two sets link if their symmetric difference is at most r times the sum of their sizes. Let D(x) be the
    symmetric difference of x and the pivot P. A set o that P doesn't link with has |D(o)| > r (|o| + |P|), and
    for any m the difference of o and m is |D(o)| + |D(m)| - 2 |D(o) & D(m)|. So a link of o and m takes some
    number t > 0 of elements that D(o) and D(m) share, and more than (|D(m)| + r (|P| - |m|)) / 2 whatever o is.
    Elements of all D are ranked from the rarest on: the first that two sets share has t - 1 more after it in
    both. Members join on such elements, not on the bucket.

    Members that are far from the pivot have long differences. Distance is a metric, so they can't link with
    what the pivot links with; where they are few they meet the others of their bucket directly.
    """
    far = 1 - 2 * (1 - links.num / links.den)
    n_edges = edges.count()
    components = connected_components(edges, n_edges)
    apart = materialize(_apart(members, pivots, edges, components, far), "apart", n_members)
    if apart.isEmpty():
        return components
    # where very many members are loose, they too are compared by differences; these are long, but few are shared
    crowds = apart.where("place <> 'linked'").groupBy("bucket").agg(F.count(F.lit(1)).alias("loose")).where(F.col("loose") > CROWD).select("bucket", F.lit(True).alias("crowd"))
    apart = apart.join(crowds, "bucket", "left").withColumn("place", F.when(F.col("crowd") & (F.col("place") == "far"), "between").otherwise(F.col("place")))
    loose = apart.where("place <> 'linked' and crowd is null").drop("crowd")
    loose = loose.join(loose.groupBy("id").agg(F.collect_set("bucket").alias("buckets")), "id")
    a, b = (loose.select("bucket", *[F.col(c).alias(f"{x}_{c}") for c in ("c", "place", "buckets")], F.col("id").alias(x)) for x in ("src", "dst"))
    # a pair meets in the least bucket that both are in
    once = (F.col("src_c") != F.col("dst_c")) & ((F.col("dst_place") == "between") | (F.col("src") < F.col("dst"))) & (F.col("bucket") == F.array_min(F.array_intersect("src_buckets", "dst_buckets")))
    beside = a.where("src_place = 'far'").join(b, "bucket").where(once).select("src", "dst")
    # a member that is in a crowd with a pivot is "between" for it, whatever it is in smaller buckets; "linked" is so in all
    placed = apart.where("place <> 'far'").groupBy("pivot", "id").agg(F.first("c").alias("c"), F.max("place").alias("place"))
    deltas = materialize(links.deltas(placed.where("pivot <> id")), "deltas", n_sets, _TEXTS)
    each = deltas.select("pivot", "id", "c", "place", "n", "n_pivot", F.size("d").alias("size"), F.explode("d").alias("e"))
    common = each.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("pivot", "e", "df")
    shared = each.join(common, ["pivot", "e"])
    # elements that no other component has come first in the order of rarity; they can't be shared, but count as ranks
    held = F.sort_array(F.collect_list(F.struct("df", "e")))
    both, apart_by = links.den + links.num, links.den - links.num
    lists = shared.groupBy("pivot", "id", "c", "place", "size", "n", "n_pivot").agg(held.alias("xs"))
    ranked = lists.select("pivot", "id", "c", "place", "size", "n", "n_pivot", F.posexplode("xs").alias("at", "x"), F.size("xs").alias("held"))
    ranked = ranked.select("pivot", "id", "c", "place", "size", "n", "n_pivot", F.col("x.e").alias("e"), (F.col("size") - F.col("held") + F.col("at")).alias("rank"))
    enough = F.floor((both * F.col("size") + apart_by * (F.col("n_pivot") - F.col("n"))) / F.lit(2 * both))
    named = lambda rows, x: rows.select("pivot", "e", *[F.col(c).alias(f"{x}_{c}") for c in ("c", "size", "n", "rank")], F.col("id").alias(x))
    heads, others = named(ranked.where(F.col("rank") < F.col("size") - enough), "dst"), named(ranked.where("place = 'between'"), "src")
    share = F.greatest(F.lit(1), F.ceil((both * (F.col("src_size") + F.col("dst_size")) - apart_by * (F.col("src_n") + F.col("dst_n"))) / F.lit(2 * both)))
    can = (F.col("src_c") != F.col("dst_c")) & (F.col("src_rank") + share <= F.col("src_size")) & (F.col("dst_rank") + share <= F.col("dst_size"))
    within = others.join(heads, ["pivot", "e"]).where(can).select("src", "dst")
    pairs = within.unionByName(beside).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    near = materialize(links.estimated(pairs).where("near"), "near-pairs", n_sets)
    found = materialize(links.confirmed(near), "links", n_sets, _TEXTS)
    n_found = found.count()
    return connected_components(edges.unionByName(found), n_edges + n_found) if n_found else components
