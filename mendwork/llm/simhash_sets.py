"""SimHash near-duplicates whose links are verified by the similarity of shingle sets.

Every distinct set of word shingles has a fingerprint of 1,024 bits. At a
similarity of 0.8 two fingerprints differ in about 15 % of the bits, too many
for one ball. So ball hashing is done in several tables: a table's key is some
of the fingerprint's bits, others for each table as far as they go, and two sets are candidates if their keys
differ in at most two bits, that is, if they share a variant within one bit of
both (see ``simhash``). The number of bits follows the number of sets, so that
a set meets about one unrelated set in a table, and the number of tables
follows from it, so that a pair at the threshold is found by one of them with
a probability of ``RECALL`` (more similar pairs with a higher one). A variant
belongs to the bucket of its table and leading bits; a key is sent once to
each bucket where it has variants, and these are made there.

Candidates are compared in two rounds. In the first, each set is compared with
one that it meets: in every bucket the most central one, whose keys most others
share, and of these the one met in most tables. That ties groups of copies
together with one comparison for each set. In the second, all candidates that lie in different components
are compared; within a component no pair is sent. Sets that share a variant
with ``CROWD`` others or more go to their buckets once more, with the whole
fingerprint, and of their pairs only those that agree in it leave the bucket:
texts that are alike, but less than asked, can be many.
No partner is left out by a cap. The comparisons of fingerprints before the
exact one let a pair pass that differs in as many bits as one at the threshold
may, up to ``DEVIATIONS`` standard deviations.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, cut_lineage, drop, tidy
from .components import connected_components
from .simhash import ball, shingle_hashes

WORDS = 16  # of 64 bits in a fingerprint
RECALL, DEVIATIONS, CROWD = 0.998, 3.0, 8
BUCKET_VARIANTS = 4_000_000  # variants made in one bucket
PART_VARIANTS = 500_000  # and at a time, about
PAIRS = 2_000_000  # pairs that a bucket's task holds
FILTER_BITS = 1 << 29  # 64 MB, which is broadcast

_BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.float64)
_SALTS = np.random.default_rng(5).integers(0, 1 << 64, (WORDS, 1), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.astype("<u8").tobytes(), 7) - (1 << 63)


def wide_fingerprint(grams: np.ndarray, words: int = WORDS) -> bytes:
    """64 bits for each word, each 1 if it is set in over half of the grams' hashes; no grams give zeros."""
    byte_of = 256 * np.arange(8 * words)
    counts = np.zeros(len(byte_of) * 256)
    for at in range(0, len(grams), 1 << 12):
        h = grams[at : at + (1 << 12)] * _SALTS[:words]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        by_byte = np.ascontiguousarray(h.T).astype("<u8").view(np.uint8).reshape(-1, len(byte_of))
        counts += np.bincount((by_byte + byte_of).ravel(), minlength=len(counts))
    ones = counts.reshape(-1, 256) @ _BYTE_BITS
    return np.packbits(2 * ones > max(1, len(grams)), bitorder="little").tobytes()


def differing(similarity: float) -> float:
    """Share of the bits in which two sets of that similarity differ."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def cut(words: int, similarity: float) -> int:
    """Bits in which a pair at the threshold may differ."""
    n, p = 64 * words, differing(similarity)
    return math.ceil(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p)))


class Tables:
    """Choice of the keys' bits for ``n`` sets at a similarity."""

    def __init__(self, n: int, similarity: float) -> None:
        wanted = math.log2(max(1, n)) + math.log2(400)  # a ball of two bits holds about 400 keys
        self.bits = min(40, max(16, 4 * math.ceil(wanted / 4)))
        differ = differing(similarity)
        near = sum(math.comb(self.bits, k) * differ**k * (1 - differ) ** (self.bits - k) for k in range(3))
        self.count = max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(near, 0.999))))
        rng = np.random.default_rng(7)
        each = self.bits // 4
        per = 16 * WORDS // each  # tables until all bits are used
        self.nibbles = np.concatenate([rng.permutation(16 * WORDS)[: per * each].reshape(per, each) for _ in range(-(-self.count // per))])[: self.count]
        # leading bits that a bucket is known by: more of them, the more sets
        self.prefix = min(self.bits - 4, max(0, math.ceil(math.log2(max(1, n * (self.bits + 1) / BUCKET_VARIANTS)))))

    def keys(self, prints: list[bytes]):
        """The keys of each table in turn."""
        a = np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), 8 * WORDS)
        halves = np.stack([a & 15, a >> 4], axis=2).reshape(len(prints), 16 * WORDS).astype(np.uint64)
        for chosen in self.nibbles:
            key = np.zeros(len(prints), dtype=np.uint64)
            for i, nibble in enumerate(chosen):
                key |= halves[:, nibble] << np.uint64(4 * i)
            yield key


def _in_buckets(sets: DataFrame, tables: Tables, reach: int, fn, schema: str, whole: bool = False) -> DataFrame:
    """``fn((table, bucket, prefix), keys, sets, marks, wide)`` yields record batches, for every part of a bucket of ``sets(set, bits, mark)``.

    With ``reach`` 1, keys also go to the buckets where they have variants.
    With ``whole``, ``wide`` has the fingerprints.
    """
    shift = np.uint64(tables.bits - tables.prefix)
    flips = ball(tables.prefix, reach)

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, marks = (batch.column(c).to_numpy().astype("<i8") for c in ("set", "mark"))
            more = [np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype="<u8").reshape(-1, WORDS)] if whole else []
            for table, key in enumerate(tables.keys(batch.column("bits").to_pylist())):
                to = ((key >> shift)[:, None] ^ flips[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, row = to[order], order // len(flips)
                starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                ends = np.append(starts[1:], len(to))
                data = [b"".join(x[row[a:b]].tobytes() for x in (key, own, marks, *more)) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([table] * len(data), pa.int32()), pa.array(to[starts].astype(np.int64)), pa.array(data, pa.binary())], names=["table", "bucket", "data"])

    def receive(batches):
        at, waiting = None, []

        def out():
            parts = [np.frombuffer(x, dtype="<u8") for x in waiting]
            sizes = [len(x) // (3 + WORDS * whole) for x in parts]
            key, own, marks = np.concatenate([x[: 3 * n].reshape(3, n) for x, n in zip(parts, sizes)], axis=1)
            wide = np.concatenate([x[3 * n :].reshape(n, -1) for x, n in zip(parts, sizes)])
            for part, chosen in _parts(tables, at, key, reach):
                yield from fn(part, key[chosen], own[chosen].view(np.int64), marks[chosen].view(np.int64), wide[chosen])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["table"], row["bucket"]) != at:
                    if waiting:
                        yield from out()
                    at, waiting = (row["table"], row["bucket"]), []
                waiting.append(row["data"])
        if waiting:
            yield from out()

    sent = sets.select("set", "bits", "mark").mapInArrow(send, "table int, bucket long, data binary")
    dealt = sent.repartition(min(8192, tables.count << tables.prefix), "table", "bucket").sortWithinPartitions("table", "bucket")
    return dealt.mapInArrow(receive, schema)


def _parts(tables: Tables, at: tuple[int, int], key: np.ndarray, reach: int):
    """A bucket's own buckets, known by more leading bits: each with the places of the keys that have variants there."""
    more = min(tables.bits - 4 - tables.prefix, max(0, math.ceil(math.log2(max(1, len(key) * (tables.bits + 1) / PART_VARIANTS)))))
    lead = key >> np.uint64(tables.bits - tables.prefix - more)
    for bucket in range(at[1] << more, (at[1] + 1) << more):
        chosen = np.flatnonzero(np.bitwise_count(lead ^ np.uint64(bucket)) <= reach)
        if len(chosen):
            yield (at[0], bucket, tables.prefix + more), chosen


def _variants(tables: Tables, bucket: int, prefix: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(variant's lower bits, place of its key) of all variants of one bit or none that lie in the bucket."""
    low = tables.bits - prefix
    rest = key & np.uint64((1 << low) - 1)
    here = (key >> np.uint64(low)) == np.uint64(bucket)
    own = np.flatnonzero(here)
    made = (rest[own][:, None] ^ ball(low, 1)[None, :]).ravel()
    return np.concatenate([made, rest[~here]]), np.concatenate([np.repeat(own, low + 1), np.flatnonzero(~here)])


def _popular(_, key: np.ndarray, own: np.ndarray, *__):
    """(set, others with the same key), if there are any."""
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    often = n[back] > 1
    yield pa.RecordBatch.from_arrays([pa.array(own[often]), pa.array(n[back][often] - 1)], names=["set", "n"])


def _with_centre(tables: Tables):
    """Each set with the set of the highest mark that it shares a variant with; b is null for crowded sets."""

    def fn(at, key, own, marks, _):
        order = np.lexsort((own, -marks))  # the most central set first
        key, own = key[order], own[order]
        variant, place = _variants(tables, *at[1:], key)
        run = np.lexsort((place, variant))
        variant, place = variant[run], place[run]
        starts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
        size = np.diff(np.append(starts, len(variant)))
        centre = np.repeat(place[starts], size)
        crowded = np.unique(own[place[np.repeat(size > CROWD, size)]])
        yield pa.RecordBatch.from_arrays([pa.array(crowded), pa.nulls(len(crowded), pa.int64())], names=["a", "b"])
        best = np.arange(len(own))
        np.minimum.at(best, place, centre)
        tied = np.flatnonzero((best != np.arange(len(own))) & (own != own[best]))
        yield pa.RecordBatch.from_arrays([pa.array(own[tied]), pa.array(own[best[tied]])], names=["a", "b"])

    return fn


def _across(tables: Tables, limit: int | None = None):
    """All pairs that share a variant and have different marks (components, the last bit 1 for crowded sets).

    Without ``limit``, those that are not both crowded; with it, those that
    differ in ``limit`` bits of ``wide`` at most.
    """

    def fn(where, key, own, marks, wide):
        variant, place = _variants(tables, *where[1:], key)
        keys = np.stack(list(tables.keys([x.tobytes() for x in wide])))[: where[0]] if limit is not None else None
        run = np.lexsort((marks[place], variant))
        variant, place = variant[run], place[run]
        mark, crowded = marks >> 1, (marks & 1).astype(bool)
        new = np.concatenate([[True], variant[1:] != variant[:-1]])
        stop, start = _ends(new), _ends(new | np.concatenate([[True], mark[place[1:]] != mark[place[:-1]]]))
        # a place pairs with all later ones of its variant's run that follow its component's
        n = stop - start
        if limit is None:  # in a run of more than CROWD sets all are crowded
            size = np.diff(np.append(np.flatnonzero(new), len(new)))
            n = np.where(np.repeat(size > CROWD, size), 0, n)
        some = np.flatnonzero(n)
        total = np.cumsum(n[some])
        at = 0
        while at < len(some):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            rows = some[at:upto]
            left = place[np.repeat(rows, n[rows])]
            right = place[np.repeat(start[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(len(left))]
            pair = np.unique(np.minimum(left, right) << 32 | np.maximum(left, right))
            left, right = pair >> 32, pair & 0xFFFFFFFF
            if limit is None:
                near = ~(crowded[left] & crowded[right])
            else:
                near = _in_pieces(lambda a, b: np.bitwise_count(wide[a] ^ wide[b]).sum(axis=1, dtype=np.int64) <= limit, left, right)
            left, right = left[near], right[near]
            if limit is not None:  # a pair is told by the first table that it meets in
                new_pair = _in_pieces(lambda a, b: ~(np.bitwise_count(keys[:, a] ^ keys[:, b]) <= 2).any(axis=0), left, right)
                left, right = left[new_pair], right[new_pair]
            yield pa.RecordBatch.from_arrays([pa.array(own[left]), pa.array(own[right])], names=["a", "b"])
            at = upto

    return fn


def _in_pieces(fn, left: np.ndarray, right: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """``fn`` of the pairs, of a piece of them at a time."""
    return np.concatenate([np.zeros(0, dtype=bool), *(fn(left[k : k + piece], right[k : k + piece]) for k in range(0, len(left), piece))])


def _ends(new: np.ndarray) -> np.ndarray:
    """For each place, where its run ends; ``new`` marks the runs' first places."""
    first = np.flatnonzero(new)
    return np.repeat(np.append(first[1:], len(new)), np.diff(np.append(first, len(new))))


def _texts_of(members: DataFrame, distinct: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(set, text): one row with each of the sets ``members``; and the written keys that it reads.

    A bitmap of the text keys asked for, 16 bits a key and ``FILTER_BITS`` at
    most, leaves nearly all other texts out of the shuffle. Beyond 33 million
    sets it lets more of them through; the join decides in any case.
    """
    chosen = cut_lineage(distinct.join(members, "set").select("set", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("key")))
    bits = F.lit(min(FILTER_BITS, max(1 << 15, 16 * chosen.count()))).cast("long")
    at = lambda key: (F.pmod(F.col(key), bits) + 1).alias("at")
    wanted = chosen.select(at("key")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    place = F.bitmap_bit_position("at").cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    possible = keyed.select("*", at("text_key")).join(F.broadcast(wanted), F.bitmap_bucket_number("at") == F.col("bucket")).where(F.getbit(byte, place % 8) == 1)
    return possible.join(chosen, (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("first_id"))).select("set", "text"), chosen


def _verified(pairs: DataFrame, distinct: DataFrame, keyed: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of the pairs whose sets are as similar as asked, by exact comparison."""
    words = [F.conv(F.hex(F.substring("bits", 8 * i + 1, 8)), 16, -10).cast("long").alias(f"w{i}") for i in range(WORDS)]
    prints = distinct.select("set", *words)
    both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    for side in "ab":
        both = both.join(prints.select(F.col("set").alias(side), *(F.col(f"w{i}").alias(f"{side}{i}") for i in range(WORDS))), side)
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    close = cut_lineage(both.where(differ <= cut(WORDS, similarity)).select("a", "b"))

    def grams_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array([shingle_set(b, width).astype("<u8").tobytes() for b in byte_texts(batch.column("text"))], pa.binary())], names=["set", "grams"])

    # texts of candidates only: one row of each of their sets
    members = close.select(F.col("a").alias("set")).unionByName(close.select(F.col("b").alias("set"))).distinct()
    texts, chosen = _texts_of(members, distinct, keyed)
    grams = cut_lineage(texts.mapInArrow(grams_of, "set long, grams binary").dropDuplicates(["set"]))
    drop(chosen)

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same >= similarity * (len(x) + len(y) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    found = close.join(grams.select(F.col("set").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("set").alias("b"), F.col("grams").alias("y")), "b")
    links = cut_lineage(found.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))
    drop(close, grams)
    return links


def links(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, set) of every row of ``docs(id, text)``, and (node, root) of the sets that have links."""

    def sketch(batches):
        for batch in batches:
            ids, prints = [], []
            for b in byte_texts(batch.column("text")):
                grams = shingle_set(b, width)
                ids.append(set_id(grams))
                prints.append(wide_fingerprint(grams))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(ids, pa.int64()), pa.array(prints, pa.binary())], names=["id", "text_key", "set", "bits"])

    keyed = docs.select("id", "text", F.xxhash64("text").alias("text_key"))
    kind = docs.schema["id"].dataType.simpleString()
    sets = cut_lineage(keyed.mapInArrow(sketch, f"id {kind}, text_key long, set long, bits binary"))
    distinct = cut_lineage(sets.groupBy("set").agg(F.min(_first()).alias("first"), F.min("bits").alias("bits")))
    tables = Tables(distinct.count(), similarity)
    shared = _in_buckets(distinct.withColumn("mark", F.lit(0).cast("long")), tables, 0, _popular, "set long, n long").groupBy("set").agg(F.sum("n").alias("n"))
    marked = distinct.select("set", "bits").join(shared, "set", "left").select("set", "bits", F.coalesce("n", F.lit(0)).alias("mark"))
    met = cut_lineage(_in_buckets(marked, tables, 1, _with_centre(tables), "a long, b long"))
    crowd = cut_lineage(met.where("b IS NULL").select(F.col("a").alias("crowded")).distinct())
    # of the central sets that a set meets, the one that it meets in most tables
    often = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max(F.struct("n", "b")).alias("best"))
    first = _verified(often.select("a", F.col("best.b").alias("b")), distinct, keyed, width, similarity)
    roots = cut_lineage(connected_components(first))
    drop(met, first)
    component = F.coalesce("root", "set").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("crowded").isNotNull().cast("long"))
    marked = distinct.select("set", "bits").join(roots, F.col("set") == F.col("node"), "left").join(crowd, F.col("set") == F.col("crowded"), "left").select("set", "bits", component.alias("mark"))
    pairs = _in_buckets(marked, tables, 1, _across(tables), "a long, b long")
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_in_buckets(marked.where("mark % 2 != 0"), tables, 1, _across(tables, cut(WORDS, similarity)), "a long, b long", whole=True))
    second = _verified(pairs, distinct, keyed, width, similarity)
    drop(crowd)
    if not second.isEmpty():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = connected_components(stars.unionByName(second))
    return sets.drop("bits"), roots


def _first():
    """Smallest id first, rows without an id last."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; columns unchanged.

    Texts are near duplicates if their sets of ``width``-word shingles have a
    Jaccard similarity of ``similarity`` or more, directly or over others.
    Rows are told apart by id and text: of an id with several texts each text
    counts for itself, and rows without an id are like all others. Null and
    wordless texts are one group; no rows give no rows.
    """
    with tidy(docs.sparkSession):
        sets, roots = links(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), width, similarity)
    rooted = sets.groupBy("set").agg(F.min(_first()).alias("first")).join(roots, F.col("set") == F.col("node"), "left")
    kept = rooted.groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("first").alias("first"))
    # the same three columns serve the join and the repeated rows: whole texts are dealt and sorted once
    keys = {"_text_key": F.xxhash64(F.col(text)), "_row_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_no_id": F.col(id_col).isNull()}
    of = F.col("first.id")
    kept = kept.select(F.col("first.text_key").alias("_text_key"), F.coalesce(of.cast("string"), F.lit("")).alias("_row_id"), of.isNull().alias("_no_id"))
    return docs.withColumns(keys).join(kept, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
