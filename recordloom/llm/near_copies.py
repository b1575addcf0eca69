"""Near copies: SimHash links by the vantage-point tree, held to an exact Jaccard similarity, and a join of prefixes for the rest.

A text's set holds the hash (64 bits) of each run of `words` words, cut and lower-cased as for SimHash; a shorter text is
one shingle. Texts whose fingerprints over such runs lie at 2 bits or fewer are found by simhash_vp and compared by their
whole sets. Similar texts mostly lie further apart than that (0.8 makes some 10 of 64 bits, where a tree of any kind no
longer parts fingerprints), so a second search finds the others: all sets are sorted in one order, shingles rare in a
sample of texts first, then by hash. Of two sets with similarity t or more, each has one of the other's among its first
n - ceil(t n) + 1, so texts that share one of these are compared, unless they are linked already, or their places and
sizes leave no room for the overlap that they need, or the parities of both sets over 1024 bits, which differ in no
more bits than the sets in shingles, don't allow it. No pair is left out and none is let in wrongly, but for collisions
of 64-bit hashes (and 128 bits for whole sets).

Equal sets are one node of the search. Each text is first compared with the least of those that it shares a shingle with.
As long as over LARGE texts of different components share one, there are rounds: the texts of such a
shingle are dealt to blocks of BLOCK at most, another way each time, each text takes the first of its block, of another
component, that places, sizes and parities allow, and is compared with that one alone, so that a large group of copies
is linked by a few comparisons of each of its texts. After that, or when a round doesn't link a tenth of its pairs, all
pairs that are left are compared one by one. No group is gathered in a task.

Rows are told apart by a number that is stored with their sets, and found again by their place in their Parquet files;
rows that don't come from files are written first.

Cases: null and empty texts have the empty set and are each other's copies only; equal rows, rows with the same id or
without one are rows of their own, and of equal ids the first row counts as smaller; a very long text is one set; an
empty table gives an empty one; other columns, whatever their names, are kept.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_vp
from .common import small_batches, text_slices, utf8, written
from .components import components, hot_lookup

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, Fraction(4, 5)
#: Texts in the sample at most, shingles that count as common at most.
SAMPLE, COMMON = 1 << 15, 1 << 20
#: Rounds of one comparison for each text, at most, and texts that share a shingle at which they end.
ROUNDS, LARGE = 5, 1024
#: Texts of a shingle that a task compares by their parities at once, about.
BLOCK = 2048
#: Buckets of rows that are broadcast, and words whose hashes a task remembers, at most.
BUCKETS, REMEMBERED = 1 << 20, 1 << 16


class Shingles:
    """shingles(raw) gives the sorted distinct hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}
        self.odd = np.frombuffer(xxhash.xxh3_128_digest(b"shingle") * words, np.uint64)[:words].copy()
        self.odd *= np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.odd |= np.uint64(1)

    def __call__(self, raw: bytes) -> np.ndarray:
        own, known = raw.lower().split(), self.known
        if not own:
            return np.zeros(0, np.uint64)
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(own).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 42)
        h = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        n = max(1, len(h) - self.words + 1)
        out = np.full(n, min(len(h), self.words), np.uint64)
        for k in range(min(self.words, len(h))):
            out += h[k : k + n] * self.odd[k]
        out ^= out >> np.uint64(30)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
        return np.unique(out)


def _placed(docs: DataFrame) -> DataFrame:
    """docs, with a place that is the same whenever they are read: written, unless they come from Parquet files as they are."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return written(docs, "rows")
    return docs


def _place(docs: DataFrame) -> tuple[Column, Column]:
    own = docs.metadataColumn("_metadata")
    return F.xxhash64(own["file_path"]).alias("file"), own["row_index"].alias("at")


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one text of a sample has, sorted, and how many have them."""
    n = rows.count()
    rate = int(min(SAMPLE / max(1, n), 1 / 16 if n > SAMPLE else 1) * (1 << 30))

    def run(batches):
        of = Shingles(words)
        for batch in text_slices(batches, 0):
            for raw in utf8(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(of(raw).view(np.int64))], ["h"])

    few = rows.where(F.expr(f"pmod(xxhash64(file, at), {1 << 30}) < {rate}")).select("text").mapInArrow(run, "h bigint")
    found = few.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, count = found["h"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def _described(rows: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """id, file and at of each row; set (its digest), n (its size), prefix, parity over 1024 bits and fp (fingerprint)."""
    table = rows.sparkSession.sparkContext.broadcast(_common(rows, words))

    def run(batches):
        of, (common, count) = Shingles(words), table.value
        for batch in text_slices(batches, 3):
            digests, sizes, prefixes, parities, fps = [], [], [], [], []
            for raw in utf8(batch.column(3)):
                h = of(raw)
                fps.append(simhash_vp.fingerprint(raw, words))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                parities.append(np.packbits((np.bincount((h >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).astype(bool)).tobytes())
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, count[at], 0), kind="stable")]
                needed = -(-similarity.numerator * len(h) // similarity.denominator)
                prefixes.append(h[: len(h) - needed + 1].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
            columns = [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(parities, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "file", "at", "set", "n", "prefix", "parity", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "file", "at", "text").mapInArrow(run, f"id {kind}, file bigint, at bigint, set binary, n bigint, prefix array<bigint>, parity binary, fp bigint")


def _parted(rows: DataFrame, few: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """rows in two parts by buckets of their keys, BUCKETS at most, which are broadcast: those in a bucket of `few`, and the rest.

    Only the first part, the rows of `few` and about one in 16 besides, needs a shuffle to be joined with it.
    """
    n = min(BUCKETS, 1 << max(4, (16 * few.count()).bit_length()))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n))
    marked, same = F.broadcast(few.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket")
    return rows.join(marked, same, "left_semi"), rows.join(marked, same, "left_anti")


def _without(rows: DataFrame, few: DataFrame, *keys: str) -> DataFrame:
    some, rest = _parted(rows, few, *keys)
    return rest.unionByName(some.join(few.select(*keys).hint("merge"), list(keys), "left_anti").select(rows.columns))


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """Those of the pairs (a, b: row numbers) whose sets have the similarity. sets: row, file, at, n, parity."""

    def possible(batches):
        num, den = similarity.numerator, similarity.denominator
        for batch in batches:
            bits = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, 16) for c in ("p", "q")]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(1, dtype=np.int64)
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            # Sets of n shingles together that share o differ in n - 2 o, and need o (num + den) >= num n.
            yield batch.select(["a", "b"]).filter(pa.array((n - apart) * (num + den) >= 2 * num * n))

    def whole(batches):
        of = Shingles(words)
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(x).tobytes() for x in utf8(batch.column(1))], pa.binary())], ["row", "set"])

    def similar(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = shared * similarity.denominator >= similarity.numerator * (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    own = sets.select("row", "n", "parity")
    pairs = pairs.join(own.toDF("a", "n", "p"), "a").join(own.toDF("b", "m", "q"), "b").select("a", "b", "n", "m", "p", "q")
    pairs = written(pairs.mapInArrow(possible, "a bigint, b bigint"), "possible")
    used = sets.join(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "row", "left_semi")
    used = written(used.select("row", "file", "at"), "used")
    held = _parted(rows, used, "file", "at")[0].join(used.hint("merge"), ["file", "at"]).select("row", "text")
    held = written(held.mapInArrow(whole, "row bigint, set binary"), "sets")
    both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(similar, "a bigint, b bigint"), "links")


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """a, b: rows that link by their fingerprints, in a forest: each with the least of its fingerprint, and those with one another."""
    least = written(sets.groupBy("fp").agg(F.min("row").alias("low"), F.count("*").alias("n")), "distinct")
    found = simhash_vp.links(least)
    a, b = (least.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in "ab")
    near = found.join(a, "a").join(b, "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b"))
    same = hot_lookup(sets.select("fp", "row"), least.where("n > 1"), "fp", "n").where("row <> low").select(F.col("low").alias("a"), F.col("row").alias("b"))
    return near.unionByName(same)


def _first_partners(similarity: Fraction):
    """For rows of a shingle: a and b, where a is the first row before b, of another component, that may be similar; c and d: their components."""
    num, den = similarity.numerator, similarity.denominator

    def pairs(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        row, met, place = (rows[c].to_numpy() for c in ("row", "met", "place"))
        n, at = place & 0xFFFFFFFF, place >> 32
        bits = np.frombuffer(b"".join(rows["parity"].to_pylist()), np.uint64).reshape(-1, 16)
        first = np.full(len(row), -1)
        for i in range(len(row) - 1):
            todo = np.flatnonzero((first[i + 1 :] < 0) & (met[i + 1 :] != met[i])) + i + 1
            both = n[todo] + n[i]
            todo = todo[np.minimum(n[todo] - at[todo], n[i] - at[i]) * (num + den) >= num * both]
            apart = np.bitwise_count(bits[todo] ^ bits[i]).sum(1, dtype=np.int64)
            first[todo[(n[todo] + n[i] - apart) * (num + den) >= 2 * num * (n[todo] + n[i])]] = i
        b = np.flatnonzero(first >= 0)
        return pa.table({"a": row[first[b]], "b": row[b], "c": met[first[b]], "d": met[b]})

    return pairs


def components_of_copies(rows: DataFrame, own: DataFrame, sets: DataFrame, words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """node, component of linked rows. rows: file, at, text; own: row, n and prefix; sets: row, file, at, n, parity and fp, of a row of each set."""
    num, den = similarity.numerator, similarity.denominator
    # Place in the prefix and size of the set, as one number.
    entries = own.where("n > 0").select("row", "n", F.posexplode("prefix").alias("at", "h")).select("h", "row", F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("n")).alias("place"))
    groups = entries.groupBy("h").agg(F.count("*").alias("size"), F.min("row").alias("least")).where("size > 1")
    shared = written(entries.join(groups.select("h", "least"), "h"), "shared")
    first = shared.groupBy("row").agg(F.min("least").alias("a")).where("a < row").select("a", F.col("row").alias("b"))
    found = _verified(first.unionByName(_simhash_pairs(sets)).distinct(), rows, sets, words, similarity)
    met = components(found).withColumnRenamed("node", "row")
    left = written(shared.select("h", "row", "place").join(met, "row", "left").select("h", "row", "place", F.coalesce("component", "row").alias("met")), "met")
    for k in range(ROUNDS):
        # Shingles that many rows of several components share.
        several = written(left.groupBy("h").agg(F.count("*").alias("n"), F.min("met").alias("low"), F.max("met").alias("high")).where(f"low < high and n > {LARGE}").select("h", "n"), "several")
        if several.isEmpty():
            break
        dealt = left.join(several, "h").withColumn("block", F.pmod(F.xxhash64("row", F.lit(k)), F.ceil(F.col("n") / BLOCK)))
        dealt = dealt.join(sets.select("row", "parity"), "row").select("h", "block", "row", "place", "met", "parity")
        near = dealt.groupBy("h", "block").applyInArrow(_first_partners(similarity), "a bigint, b bigint, c bigint, d bigint")
        taken = written(near.groupBy("b").agg(F.min(F.struct("a", "c", "d")).alias("t")).select("t.a", "b", "t.c", "t.d"), "taken")
        more = _verified(taken.select("a", "b"), rows, sets, words, similarity)
        compared, linked = taken.count(), more.count()
        found = found.unionByName(more)
        # Components that are linked now are one.
        joined = components(taken.join(more, ["a", "b"], "left_semi").select(F.col("c").alias("a"), F.col("d").alias("b"))).withColumnRenamed("node", "met")
        left = written(left.join(joined, "met", "left").select("h", "row", "place", F.coalesce("component", "met").alias("met")), "met")
        if 10 * linked < compared:
            break
    # Shingles that rows of several components still share.
    several = left.groupBy("h").agg(F.min("met").alias("low"), F.max("met").alias("high")).where("low < high").select("h")
    left = left.join(several, "h", "left_semi")
    n, at = (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))), (lambda c: F.shiftright(c, 32))
    a, b = (left.select("h", F.col("row").alias(c), n("place").alias(f"n_{c}"), at("place").alias(f"at_{c}"), F.col("met").alias(f"met_{c}")) for c in "ab")
    # At the first shingle that two share, all that they share lies from there on in both.
    room = f"least(n_a - at_a, n_b - at_b) * {num + den} >= {num} * (n_a + n_b)"
    rest = a.hint("merge").join(b, "h").where(f"a < b and met_a <> met_b and {room}").select("a", "b").distinct()
    return components(found.unionByName(_verified(rest, rows, sets, words, similarity)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest id, those without one last."""
    with small_batches(docs.sparkSession):
        return _kept(docs, id_col, text_col, words, similarity)


def _kept(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: Fraction) -> DataFrame:
    """keep_one(); all that goes to Python is run before this returns."""
    docs = _placed(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *_place(docs))
    own = written(_described(rows, words, similarity).select(F.monotonically_increasing_id().alias("row"), "*"), "prefixes")
    # One row of each set stands for it in the search; the best row of each, by id, may be another.
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "file", "at")
    best = written(own.groupBy("set").agg(F.min("row").alias("node"), F.min(order).alias("best")), "distinct")
    again = written(own.select("row", "set", "file", "at").join(best.select("set", "node"), "set").where("row <> node").select("row", "file", "at"), "again")
    own = _without(own.select("row", "file", "at", "n", "parity", "fp", "prefix"), again.select("row"), "row")
    sets = written(own.select("row", "file", "at", "n", "parity", "fp"), "nodes")
    met = components_of_copies(rows.select("file", "at", "text"), own.select("row", "n", "prefix"), sets, words, similarity)
    kept = best.join(met, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("best").alias("best")).select("best.file", "best.at")
    places = sets.select("file", "at").unionByName(again.select("file", "at"))
    gone = written(places.join(kept, ["file", "at"], "left_anti"), "gone")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), *_place(docs))
    return _without(whole, gone, "file", "at").select("kept.*")
