"""N-gram Jaccard self-join with token-combination prefixes.

Documents link when the Jaccard similarity of their sets of word shingles is at least ``num / den``; the result is each
document's component under these links.  The join is exact and works in five steps:

1. *Sets.*  Each text becomes its sorted 64-bit shingle hashes.  Equal sets fall into one class, and go on as one set.
2. *Lone tokens.*  A linked set has at most ``eps = n (den - num) / den`` tokens that its partner lacks, so a set with more
   than ``eps`` tokens that occur nowhere else has no partner.  Counting them in the ``1.5 eps + 4`` smallest hashes
   of every set is enough to rule out unrelated texts, and only survivors' whole sets are ever shuffled.
3. *Signatures.*  Survivors' tokens are ordered rare first.  A token in at most ``FREQUENT`` sets is a signature alone.
   Frequent tokens are dealt by hash to slots, and signatures are pairs of tokens of one slot; the prefix is extended
   until ``rare + sum over slots (tokens - 1) > eps``.  Two linked sets then share a rare token or both tokens of a pair.
   The number of slots follows the set's size, so a set has about as many pairs as its prefix has tokens.
4. *Buckets.*  Sets of a small bucket are verified pair by pair.  In a large one, every set is compared with one pivot only
   and rewritten as its difference from the pivot, which is a small set of rarely shared tokens.  Two sets whose differences
   share no token are as far apart as these are long together; so if any two of them link, both link to the set for which
   difference and size are best (see ``_space``), and one pass over the bucket gives these links.  Sets with a common token in
   their differences meet by it: a join of small sets, solved in the same way until no bucket is large.  So no group is ever
   paired with itself.
5. *Components* of the verified links by star contraction.

Defined results: a null or empty text has an empty set and is linked with nothing; rows that repeat an id count as rows
of their own; a null id takes part, and a component of null ids only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, components, discard, list_column, materialize, maybe_in, shingles, words_of

FREQUENT = 32  # a token in more sets than this is of the frequent class
PAIRED = 8  # a bucket of first signatures with more sets goes through a pivot
PAIRED_DIFFERENCES = 128  # the same for differences, which are short
SLICE_TOKENS, SLICES = 1 << 22, 4  # head tokens counted at a time, so that not all are shuffled at once; most slices


def _profile(width: int, num: int, den: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            keys, firsts, sizes, tokens = [], [], [], []
            for text in batch.column("body").to_pylist():
                found = shingles(words_of(text), width)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                keys.append(digest)
                firsts.append(int.from_bytes(digest[:8], "little", signed=True))
                sizes.append(len(found))
                eps = len(found) * (den - num) // den
                tokens.append((found if whole else found[: eps + eps // 2 + 4]).view(np.int64))
            own = [batch.column(i) for i, f in enumerate(batch.schema) if f.name != "body"]
            names = [f.name for f in batch.schema if f.name != "body"]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(sizes, pa.int32()), list_column(tokens, pa.int64())],
                names=[*names, "key", "key_head", "n", "tokens"],
            )

    return run


def _sets(docs: DataFrame, width: int, num: int, den: int, whole: bool) -> DataFrame:
    """(id, key, key_head, n, tokens): the set of every row, its head only unless ``whole``."""
    kind = dict(docs.dtypes)["id"]
    return docs.select("id", F.col("text").cast("binary").alias("body")).mapInArrow(
        _profile(width, num, den, whole), f"id {kind}, key binary, key_head long, n int, tokens array<long>"
    )


def _similar(nx: Column, ny: Column, difference: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes that differ in so many tokens reach the threshold, in whole numbers."""
    return (nx + ny - difference) * den >= (nx + ny + difference) * num


def _signatures(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            rids, sizes, cores, lone, signs = [], [], [], [], []
            for rid, n, found in zip(batch.column("rid").to_pylist(), batch.column("n").to_pylist(), batch.column("found"), strict=True):
                flat = found.values
                token = flat.field("token").to_numpy(zero_copy_only=False)
                df = flat.field("df").to_numpy(zero_copy_only=False)
                eps, alone = n * (den - num) // den, n - len(token)
                if alone > eps:
                    continue
                order = np.lexsort((token, df))
                token, df = token[order], df[order]
                need = eps + 1 - alone
                rare = token[df <= FREQUENT][:need]
                out = [rare]
                if len(rare) < need:
                    out += _pairs(token[df > FREQUENT], need - len(rare), n, num, den)
                rids.append(rid)
                sizes.append(n)
                lone.append(alone)
                cores.append(np.sort(token))
                signs.append(np.unique(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(lone, pa.int32()), list_column(cores, pa.int64()), list_column(signs, pa.int64())],
                names=["rid", "n", "lone", "tokens", "signs"],
            )

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _pairs(frequent: np.ndarray, need: int, n: int, num: int, den: int) -> list[np.ndarray]:
    """Pairs of frequent tokens (rarest first) of one slot, over the prefix that covers ``need`` missing tokens.

    Slots depend on the magnitude of the set's size.  A set near a power of two deals its tokens for both magnitudes, so
    that it meets partners of either.
    """
    out, bits = [], frequent.view(np.uint64)
    for level in range(max(1, n * num // den).bit_length(), max(1, -(-n * den // num)).bit_length() + 1):
        slot = (_mix(bits) % np.uint64(max(1, 2**level // 16))).astype(np.int64)
        # A token covers one missing token unless it is the first of its slot.
        first = np.zeros(len(slot), dtype=bool)
        first[np.unique(slot, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        taken, place = bits[:end], slot[:end]
        order = np.lexsort((taken, place))
        taken, place = taken[order], place[order]
        gap = 1
        while gap < len(taken):
            same = place[gap:] == place[:-gap]
            if not same.any():
                break
            a, b = taken[:-gap][same], taken[gap:][same]
            out.append(_mix(_mix(a + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) + b).view(np.int64))
            gap += 1
    return out


def _difference(left: str, right: str, number: str):
    """Rows of two token lists to the count and, where asked, the tokens in which they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_rows(batches):
            found = [
                np.setxor1d(np.asarray(a.values, dtype=np.int64), np.asarray(b.values, dtype=np.int64), assume_unique=True)
                for a, b in zip(batch.column(left), batch.column(right), strict=True)
            ]
            names = [f.name for f in batch.schema if f.name not in (left, right)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in names), pa.array([len(x) for x in found], pa.int32()), list_column(found, pa.int64())],
                names=[*names, number, "tokens"],
            )

    return run


def _with_tokens(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """pairs(*keys, x, y) with sizes, lone counts and token lists of both sides."""
    side = lambda s: members.select(*keys, F.col("rid").alias(s), F.col("n").alias(f"n{s}"), F.col("lone").alias(f"lone{s}"), F.col("tokens").alias(f"tokens{s}"))
    return pairs.join(side("x"), [*keys, "x"]).join(side("y"), [*keys, "y"])


def _compare(pairs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs with the tokens in which they differ; lone tokens, which no other set has, are counted only."""
    kinds = dict(members.dtypes)
    fields = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "x long, y long, nx int, ny int, lonex int, loney int, apart int, tokens array<long>"])
    rows = _with_tokens(pairs, members, keys).select(*keys, "x", "y", "nx", "ny", "lonex", "loney", "tokensx", "tokensy")
    return rows.mapInArrow(_difference("tokensx", "tokensy", "apart"), fields).withColumn("apart", F.col("apart") + F.col("lonex") + F.col("loney"))


def _buckets(entries: DataFrame, keys: list[str], order: str, limit: int, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries of small buckets, and (rid, pivot) of large ones; and the table of sizes that both read."""
    sizes = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(order, "rid")).alias("low"), F.sum(F.col("far").cast("int")).alias("fars"))
    # Written first, so that the join below is one of plain shuffles, whose hot keys Spark can split.
    sizes = materialize(sizes.where("size > 1 and fars > 0"), f"{name}_sizes")
    placed = entries.join(sizes, keys)
    return placed.where(F.col("size") <= limit), placed.where((F.col("size") > limit) & (F.col("rid") != F.col("low.rid"))).withColumn("pivot", F.col("low.rid")), sizes


def links(sets: DataFrame, num: int, den: int, name: str) -> list[DataFrame]:
    """Links (a, b) between sets(rid, n, tokens), enough of them to give every component, in written tables.

    Tables between, and ``sets``, are deleted as soon as they have been read for the last time.
    """
    tokens = sets.select("rid", "n", F.explode("tokens").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    shared = materialize(shared, f"{name}_shared")
    found = tokens.join(shared, "token").groupBy("rid", "n").agg(F.collect_list(F.struct("token", "df")).alias("found"))
    members = materialize(found.mapInArrow(_signatures(num, den), "rid long, n int, lone int, tokens array<long>, signs array<long>"), f"{name}_members")
    discard(sets, shared)
    entries = members.select("rid", "n", "lone", F.explode("signs").alias("sign"), F.lit(True).alias("far"))
    entries = materialize(entries, f"{name}_entries")
    small, large, sizes = _buckets(entries, ["sign"], "lone", PAIRED, name)
    core = lambda s: F.col(f"{s}.n") - F.col(f"{s}.lone")
    least = F.col("x.n") + F.col("y.n") - 2 * F.least(core("x"), core("y"))
    pairs = (
        small.alias("x")
        .join(small.alias("y"), (F.col("x.sign") == F.col("y.sign")) & (F.col("x.rid") < F.col("y.rid")) & _similar(F.col("x.n"), F.col("y.n"), least, num, den))
        .select(F.col("x.rid").alias("x"), F.col("y.rid").alias("y"))
        .distinct()
    )
    spokes = large.select(F.col("rid").alias("x"), F.col("pivot").alias("y")).distinct()
    pairs = materialize(pairs.withColumn("spoke", F.lit(False)).unionByName(spokes.withColumn("spoke", F.lit(True))).groupBy("x", "y").agg(F.max("spoke").alias("spoke")), f"{name}_pairs")
    discard(entries, sizes)
    compared = _compare(pairs.where("not spoke").select("x", "y"), members, [])
    done, depth = [_linked(compared, num, den, f"{name}_links0")], 0
    spaces = _compare(pairs.where("spoke").select("x", "y"), members, []).withColumn("space", F.xxhash64("y"))
    read = [pairs, members]
    while True:
        depth += 1
        members, near = _space(spaces, num, den, f"{name}_{depth}")
        discard(*read)
        done.append(near)
        if members.where("far").isEmpty():
            discard(members)
            return done
        pairs, spokes = _differences(members, num, den, f"{name}_{depth}")
        done.append(_linked(_compare(pairs, members, ["space"]), num, den, f"{name}_links{depth}"))
        discard(pairs)
        if spokes.isEmpty():
            discard(spokes, members)
            return done
        spaces = _compare(spokes, members, ["space"]).withColumn("space", F.xxhash64("space", "y"))
        read = [spokes, members]


def _linked(compared: DataFrame, num: int, den: int, name: str) -> DataFrame:
    linked = compared.where(_similar(F.col("nx"), F.col("ny"), F.col("apart"), num, den))
    return materialize(linked.select(F.col("x").alias("a"), F.col("y").alias("b")), name)


def _space(compared: DataFrame, num: int, den: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Sets compared with the pivots of their spaces to the spaces' members, and to links among these.

    A member is (space, rid, n, lone, tokens, far): its lone tokens and the shared ones in which it differs from the
    shared tokens of the pivot; the pivot is a member too.  Let ``over = length * (den + num) - n * (den - num)`` of a
    member's difference.  Two members without a common token in their differences link exactly if their ``over`` add up
    to zero or less.  If so, either of them also links to the member with the least ``over``, since what the two might
    share only brings them nearer.  So linking all that can to that member leaves no such pair apart; the rest is ``far``.
    """
    sets = compared.select("space", F.col("x").alias("rid"), F.col("nx").alias("n"), F.col("lonex").alias("lone"), "tokens")
    pivots = compared.select("space", F.col("y").alias("rid"), F.col("ny").alias("n"), F.col("loney").alias("lone")).distinct()
    members = sets.unionByName(pivots.withColumn("tokens", F.array().cast("array<long>")))
    over = (F.size("tokens") + F.col("lone")) * (den + num) - F.col("n") * (den - num)
    members = materialize(members.withColumn("over", over), f"{name}_sets")
    least = members.groupBy("space").agg(F.min(F.struct("over", "rid")).alias("low"))
    least = materialize(least.select("space", F.col("low.over").alias("least"), F.col("low.rid").alias("centre")), f"{name}_centres")
    placed = members.join(least, "space").withColumn("far", F.col("over") + F.col("least") > 0)
    near = materialize(placed.where("not far and rid <> centre").select(F.col("rid").alias("a"), F.col("centre").alias("b")), f"{name}_near")
    placed = materialize(placed.drop("over", "least", "centre"), f"{name}_space")
    discard(members, least)
    return placed, near


def _differences(members: DataFrame, num: int, den: int, name: str) -> tuple[DataFrame, DataFrame]:
    """One level of step 4: pairs to verify, and (x, pivot) of buckets still large.

    The prefix of a difference is one token longer than any two linked sets can be apart.
    """
    tokens = members.select("space", "rid", "n", "lone", "far", F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    shared = tokens.groupBy("space", "token").agg(F.count(F.lit(1)).alias("df"), F.max("far").alias("any_far")).where("df > 1")
    found = tokens.join(shared, ["space", "token"]).groupBy("space", "rid", "n", "lone", "far", "length").agg(
        F.sort_array(F.collect_list(F.struct("df", "token", "any_far"))).alias("found")
    )
    # Lone tokens come first in the order; what is left of the prefix takes shared ones.
    alone = F.col("lone") + F.col("length") - F.size("found")
    most = F.floor(F.col("n") * (den - num) / num).cast("int") + 1
    entries = found.withColumn("shared", F.size("found")).withColumn("left", most - alone).where("left > 0")
    entries = entries.select("space", "rid", "n", "far", (F.col("lone") + F.col("length")).alias("length"), "shared", F.posexplode(F.slice("found", 1, F.col("left"))).alias("at", "e")).where("e.any_far")
    entries = entries.select("space", F.col("e.token").alias("token"), F.col("e.df").alias("df"), "rid", "n", "far", "length", (F.col("shared") - F.col("at")).alias("rest"))
    entries = materialize(entries, f"{name}_entries")
    # A bucket is no larger than its token is frequent, so only those of very frequent tokens need to be counted.
    rows = ["space", "token", "rid", "n", "far", "length", "rest"]
    small = entries.where(F.col("df") <= PAIRED_DIFFERENCES).select(*rows)
    fewer, large, sizes = _buckets(entries.where(F.col("df") > PAIRED_DIFFERENCES).select(*rows), ["space", "token"], "length", PAIRED_DIFFERENCES, name)
    small = small.unionByName(fewer.select(*rows))
    # Where two differences first meet in the order of tokens, they have no more in common than either has left from there;
    # further meetings of a pair that can link are not needed.
    least = F.col("x.length") + F.col("y.length") - 2 * F.least("x.rest", "y.rest")
    pairs = small.alias("x").join(
        small.alias("y"),
        (F.col("x.space") == F.col("y.space")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.rid") < F.col("y.rid")) & (F.col("x.far") | F.col("y.far"))
        & _similar(F.col("x.n"), F.col("y.n"), least, num, den),
    )
    pairs = materialize(pairs.select(F.col("x.space").alias("space"), F.col("x.rid").alias("x"), F.col("y.rid").alias("y")).distinct(), f"{name}_pairs")
    spokes = materialize(large.select("space", F.col("rid").alias("x"), F.col("pivot").alias("y")).distinct(), f"{name}_large")
    discard(entries, sizes)
    return pairs, spokes


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _lone(profile: DataFrame, name: str) -> list[DataFrame]:
    """(key_head, lone) in written tables, one for each slice of the tokens.

    A token is lone if only one set has it; copies of one set do not count.
    """
    heads = profile.select("key_head", F.explode("tokens").alias("token"))
    slices = min(SLICES, 1 + (profile.agg(F.sum(F.size("tokens"))).first()[0] or 0) // SLICE_TOKENS)
    out = []
    for part in range(slices):
        once = heads.where(F.pmod("token", F.lit(slices)) == part).groupBy("token").agg(F.min("key_head").alias("key_head"), F.max("key_head").alias("other")).where("key_head = other")
        out.append(materialize(once.groupBy("key_head").agg(F.count(F.lit(1)).alias("lone")), f"{name}_lone{part}"))
    return out


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, name: str = "jaccard") -> DataFrame:
    """(id, key, n_shingles, component_id) of every row of ``docs``; ``key`` names the set."""
    if not den / 2 < num < den:
        raise ValueError("the threshold must lie between one half and one")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profile = materialize(_sets(docs, width, num, den, whole=False), f"{name}_profile")
    classes = materialize(profile.where("n > 0").groupBy("key", "key_head", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), f"{name}_classes")
    counted = _lone(profile, name)
    lone = _union(counted).groupBy("key_head").agg(F.sum("lone").alias("lone"))
    eps = F.floor(F.col("n") * (den - num) / den)
    left = classes.join(lone, "key_head", "left").where(F.coalesce("lone", F.lit(0)) <= eps).select("key", "first")
    left = materialize(left, f"{name}_left")
    rows = materialize(profile.select("id", "key", "n"), f"{name}_rows")
    discard(profile, *counted)
    # Other rows that the filter lets through have other keys, or hold the same set.
    chosen = docs.where(maybe_in(left.select("first"))(F.col("id")))
    whole = _sets(chosen, width, num, den, whole=True).drop("id", "key_head").join(left.select("key"), "key", "left_semi")
    sets = materialize(whole.dropDuplicates(["key"]).withColumn("rid", F.monotonically_increasing_id()), f"{name}_sets")
    named = materialize(sets.select("key", "rid"), f"{name}_named")
    discard(left)
    linked = links(sets, num, den, name)
    tied = components(_union(linked), f"{name}_tied")
    discard(*linked)
    tied = named.select("key", F.col("rid").alias("node")).join(tied, "node").join(classes.select("key", "first"), "key")
    firsts = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    tied = tied.join(firsts, "component").select("key", "component_id")
    # Classes of one row that link with nothing need no look-up.
    known = classes.where("copies > 1").select("key", "first").join(tied, "key", "full").select("key", F.coalesce("component_id", "first").alias("component_id"))
    known = materialize(known, f"{name}_known").withColumn("tied", F.lit(True))
    discard(classes, named)
    return rows.join(known, "key", "left").select(
        "id", "key", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("tied"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, name: str = "one_of_each") -> DataFrame:
    """The rows of ``docs`` with one row of each component, that with the smallest id; texts without words all stay.

    Rows that repeat that id and hold the same set count as one; which of them stays is not defined where their other columns differ.
    """
    found = jaccard_classes(docs, id_col, text_col, width, num, den, name)
    low = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("low")).select("low.*")
    kept = materialize(low, f"{name}_kept").withColumn("__kept", F.lit(True))
    # By id: its rows, and whether they stay.  An id of one row needs no text to be looked at again.
    stays = F.coalesce("__kept", F.lit(False)) | (F.col("n_shingles") == 0)
    marked = found.join(kept, found["key"].eqNullSafe(kept["key"]) & found["id"].eqNullSafe(kept["id"]), "left").select(found["id"], stays.alias("stays"))
    by_id = materialize(marked.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("rows"), F.max("stays").alias("stays")), f"{name}_ids")
    here = lambda rows, ids: rows.join(ids.select("__id"), rows[id_col].eqNullSafe(ids["__id"]), "left_semi")
    # Texts are not shuffled for it: what no filter of the other ids knows stays at once, and the few ids that one lets through by chance
    # have a filter of their own and are looked up.
    other = maybe_in(by_id.where("rows > 1 or not stays").select("__id"))
    chance = materialize(by_id.where("rows = 1 and stays").where(other(F.col("__id"))).select("__id"), f"{name}_chance")
    key = F.col(f"`{id_col}`")
    plain = docs.where(~other(key)).unionByName(here(docs.where(other(key) & maybe_in(chance)(key)), chance))
    repeated = by_id.where("rows > 1 and stays")
    if repeated.isEmpty():
        return plain
    keyed = here(docs.where(maybe_in(repeated.select("__id"))(key)), repeated).withColumn("__body", F.col(f"`{text_col}`").cast("binary"))
    keyed = keyed.withColumn("__key", _set_key(width)(F.col("__body"))).drop("__body")
    stay = keyed.join(kept, keyed["__key"].eqNullSafe(kept["key"]) & keyed[id_col].eqNullSafe(kept["id"]), "left_semi")
    stay = stay.dropDuplicates(["__key", id_col]).unionByName(keyed.where(F.col("__key").isNull()))
    return plain.unionByName(stay.select(*(F.col(f"`{c}`") for c in docs.columns)))


def _set_key(width: int):
    """The name of a text's set, null if it is empty."""

    @F.arrow_udf("binary")
    def run(bodies: pa.Array) -> pa.Array:
        found = (shingles(words_of(t), width) for t in bodies.to_pylist())
        return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found], pa.binary())

    return run
