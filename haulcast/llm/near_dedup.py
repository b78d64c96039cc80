"""Near duplicates by MinHash, with sequential Bayesian verification of the candidates.

1.  A pass over the texts gives each document the size and a fingerprint of its set
    of word shingles, a signature of one byte per hash function, and band keys.
    Documents with the same set are one class from here on.
2.  Classes that share a band key are candidates. A bucket is not expanded into its
    pairs. First each bucket's leader, the member with the most company in all its
    buckets, meets the other members, and links merge components. Where a bucket
    still has several components, the members outside its largest one meet all
    members of other components; a task compares a block of the former with a block
    of the latter on their signatures and hands on only the pairs that survive. So a
    bucket of copies is settled by its leader, and no candidate pair goes untested.
3.  A pair is compared batch by batch of its signature. After each batch the
    posterior of its similarity under a uniform prior is known from the matches; the
    pair is dropped as soon as it reaches the threshold with less than the chosen
    miss probability.
4.  Survivors are confirmed on their full sets, read from the texts again for the
    classes concerned. Confirmed links merge components.

The least similarity and the bands are arguments (``Limits``). With 36 bands of 8
hashes a pair at a similarity of 0.85 shares no band with a probability of 1e-5, at
0.9 of 2e-9; for 0.8 it takes 49 bands of 7.

Edge cases: null texts and texts without words have an empty set, linked with
nothing. A text of fewer words than a shingle is one shingle. Ids may be null or
repeated: a component is named after its smallest id that is not null, and every
row with that id is kept. An empty table gives an empty result. Columns besides
doc_id and text are ignored, or carried in ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.operators.keyed import KeyedTable, keyed
from haulcast.session import materialise

SHINGLE = 5
#: Least similarity in hundredths, bands and hashes a band, where a call names no others.
PERCENT = 85
BANDS, ROWS = 36, 8
BATCH = 32
MISS = 1e-7
#: Members outside the largest component, and members they meet, that one block takes of a bucket.
BLOCK_ASKERS, BLOCK_MEMBERS = 256, 512
SEED = 11


@dataclass(frozen=True)
class Limits:
    """Least similarity in hundredths, and the bands that find its pairs."""

    percent: int = PERCENT
    bands: int = BANDS
    rows: int = ROWS

    def least(self) -> np.ndarray:
        return least_matches(self.percent, self.bands * self.rows)


_CHUNK = 256
_GOLDEN, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased."""
    # for bytes, lower() and split() know A-Z and the six white-space bytes only
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    used = min(width, len(words))
    total = np.full(n, used, np.uint64)
    for j in range(used):
        total = total * _GOLDEN + hashes[j: j + n]
    return np.unique(_mix(total))


@lru_cache(maxsize=4)
def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, count, dtype=np.uint32)


def minhash(shingles: np.ndarray, count: int = BANDS * ROWS, seed: int = SEED) -> np.ndarray:
    """Smallest value of each hash function over the shingles, 32 bits each."""
    factor, shift = _functions(count, seed)
    short, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(count, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), _CHUNK):
        np.minimum(out, (short[start: start + _CHUNK, None] * factor + shift).min(axis=0), out=out)
    return out


def signature(values: np.ndarray) -> bytes:
    """One byte of each value."""
    return ((values * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band."""
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for part in values.reshape(bands, rows).T.astype(np.uint64):
        key = _mix(key * _GOLDEN + part)
    return key.view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


@lru_cache(maxsize=8)
def least_matches(percent: int = PERCENT, count: int = BANDS * ROWS, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """For each number of compared bytes, the fewest matches at which a pair may still reach the threshold.

    A byte matches with probability s + (1 - s) / 256 at similarity s. The posterior
    of s is taken on a grid, from a uniform prior.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    reach = s >= percent / 100 - 1e-9
    out = []
    for n in range(batch, count + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        out.append(int((weight[:, reach].sum(axis=1) / weight.sum(axis=1) < miss).sum()))
    return np.array(out)


def may_be_similar(left: np.ndarray, right: np.ndarray, least: np.ndarray, batch: int = BATCH) -> np.ndarray:
    """Which rows of two signature matrices survive all batches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= fewest]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def _sign(batches: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            shingles = shingle_hashes(text)
            if len(shingles):
                values = minhash(shingles, limits.bands * limits.rows)
                rows.append((len(shingles), fingerprint(shingles), signature(values), band_keys(values, limits.bands, limits.rows)))
            else:
                rows.append((0, None, None, None))
        out = pd.DataFrame(rows, columns=["n", "fp", "sig", "bands"])
        yield pd.concat([b[["doc_id", "thash"]].astype("Int64"), out], axis=1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("thash"))


def signatures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, thash, n (size of the set), fp, sig, bands; one row per document, numbered by ``_row``."""
    signed = _texts(docs).mapInPandas(lambda batches: _sign(batches, limits),
                                      "doc_id long, thash long, n long, fp binary, sig binary, bands array<long>")
    return materialise(signed.withColumn("_row", F.monotonically_increasing_id()), "signatures")


def _classes(signed: DataFrame) -> DataFrame:
    """One row per distinct set: fp, uid (its first row), least (smallest id), copies."""
    sets = signed.filter("n > 0").groupBy("fp").agg(
        F.min("_row").alias("uid"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    return materialise(sets, "sets")


def _members(firsts: DataFrame) -> DataFrame:
    """Buckets with company: key, uid, n, cnt (size of the bucket), head and nh (its leader, and the size of its set)."""
    bands = firsts.select("uid", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("cnt")).filter("cnt > 1").withColumn("_share", F.col("cnt"))
    buckets = KeyedTable.of(materialise(shared, "shared"), "key", "_share")
    members = materialise(buckets.attach(bands).filter("cnt is not null"), "buckets")
    company = members.groupBy("uid").agg(F.sum("cnt").alias("company"))
    # the hash makes the choice among equals the same on every run
    ranked = members.join(company, "uid").withColumn(
        "rank", F.col("company") * (1 << 20) + F.pmod(F.xxhash64("uid"), F.lit(1 << 20)))
    heads = ranked.groupBy("key").agg(F.max_by("uid", "rank").alias("head"), F.max_by("n", "rank").alias("nh"),
                                      F.count("*").alias("_share"))
    return materialise(KeyedTable.of(materialise(heads, "heads"), "key", "_share").attach(members), "members")


def _near(n: str, m: str, percent: int) -> Column:
    """Sizes that allow a link."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of leaders with members of their buckets."""
    met = members.filter((F.col("uid") != F.col("head")) & _near("n", "nh", percent))
    return met.select(F.least("uid", "head").alias("a"), F.greatest("uid", "head").alias("b")).distinct()


def _open(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of buckets with several components: key, uid, n, comp, cnt, asks (outside the largest one), _askers."""
    known = members.join(linked, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    parts = known.groupBy("key", "comp").agg(F.count("*").alias("_m"))
    # of components of one size the same one is taken on every run
    open_ = parts.groupBy("key").agg(F.max(F.struct("_m", "comp")).alias("_top"), F.count("*").alias("_comps"),
                                     F.sum("_m").alias("_share")).filter(
        "_comps > 1").select("key", F.col("_top.comp").alias("main"), F.col("_top._m").alias("_most"), "_share")
    rows = KeyedTable.of(materialise(open_, "open_keys"), "key", "_share").attach(known).filter("main is not null").select("key", "uid", "n", "comp", "cnt", (F.col("comp") != F.col("main")).alias("asks"),
                                           (F.col("cnt") - F.col("_most")).alias("_askers"))
    return materialise(rows, "open")


def _others(rows: DataFrame, full: DataFrame, firsts: DataFrame, limits: Limits) -> DataFrame:
    """Distinct pairs (a, b) of one bucket in different components that may be linked.

    Members of a bucket's largest component need not meet each other. The others
    ("askers") are cut into blocks, and so are the members they meet: every row of a
    block meets every block of askers once. Shingles that no other open class has
    cannot be shared, which bounds the overlap of a pair; pairs within that bound go
    through the batches of their signatures.
    """
    single = full.select("uid", F.explode("shingles").alias("_s")).groupBy("_s").agg(
        F.count("*").alias("_c"), F.min("uid").alias("uid")).filter("_c = 1")
    own = single.groupBy("uid").agg(F.count("*").alias("_own"))
    rows = rows.join(own, "uid", "left").withColumn("most", F.col("n") - F.coalesce("_own", F.lit(0)))
    rows = rows.join(firsts.select("uid", "sig", "bands"), "uid")
    blocks = lambda total, size: F.ceil(total / F.lit(float(size))).cast("int")
    of = lambda count: F.pmod(F.xxhash64("uid"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    ask_blocks, row_blocks = blocks(F.col("_askers"), BLOCK_ASKERS), blocks(F.col("cnt"), BLOCK_MEMBERS)
    asking = rows.filter("asks").withColumn("ask", of(ask_blocks)).withColumn("block", every(row_blocks))
    meeting = rows.withColumn("block", of(row_blocks)).withColumn("ask", every(ask_blocks))
    columns = ["key", "ask", "block", "role", "uid", "n", "most", "comp", "asks", "sig", "bands"]
    both = asking.withColumn("role", F.lit(0)).select(*columns).unionAll(meeting.withColumn("role", F.lit(1)).select(*columns))
    dealt = both.repartition("key", "ask", "block").sortWithinPartitions("key", "ask", "block", "role")
    return dealt.mapInPandas(lambda batches: _meet_blocks(batches, limits), "a long, b long").distinct()


def _meet_blocks(batches: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    """Compare the askers of each block with its members; rows come sorted by block, askers first."""
    least, current, askers = limits.least(), None, []
    for batch in batches:
        place = list(zip(batch["key"], batch["ask"], batch["block"], batch["role"]))
        starts = [0, *(k for k in range(1, len(place)) if place[k] != place[k - 1]), len(place)]
        found = []
        for start, end in zip(starts, starts[1:]):
            part = _Block.of(batch.iloc[start:end])
            if place[start][:3] != current:
                current, askers = place[start][:3], []
            if place[start][3] == 0:
                askers.append(part)
            else:
                found += [pairs for a in askers if len(pairs := a.meet(part, place[start][0], least, limits.percent))]
        out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        yield pd.DataFrame({"a": out.min(axis=1, initial=2**62), "b": out.max(axis=1, initial=-1)})


class _Block:
    """Some members of a bucket as arrays."""

    def __init__(self, uid: np.ndarray, n: np.ndarray, most: np.ndarray, comp: np.ndarray, asks: np.ndarray, sig: np.ndarray,
                 bands: np.ndarray):
        self.uid, self.n, self.most, self.comp, self.asks, self.sig, self.bands = uid, n, most, comp, asks, sig, bands

    @classmethod
    def of(cls, rows: pd.DataFrame) -> "_Block":
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1)
        return cls(*(rows[c].to_numpy() for c in ("uid", "n", "most", "comp")), rows["asks"].to_numpy(bool), sig,
                   np.stack(rows["bands"].to_numpy()))

    def meet(self, other: "_Block", key: int, least: np.ndarray, percent: int) -> np.ndarray:
        """(uid, uid) of the pairs that survive; two askers meet in one order only, and a pair counts in its first bucket."""
        out = []
        for i in range(len(self.uid)):
            overlap = np.minimum(self.most[i], other.most)
            near = overlap * 100 >= (self.n[i] + other.n - overlap) * percent
            k = np.flatnonzero((self.comp[i] != other.comp) & near & (~other.asks | (self.uid[i] < other.uid)))
            if len(k):
                k = k[may_be_similar(np.broadcast_to(self.sig[i], (len(k), self.sig.shape[1])), other.sig[k], least)]
                k = k[self.bands[i][(self.bands[i] == other.bands[k]).argmax(axis=1)] == key]
                out.append(np.column_stack([np.full(len(k), self.uid[i]), other.uid[k]]))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _survivors(pairs: DataFrame, firsts: DataFrame, limits: Limits) -> DataFrame:
    """Pairs that no batch of their signatures rules out."""
    least = limits.least()

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        matrix = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        return pd.Series(may_be_similar(matrix(left), matrix(right), least) if len(left) else [], dtype=bool)

    side = lambda id_, sig: firsts.select(F.col("uid").alias(id_), F.col("sig").alias(sig))
    both = pairs.join(side("b", "sb"), "b").join(side("a", "sa"), "a")
    return both.filter(similar("sa", "sb")).select("a", "b")


def _full_sets(ids: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, shingles) of the classes in ``ids`` only, from their texts."""
    wanted = firsts.join(ids, "uid", "left_semi").select("thash", F.col("uid").alias("_uid"), F.col("doc_id").alias("_did"),
                                                         F.col("fp").alias("_fp"))
    texts = KeyedTable.of(materialise(wanted, "wanted"), "thash").attach(_texts(docs))
    texts = texts.filter(F.col("_uid").isNotNull() & F.col("doc_id").eqNullSafe(F.col("_did"))).select("_uid", "_fp", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 200):
                part = b.iloc[start: start + 200]
                found = [shingle_hashes(t) for t in part["text"]]
                own = [fingerprint(s) == bytes(f) for s, f in zip(found, part["_fp"])]
                out = pd.DataFrame({"uid": part["_uid"].to_numpy(), "shingles": [s.view(np.int64) for s in found]})
                yield out[np.array(own, bool)]

    return materialise(texts.mapInPandas(sets, "uid long, shingles array<long>").dropDuplicates(["uid"]), "full_sets")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links: pairs whose full sets are similar enough."""
    side = lambda id_, s: full.select(F.col("uid").alias(id_), F.col("shingles").alias(s))
    both = pairs.join(side("b", "sb"), "b").join(side("a", "sa"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.filter(common * 100 >= union * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to, for every node with a link.

    Each step takes the smallest label among a node's neighbours and then the label
    of that label, so paths of labels halve while labels spread.
    """
    both = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("_least"), F.count("*").alias("degree")).select(
        F.col("a").alias("node"), F.least("a", "_least").alias("root"), "degree"), "labels")
    while True:
        # a hub is the neighbour of as many nodes as its degree
        near = KeyedTable.of(labels, "node", "degree").attach(both, "b").groupBy("a").agg(F.min("root").alias("_near"))
        spread = labels.join(near, labels["node"] == near["a"]).select(
            "node", "degree", F.col("root").alias("_old"), F.least("root", "_near").alias("_new"))
        hop = labels.select(F.col("node").alias("_new"), F.col("root").alias("_hop"))
        step = materialise(spread.join(hop, "_new", "left").select(
            "node", "degree", "_old", F.least("_new", F.coalesce("_hop", "_new")).alias("root")), "labels")
        labels = step.select("node", "root", "degree")
        if step.filter("root < _old").isEmpty():
            return labels.drop("degree")


def near_classes(docs: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, distinct sets, component of each set that is linked: uid, comp)."""
    signed = signatures(docs, limits)
    sets = _classes(signed)
    firsts = signed.join(sets.select(F.col("uid").alias("_row")), "_row", "left_semi").withColumnRenamed("_row", "uid")
    firsts = materialise(firsts, "firsts")
    members = _members(firsts)
    none = firsts.limit(0).select("uid", F.col("uid").alias("comp"))
    met = materialise(_stars(members, limits.percent), "stars")
    pairs = materialise(_survivors(met, firsts, limits), "survivors")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    linked = _link(materialise(none, "components"), pairs, _full_sets(ids, firsts, docs), limits.percent)
    rows = _open(members, linked)
    full = _full_sets(rows.select("uid").distinct(), firsts, docs)
    others = _others(rows, full, firsts, limits).join(met, ["a", "b"], "left_anti")
    return signed, sets, _link(linked, materialise(others, "survivors"), full, limits.percent)


def _link(linked: DataFrame, pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Components after the links among ``pairs`` are confirmed."""
    links = materialise(_confirmed(pairs, full, percent), "confirmed")
    return linked if links.isEmpty() else _merge(linked, links)


def _merge(linked: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links between classes."""
    known = KeyedTable.of(linked, "uid")
    begun = known.attach(links, "a").select(F.coalesce("comp", "a").alias("a"), "b")
    between = known.attach(begun, "b").select("a", F.coalesce("comp", "b").alias("b")).filter("a <> b")
    roots = components(between.distinct())
    new = roots.select(F.col("node").alias("uid"), F.col("root").alias("comp"))
    moved = KeyedTable.of(roots, "node").attach(linked, "comp").select("uid", F.coalesce("root", "comp").alias("comp"))
    return materialise(moved.unionAll(new.join(linked.select("uid"), "uid", "left_anti")), "components")


def _labelled(docs: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, thash, n_shingles, component_id, kept."""
    signed, sets, linked = near_classes(docs, limits)
    placed = materialise(sets.join(linked, "uid", "left"), "placed")
    # one component may hold a third of all sets, and unlinked sets have none
    names = keyed(placed, "comp", {"_least": F.min("least")}, "names")
    named = names.attach(placed).select(
        "fp", "copies", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("_least")).alias("component_id"))
    joined = KeyedTable.of(materialise(named, "named"), "fp", "copies").attach(signed.select("doc_id", "thash", "n", "fp"))
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "thash", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicate_groups(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Pairs at a similarity of ``percent`` hundredths or more are linked; a pair s alike
    is missed with a probability of (1 - s ** rows) ** bands.
    """
    return _labelled(docs, Limits(percent, bands, rows)).drop("thash")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all its columns."""
    dropped = materialise(_labelled(docs, Limits(percent, bands, rows)).filter("not kept").select(
        F.col("doc_id").alias("_did"), F.col("thash").alias("_thash")).distinct(), "dropped")
    # the caller's columns travel in one, apart from those of the dropped rows
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    gone = F.col("_doc.doc_id").eqNullSafe(F.col("_did")) & (F.xxhash64("_doc.text") == F.col("_thash"))
    return packed.join(dropped, gone, "left_anti").select("_doc.*")
