"""N-gram Jaccard join under several global orders.

Two sets with a Jaccard index of at least t share a token among the first n - ceil(t n) + 1 tokens of each, whatever order
all sets are sorted in. So candidates must share such a prefix token under each of several orders; the filters are
intersected before any pair is verified.

All orders put a fixed share of the token space (the region) first and sort it by document frequency, so that only the
region's tokens are ever counted, and tokens that no other set has come first: they fill most prefixes, match nothing and
are dropped. The orders differ in how they break ties. Sets are the unit of work: equal sets are one row throughout.

Sets that share prefix tokens form families. Within a family (or, where it is too large for one task, within each two of
its blocks; or, where these are too many and few copies do, within each two blocks of the sets that share one token) every
pair that passes the filters is verified exactly, once; what leaves a task is a spanning forest of the links and each set's
number of links, never all pairs. Blocks of a family are stored once and read by the tasks in which they meet.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import qualified, store_of
from .common import durable, hot_join, shared_folder, small, table
from .components import connected
from .exact import bloom_of, held, key_hash, rows_without

#: Words of a shingle, and the least Jaccard index in percent, of the registered query; near-duplicate stages elsewhere take their own.
SHINGLE, PERCENT = 4, 85
#: Share of the token space that the orders put first, in prefix lengths. Less of it is cheaper to count, but a set whose
#: prefix it cannot fill with tokens of its own stays a candidate, and families grow.
REGION_PREFIXES = 2.0
ORDERS = 3
#: Most sets and tokens that meet in one task, and most blocks that a larger family is cut into. Families of up to a few sets
#: share tasks, some so many sets in each.
FAMILY_SETS, FAMILY_TOKENS, MOST_BLOCKS, FEW, BIN_SETS = 2048, 1_500_000, 64, 16, 256
#: Copies of a family's sets that meeting by shared token may make, and meetings of blocks that one task aims at.
TOKEN_COPIES, TASK_PAIRS = 16, 4
#: Tokens after which a task hands on what it has: sets, and what sets post.
BATCH_TOKENS, POSTED_TOKENS = 200_000, 1_000_000
#: Tokens of a bucket in which they are counted, and least buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 1_000_000, 64

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the whole text.

    Words are runs of anything but ASCII white space, A-Z in lower case. A text of fewer words than ``size`` has one
    shingle, the whole sequence; a text without words has none. Different shingles of one text have equal hashes with a
    probability of n * n / 2 ** 65.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        out = out * _STEP + h[i : len(words) - k + 1 + i]
    return np.unique(mixed(out))


def set_key(tokens: np.ndarray) -> bytes:
    """The set's name: 128 bits, so that different sets share one with a probability of n * n / 2 ** 129 among n sets."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short_name(key: bytes) -> int:
    """Half of the name, which postings carry. Sets that share it only become candidates of each other's partners."""
    return int.from_bytes(key[:8], "little", signed=True)


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def posted_part(tokens: np.ndarray, percent: int, region: float) -> np.ndarray:
    """The region's tokens of a set, or as many as its prefix needs if these are more."""
    bound = np.uint64(min(int(region * 2**64), 2**64 - 1))
    return tokens[: max(prefix_length(len(tokens), percent), int(np.searchsorted(tokens, bound)))]


def set_facts(docs: DataFrame, key: str, text: str, size: int, percent: int, region: float) -> DataFrame:
    """(key, n_shingles, set_key, name, gap) for every row; set_key and name are null for empty sets.

    ``gap`` is the prefix length less the number of tokens that the set posts.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size)
                name = set_key(s) if len(s) else None
                rows.append((len(s), name, short_name(name) if name else None, prefix_length(len(s), percent) - len(posted_part(s, percent, region)) if name else 0))
            n, names, shorts, gaps = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(shorts, pa.int64()), pa.array(gaps, pa.int32())], [key, "n_shingles", "set_key", "name", "gap"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(facts, f"`{key}` {kind}, n_shingles long, set_key binary, name long, gap int")


def posted(docs: DataFrame, key: str, text: str, named: DataFrame, size: int, percent: int, region: float, form, schema: str) -> DataFrame:
    """What ``form`` makes of the tokens that sets post: batches of it from lists of token arrays and short names.

    Of rows with equal sets only the one that ``named`` (a stored table) gives as ``_doc`` is read, and few others that its
    Bloom filter lets pass; a task posts an equal set once.
    """
    first = docs.sparkSession.sparkContext.broadcast(bloom_of(named.select(key_hash("_doc").alias("key"))))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tokens, names, n = [], [], 0
        for b in batches:
            for k in np.flatnonzero(held(first.value, b.column(0).to_numpy(zero_copy_only=False))):
                s = shingle_set(b.column(1)[int(k)].as_py(), size)
                if not len(s) or (name := set_key(s)) in seen:
                    continue
                seen.add(name)
                own = posted_part(s, percent, region)
                tokens.append(own)
                names.append(short_name(name))
                n += len(own)
                if n > POSTED_TOKENS:
                    yield form(tokens, names)
                    tokens, names, n = [], [], 0
        if tokens:
            yield form(tokens, names)

    return docs.select(key_hash(key).alias("_hash"), text).mapInArrow(post, schema)


def count_key(token: Column, buckets: int) -> Column:
    """The name under which a token is counted: its bucket and half of its bits."""
    return F.shiftleft(F.shiftrightunsigned(token, 32) % F.lit(buckets), 32).bitwiseOR(token.bitwiseAND(F.lit(0xFFFFFFFF)))


def count_keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """``count_key`` of an array."""
    return (((tokens >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))


def token_counts(docs: DataFrame, key: str, text: str, named: DataFrame, size: int, percent: int, region: float, buckets: int) -> DataFrame:
    """(key, c): under how many names tokens are posted twice or more, by ``count_key``.

    Halves of tokens move, four bytes each, packed by bucket. Two tokens of one name are counted together: the count is the
    same wherever either of them comes, which is all that an order needs.
    """

    def packed(tokens: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        keys = np.sort(count_keys(np.concatenate(tokens), buckets))
        of = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        halves = np.split(keys.astype(np.uint32), starts[1:])
        return pa.RecordBatch.from_arrays([pa.array(of[starts].astype(np.int32)), pa.array([h.tobytes() for h in halves], pa.binary())], ["bucket", "halves"])

    def counted(rows: pa.Table) -> pa.Table:
        found, c = np.unique(np.concatenate([np.frombuffer(h.as_buffer(), np.uint32) for h in rows.column("halves")]), return_counts=True)
        keys = (np.uint64(rows.column("bucket")[0].as_py()) << np.uint64(32)) | found[c > 1].astype(np.uint64)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(c[c > 1].astype(np.int64))], ["key", "c"])

    halves = posted(docs, key, text, named, size, percent, region, packed, "bucket int, halves binary")
    return halves.groupBy("bucket").applyInArrow(counted, "key long, c long")


def postings(docs: DataFrame, key: str, text: str, named: DataFrame, size: int, percent: int, region: float, counts: DataFrame, buckets: int) -> DataFrame:
    """(token, name) of what every set posts and ``counts`` (a stored table) has: tokens that its Bloom filter rules out are not moved."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(counts.select("key")))

    def rows(tokens: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        every, of = np.concatenate(tokens), np.repeat(np.array(names, np.int64), [len(t) for t in tokens])
        passed = held(shared.value, count_keys(every, buckets).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(every[passed].view(np.int64)), pa.array(of[passed])], ["token", "name"])

    return posted(docs, key, text, named, size, percent, region, rows, "token long, name long")


def shared_prefixes(docs: DataFrame, key: str, text: str, named: DataFrame, size: int, percent: int, region: float, orders: int) -> DataFrame:
    """(name, p1 .. pN): of each set that has any, the prefix tokens under each order that another set posts too.

    Tokens of one set alone come first in every order, so what is left of the prefix follows from their number. Where two
    sets share a name, their tokens are put together, and the longer prefix that this gives holds both of theirs.
    """
    gaps = named.groupBy("name").agg(F.max("gap").alias("gap"))
    buckets = max(LEAST_BUCKETS, int((named.agg(F.sum("n")).first()[0] or 0) * min(region, 1) / BUCKET_TOKENS))
    counts = durable(token_counts(docs, key, text, named, size, percent, region, buckets))
    total = counts.agg(F.sum("c")).first()[0] or 0
    found = postings(docs, key, text, named, size, percent, region, counts, buckets).withColumn("key", count_key(F.col("token"), buckets))
    met = hot_join(found, counts, "key", "c", ["name"], total).groupBy("name").agg(F.collect_set(F.struct("token", "c")).alias("held"))
    met = met.join(gaps, "name").withColumn("q", F.size("held") + F.col("gap")).filter("q > 0")

    def first(k: int):
        rank = F.transform("held", lambda x: F.struct((x["c"] if k == 1 else F.floor(F.log2(x["c"]))).cast("long").alias("c"), F.xxhash64(x["token"], F.lit(k)).alias("h"), x["token"].alias("token")))
        return F.transform(F.slice(F.sort_array(rank), F.lit(1), F.col("q")), lambda x: x["token"])

    return met.select("name", *[first(k).alias(f"p{k}") for k in range(1, orders + 1)])


class Lists:
    """For each token of a group's arrays, the rows that have it."""

    def __init__(self, arrays: list[np.ndarray]):
        sizes = np.array([len(a) for a in arrays])
        tokens, of = np.unique(np.concatenate(arrays), return_inverse=True)
        self.of = of.astype(np.int32)
        rows = np.repeat(np.arange(len(arrays), dtype=np.int32), sizes)
        self.rows = rows[np.argsort(self.of, kind="stable")]
        self.ends = np.cumsum(np.bincount(self.of, minlength=len(tokens)))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.n = len(arrays)

    def overlaps(self, row: int) -> np.ndarray:
        """How many tokens the row shares with each row."""
        own = self.of[self.at[row] : self.at[row + 1]]
        own = own[self.ends[own] - self.starts[own] > 1]
        parts = [self.rows[a:b] for a, b in zip(self.starts[own], self.ends[own])]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)


def link_group(names: list[bytes], sets: list[np.ndarray], prefixes: list[list[np.ndarray]], percent: int, weight: np.ndarray, block: np.ndarray | None = None, token: int | None = None) -> list[tuple[bytes, bytes, int]]:
    """(name, least name of its tree, links) of the sets that have links: a spanning forest, and the weights of all partners.

    With ``block`` only pairs from different blocks are looked at, with ``token`` only pairs whose least common token of the
    first prefix it is: such pairs meet in other tasks, too.
    """
    n = np.array([len(s) for s in sets])
    root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    orders = [Lists(p) for p in prefixes]
    full = None
    for x in range(1, len(sets)):
        fits = 100 * np.minimum(n[:x], n[x]) >= percent * np.maximum(n[:x], n[x])
        if block is not None:
            fits &= block[:x] != block[x]
        for lists in orders:
            if not fits.any():
                break
            fits &= lists.overlaps(x)[:x] > 0
        if not fits.any():
            continue
        full = full or Lists(sets)
        both = full.overlaps(x)[:x]
        found = np.flatnonzero(fits & (100 * both >= percent * (n[:x] + n[x] - both)))
        if token is not None:
            found = np.array([y for y in found if np.intersect1d(prefixes[0][x], prefixes[0][y])[0] == token], np.int64)
        links[x] += weight[found].sum()
        links[found] += weight[x]
        for y in np.unique(root[found]):
            a, b = sorted((int(y), int(root[x])))
            root[root == b] = a
    least = {r: min(names[i] for i in np.flatnonzero(root == r)) for r in np.unique(root)}
    return [(names[i], least[root[i]], int(links[i])) for i in range(len(sets)) if links[i]]


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, region: float | None = None, orders: int = ORDERS, family_sets: int = FAMILY_SETS, family_tokens: int = FAMILY_TOKENS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(key, n_shingles, component_id, n_links) for every row; component_id is the least key that links reach.

    ``n_links`` is the number of other rows that the row is linked with directly, those of an equal set among them. Null and
    empty texts have an empty set and are linked with nothing: their component is their own key. Repeated rows share a
    component. Null keys take part in links but never name a component unless all its keys are null. Texts of any length are
    read whole; other columns play no part.
    """
    spark = docs.sparkSession
    region = REGION_PREFIXES * (1 - percent / 100) if region is None else region
    facts = durable(set_facts(docs, key, text, size, percent, region))
    full = facts.filter("set_key IS NOT NULL")
    named = full.groupBy("set_key").agg(F.min(key).alias("_doc"), F.first("name").alias("name"), F.first("n_shingles").alias("n"), F.first("gap").alias("gap"), F.count(F.lit(1)).alias("docs"))
    named = durable(named)
    active = durable(shared_prefixes(docs, key, text, named, size, percent, region, orders))

    shared = active.select("name", F.explode("p1").alias("token"))
    leaders = shared.groupBy("token").agg(F.min("name").alias("leader"), F.count(F.lit(1)).alias("c"))
    total = active.agg(F.sum(F.size("p1"))).first()[0] or 0
    families = durable(connected(hot_join(shared, leaders, "token", "c", ["name"], total), "name", "leader"))
    # a set that leads all its tokens and has no family may still share its name with another set
    members = active.join(families, active["name"] == families["node"]).drop("node").join(named.drop("gap"), "name")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1")

    def blocks():
        """One for what fits a task, else so many that any two do."""
        n = F.greatest(F.ceil(2 * F.col("sets") / family_sets), F.ceil(2 * F.col("tokens") / family_tokens)).cast("int")
        return F.when((F.col("sets") <= family_sets) & (F.col("tokens") <= family_tokens), 1).otherwise(n)

    few = (F.col("sets") <= min(FEW, family_sets)) & (F.col("tokens") * BIN_SETS <= F.col("sets") * family_tokens)
    members = durable(members.join(sizes.select("root", blocks().alias("blocks"), few.alias("few")), "root"))
    bins = max(1, members.filter("few").count() // min(BIN_SETS, family_sets))
    members = members.withColumn("part", F.when(F.col("few"), F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root"))).drop("root", "few", "name")

    # of each set the text of one row is read again: rows that a Bloom filter of these rows' keys rules out are not looked at
    wanted = spark.sparkContext.broadcast(bloom_of(members.select(key_hash("_doc").alias("key"))))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()

        def out(names: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["set_key", "set"])

        for b in batches:
            names, sets, tokens = [], [], 0
            for k in np.flatnonzero(held(wanted.value, b.column(0).to_numpy(zero_copy_only=False))):
                s = shingle_set(b.column(1)[int(k)].as_py(), size)
                if len(s) and (name := set_key(s)) not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(s.view(np.int64))
                    tokens += len(s)
                if tokens > BATCH_TOKENS:
                    yield out(names, sets)
                    names, sets, tokens = [], [], 0
            yield out(names, sets)

    huge = members.filter(F.col("blocks") > most_blocks)
    by_token = F.lit(False)
    if huge.limit(1).count():
        tokens = huge.select("set_key", "n", F.col("part").alias("family"), F.explode("p1").alias("part"))
        lists = tokens.groupBy("family", "part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1").withColumn("blocks", blocks())
        copies = lists.groupBy("family").agg(F.sum(F.col("tokens") * F.col("blocks")).alias("moved"))
        cheap = copies.join(huge.groupBy(F.col("part").alias("family")).agg(F.sum("n").alias("all")), "family").filter(F.col("moved") <= TOKEN_COPIES * F.col("all"))
        # at most a name for each most_blocks x family_sets / 2 sets
        members = durable(members.join(small(durable(cheap.select(F.col("family").alias("part"), F.lit(True).alias("by_token")))), "part", "left"))
        by_token = F.coalesce("by_token", F.lit(False))
    members = members.withColumn("by_token", by_token)

    hits = docs.select(key_hash(key).alias("_hash"), text).mapInArrow(tokens_of, "set_key binary, `set` array<long>")
    kept = hits.join(small(durable(members.select("set_key", "part", "blocks", "by_token"))), "set_key")
    p = [f"p{k}" for k in range(1, orders + 1)]
    columns, schema = ["node", "root", "links", "whole"], "node binary, root binary, links long, whole boolean"
    own = F.pmod(F.xxhash64("set_key", F.lit("block")), F.col("blocks")).cast("int")
    folder = qualified(spark, f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}")

    def facts_of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return left.drop_duplicates("set_key").merge(right, on="set_key").sort_values("set_key")

    def linked(f: pd.DataFrame, apart: bool, token: int | None = None) -> list[tuple]:
        if len(f) < 2:
            return []
        arrays = {c: [np.asarray(a, np.int64) for a in f[c]] for c in [*p, "set"]}
        return link_group(list(f["set_key"]), arrays["set"], [arrays[c] for c in p], percent, f["docs"].to_numpy(np.int64), f["own"].to_numpy() if apart else None, token)

    def whole_or_block(where: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The links of what is one task, and a file of what is a block."""
        part, blocks_, k = where
        f = facts_of(left, right)
        del left, right
        if blocks_ == 1:
            return pd.DataFrame([(*r, True) for r in linked(f, False)], columns=columns)
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        lists = {c: pa.array(list(f[c]), pa.list_(pa.int64())) for c in [*p, "set"]}
        t = pa.table({"set_key": pa.array(list(f["set_key"]), pa.binary()), "docs": pa.array(f["docs"], pa.int64()), **lists})
        with store.open_output_stream(f"{base}/{part}_{k}") as to, pa.ipc.new_file(to, t.schema) as file:
            file.write_table(t)
        return pd.DataFrame([], columns=columns)

    def block(part: int, k: int) -> pd.DataFrame | None:
        store, base = store_of(folder)
        if not store.get_file_info(f"{base}/{part}_{k}").is_file:
            return None  # no set has this block
        with store.open_input_file(f"{base}/{part}_{k}") as file:
            return pa.ipc.open_file(file).read_all().to_pandas().assign(own=k)

    def met_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, i, j in frame[["part", "i", "j"]].itertuples(index=False):
                found = [f for f in (block(part, k) for k in dict.fromkeys((i, j))) if f is not None]
                if found:
                    yield pd.DataFrame([(*r, False) for r in linked(pd.concat(found), i != j)], columns=columns)

    def met_tokens(where: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        token, _, i, j = where
        return pd.DataFrame([(*r, False) for r in linked(facts_of(left, right), i != j, token)], columns=columns)

    of = members.select("set_key", "part", "blocks", "by_token", "docs", *p)
    keys = ["part", "blocks", "own"]
    # named anew, as both come of the same members
    left, right = [x.filter("NOT by_token").drop("by_token").withColumn("own", own).select(*[F.col(c).alias(c) for c in (*x.drop("by_token").columns, "own")]) for x in (kept, of)]
    links = durable(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(whole_or_block, schema))
    cut = members.filter("blocks > 1 AND NOT by_token").select("part", "blocks").distinct()
    pairs = cut.select("part", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("part", "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    n = pairs.count()
    if n:
        dealt = pairs.repartition(max(min(n, spark.sparkContext.defaultParallelism), -(-n // TASK_PAIRS)))
        links = links.unionByName(dealt.mapInPandas(met_blocks, schema))
    if huge.limit(1).count() and not (some := members.filter("by_token")).isEmpty():
        tokens = some.select("set_key", "n", F.explode("p1").alias("part"))
        lists = tokens.groupBy("part").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1")
        met = durable(hot_join(tokens, lists.select("part", blocks().alias("blocks"), "sets"), "part", "sets", ["set_key"], some.agg(F.sum(F.size("p1"))).first()[0] or 0).select("set_key", "part", "blocks"))

        def dealt_out(rows: DataFrame):
            rows = rows.join(met, "set_key").withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            rows = rows.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_other")
            return rows.select(*[F.col(c).alias(c) for c in rows.columns])

        sets = dealt_out(kept.filter("by_token").select("set_key", "set")).drop("own")
        keys = ["part", "blocks", "i", "j"]
        links = links.unionByName(sets.groupBy(*keys).cogroup(dealt_out(of.filter("by_token").drop("part", "blocks", "by_token")).groupBy(*keys)).applyInPandas(met_tokens, schema))
    links = durable(links)
    # what was one task is done: its forest is one star for each component
    done, open_ = links.filter("whole").select("node", "root"), links.filter("NOT whole")
    roots = durable(done.unionByName(connected(open_, "node", "root"))) if open_.limit(1).count() else done
    degrees = links.groupBy(F.col("node").alias("set_key")).agg(F.sum("links").alias("links"))

    placed = named.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left").join(degrees, "set_key", "left")
    placed = durable(placed.select("set_key", F.coalesce("root", "set_key").alias("root"), "_doc", "docs", F.coalesce("links", F.lit(0)).alias("links")))
    least = placed.groupBy("root").agg(F.min("_doc").alias("component_id"), F.count(F.lit(1)).alias("c"))
    by_set = hot_join(placed, least, "root", "c", ["set_key"], named.count()).select("set_key", "component_id", "docs", (F.col("links") + F.col("docs") - 1).alias("n_links"))
    out = hot_join(full.select(key, "n_shingles", "set_key", F.monotonically_increasing_id().alias("_id")), by_set, "set_key", "docs", ["_id"], facts.count())
    none = facts.filter("set_key IS NULL").select(key, "n_shingles", F.col(key).alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.select(key, "n_shingles", "component_id", "n_links").unionByName(none)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows whose key is not the least of its component. Rows with a null key stay.

    Rows of one key stay or go together. Only rows that may have to go are moved.
    """
    met = components(docs, key, text, **settings)
    dropped = durable(met.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_dropped")).distinct())
    return rows_without(docs, key, dropped)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts, components and links of all documents: four words, a Jaccard index of 85 percent or more."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs by shared shingles, and reachability by recursion.
OP2_SQL = f"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT r, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i) WHERE len(w) > 0
), sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
    SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r
    GROUP BY a.r, b.r HAVING 100 * count(*) >= {PERCENT} * (any_value(x.n) + any_value(y.n) - count(*))
), reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.other GROUP BY reach.r),
degrees AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN sizes USING (r) LEFT JOIN least USING (r) LEFT JOIN degrees USING (r)
"""
