"""N-gram Jaccard join: a MinHash LSH forest proposes, exact verification decides."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.llm.common import checked_broadcast, components, give_back, map_text, materialize, text_bytes
from ledgermatch.llm.words import grams, mixed, split_words

#: Documents, and shingles, that one side of a verified block holds at most on average.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 500_000
#: Members of a bucket that meet one first member, and sketches that one side of a compared block holds on average.
BUCKET_ROWS, BLOCK_SKETCHES = 4_096, 1_024
#: Members up to which buckets are compared together.
SMALL_BUCKET = 48
_FIELD = T.StructField


def forest_depth(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix at which the forest still finds a pair at the threshold with probability ``recall``.

    Prefixes start at ``longest`` and are shortened until 1 - (1 - threshold ** depth) ** trees reaches the target.
    """
    for depth in range(longest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    raise ValueError(f"{trees} trees do not reach a recall of {recall} at {threshold}")


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` words; of a shorter text, one hash of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes, min(size, len(hashes))))


def _each(column, size: int):
    raw, at = text_bytes(column)
    w = split_words(raw, at)
    h = w.hashes()
    return (_shingles(h[a:b], size) for a, b in zip(w.first, w.first[1:], strict=False))


def _signature(size: int, trees: int, levels: list[int]):
    """Per text: a digest of its shingle set, a sketch of one byte per MinHash, and per level the prefix of every tree as one number."""
    longest = levels[0]

    def work():
        factors = mixed(np.arange(1, trees * longest + 1, dtype=np.uint64)) | np.uint64(1)

        def make(column):
            digests, sketches, prefixes = [], [], []
            for s in _each(column, size):
                digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                if not len(s):
                    sketches.append(None)
                    prefixes.append([])
                    continue
                low = np.full(trees * longest, np.iinfo(np.uint64).max, np.uint64)
                for a in range(0, len(s), 1024):
                    np.minimum(low, (s[a : a + 1024, None] * factors).min(axis=0), out=low)
                low = mixed(low)
                sketches.append(low.astype(np.uint8).tobytes())
                low = low.reshape(trees, longest)
                key, at = np.arange(trees, dtype=np.uint64), {}
                for level in range(longest):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, level])
                    at[level + 1] = key
                prefixes.append(np.concatenate([at[level] for level in levels]).view(np.int64))
            return [digests, sketches, prefixes]

        return make

    return work


def _agree(one: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """For two stacks of sketches, whether so much of them agrees that their sets may be similar."""
    need = least * one.shape[1]
    out = np.zeros((len(one), len(other)), bool)
    step = max(1, (1 << 24) // max(other.size, 1))
    for a in range(0, len(one), step):
        out[a : a + step] = (one[a : a + step, None, :] == other[None, :, :]).sum(axis=2, dtype=np.int32) >= need
    return out


def _merged(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that chains of links ``a[i] - b[i]`` reach, for every index."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _starts(batch, names: list[str]) -> np.ndarray:
    """Where the value of the columns changes in sorted rows, the first row included."""
    columns = [batch.column(n).to_numpy() for n in names]
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _stars(least: float):
    """Rows sorted by bucket and digest: ties every member that agrees with its bucket's first one to it; a bucket is streamed."""

    def run(batches):
        first = None  # the first member of the bucket that the last batch ended in
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if first is not None:
                rows = pa.concat_tables([first, rows])
            begin = _starts(rows, ["prefix", "salt"])
            head = np.repeat(begin, np.diff(np.append(begin, rows.num_rows)))
            sketches = _stack(rows.column("sketch"))
            close = (sketches == sketches[head]).sum(axis=1, dtype=np.int32) >= least * sketches.shape[1]
            # the carried member has been told already
            close[: 0 if first is None else 1] = False
            at = np.flatnonzero(close)
            digests = rows.column("digest")
            first = rows.slice(int(begin[-1]), 1)
            out = [rows.column("prefix").take(at), digests.take(at), digests.take(head[at])]
            yield from pa.table(out, names=["prefix", "a", "b"]).to_batches()

    return run


def _crossing(least: float):
    """Rows sorted by bucket and blocks: ties members of different sets so far that agree, as stars.

    Buckets are taken from the stream as they end, many at a time. Members of small ones are compared with the next one, the one after
    it and so on, over all buckets at once; a large one is compared as a matrix.
    """
    key = ["prefix", "one", "two"]

    def met(rows):
        begin = np.append(_starts(rows, key), rows.num_rows)
        group = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        size = np.diff(begin)[group]
        sketches = _stack(rows.column("sketch"))
        label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        block, across = rows.column("block").to_numpy(), rows.column("one").to_numpy() != rows.column("two").to_numpy()
        need, a, b = least * sketches.shape[1], [], []
        for lag in range(1, min(int(size.max()), SMALL_BUCKET)):
            i = np.flatnonzero((group[lag:] == group[:-lag]) & (label[lag:] != label[:-lag]) & (size[lag:] <= SMALL_BUCKET) & (~across[lag:] | (block[lag:] != block[:-lag])))
            for k in range(0, len(i), 65_536):
                j = i[k : k + 65_536]
                fine = j[(sketches[j] == sketches[j + lag]).sum(axis=1, dtype=np.int32) >= need]
                a.append(fine)
                b.append(fine + lag)
        for g in np.flatnonzero(np.diff(begin) > SMALL_BUCKET):
            rows_ = np.arange(begin[g], begin[g + 1])
            low = block[rows_] == rows.column("one")[int(begin[g])].as_py()
            first, second = (rows_[low], rows_[~low]) if across[begin[g]] else (rows_, rows_)
            apart = label[first][:, None] != label[second][None, :]
            own, other = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
            x, y = np.nonzero(_agree(sketches[first[own]], sketches[second[other]], least) & apart[np.ix_(own, other)])
            a.append(first[own[x]])
            b.append(second[other[y]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        low = _merged(rows.num_rows, a, b)
        tied = np.flatnonzero(low != np.arange(rows.num_rows))
        digests = rows.column("digest")
        ties = pa.table([digests.take(tied), digests.take(low[tied])], names=["a", "b"])
        return ties.to_batches()

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            last = int(_starts(rows, key)[-1])
            if last:
                yield from met(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from met(held)

    return run


def _sets(size: int):
    def make(column):
        found = [s.tobytes() for s in _each(column, size)]
        return [found, [len(x) // 8 for x in found]]

    return make


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared elements of every left and right set, by products of slices of their incidence matrices."""
    own = np.concatenate([np.repeat(np.arange(len(x)), [len(s) for s in x]) + k * len(left) for k, x in enumerate((left, right))])
    values, number, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    keep = count[number] > 1
    own, number = own[keep], (np.cumsum(count > 1) - 1)[number[keep]]
    order = np.argsort(number, kind="stable")
    own, number = own[order], number[order]
    out = np.zeros((len(left), len(right)), np.float32)
    top = int(number[-1]) + 1 if len(number) else 0
    for a in range(0, top, 4096):
        i, j = np.searchsorted(number, [a, a + 4096])
        m = np.zeros((len(left) + len(right), min(4096, top - a)), np.float32)
        m[own[i:j], number[i:j] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verify(threshold: float):
    """One block against another, or against itself: links per document, and the least member each one is joined to."""

    def run(rows):
        rows = rows.sort_by("digest")
        block, one, two = (rows.column(c).to_numpy() for c in ("block", "one", "two"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        first, second = (np.flatnonzero(block == c[0]) for c in (one, two))
        sizes = np.array([len(s) for s in sets], np.float64)
        shared = _overlaps([sets[i] for i in first], [sets[i] for i in second])
        linked = shared >= threshold * (sizes[first][:, None] + sizes[second][None, :] - shared) - 1e-6
        linked &= first[:, None] != second[None, :]
        weight = rows.column("copies").to_numpy().astype(np.int64)
        links = np.zeros(len(sets), np.int64)
        links[first] += linked @ weight[second]
        if one[0] != two[0]:
            links[second] += linked.T @ weight[first]
        a, b = np.nonzero(linked)
        label = _merged(len(sets), first[a], second[b])
        digests = rows.column("digest").combine_chunks()
        give_back()
        return pa.table([digests, pa.array(links), digests.take(pa.array(label))], names=["digest", "links", "low"])

    return run


def _trie(vertices: DataFrame, level: int, trees: int) -> DataFrame:
    """``(prefix, digest)`` of one level of all trees; equal prefixes are the buckets of the sorted tries at that level."""
    return vertices.select("digest", F.explode(F.slice("prefixes", level * trees + 1, trees)).alias("prefix"))


def _first_ties(vertices: DataFrame, trees: int, agree: float) -> DataFrame:
    """Ties at the longest prefixes, to the first member of each bucket: a row per member and bucket, whatever the bucket's size.

    A large bucket is dealt into parts that each have a first member; those meet once more.
    """
    trie = _trie(vertices, 0, trees)
    sizes = trie.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    salt = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int")
    members = trie.join(sizes, "prefix").select("prefix", "digest", salt.alias("salt"))

    def stars(rows):
        dealt = rows.join(vertices.select("digest", "sketch"), "digest").select("prefix", "salt", "digest", "sketch")
        return dealt.repartition("prefix", "salt").sortWithinPartitions("prefix", "salt", "digest").mapInArrow(_stars(agree), "prefix long, a binary, b binary")

    ties = materialize(stars(members), "jaccard-stars")
    large = sizes.filter(F.col("n") > BUCKET_ROWS).select("prefix")
    heads = ties.filter("a = b").join(large, "prefix").select("prefix", F.col("a").alias("digest"), F.lit(0).alias("salt"))
    return ties.unionByName(stars(heads)).filter("a <> b").select("a", "b")


def _later_ties(vertices: DataFrame, labels: DataFrame, level: int, trees: int, agree: float) -> DataFrame:
    """Ties at shorter prefixes: only buckets that hold members of several sets so far, and only pairs across sets, are looked at."""
    known = vertices.select("digest", "prefixes").join(labels, vertices["digest"] == labels["v"], "left")
    known = known.select("digest", F.coalesce("label", "digest").alias("label"), "prefixes")
    trie = known.select("digest", "label", F.explode(F.slice("prefixes", level * trees + 1, trees)).alias("prefix"))
    mixed_ = trie.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    mixed_ = mixed_.select("prefix", F.ceil(F.col("n") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    rows = trie.join(mixed_, "prefix").join(vertices.select("digest", "sketch"), "digest")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("prefix", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "digest", "label", "sketch")
    dealt = rows.repartition("prefix", "one", "two").sortWithinPartitions("prefix", "one", "two", "digest")
    return dealt.mapInArrow(_crossing(agree), "a binary, b binary")


def _sets_of(ties: DataFrame, name: str) -> DataFrame:
    """Connected sets of ties ``(a, b)``, where each ``a`` has few ``b``: ``(v, label)`` per vertex.

    A vertex passes its least neighbour on to its other ones, so only vertices that others are tied to, of which there are few, take
    part in the rounds; all others look their set up once.
    """
    near = materialize(ties.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b")).select("a", F.col("b")[0].alias("first"), F.slice("b", 2, 1 << 30).alias("more")), f"{name}-near")
    heads = near.select(F.explode(F.concat(F.array("first"), "more")).alias("v")).distinct()
    between = near.select(F.explode("more").alias("a"), F.col("first").alias("b"))
    own = near.join(heads, near["a"] == heads["v"], "left_semi").select("a", F.col("first").alias("b"))
    found = components(between.union(own).distinct(), name)
    top = heads.join(found, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
    top = materialize(top, f"{name}-heads")
    rest = near.join(heads, near["a"] == heads["v"], "left_anti").select("a", "first")
    return materialize(rest.join(top, rest["first"] == top["v"]).select(F.col("a").alias("v"), "label").union(top.select("v", "label")), f"{name}-sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, trees: int = 24, longest: int = 8, recall: float = 0.99999, detail: bool = False) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least ``threshold`` of their word shingles.

    Texts with equal shingle sets are one vertex, found by a digest. Every vertex stands in ``trees`` prefix tries of MinHash
    signatures, ``longest`` levels deep.

    1. At the longest prefixes a member of a bucket is tied to the bucket's first one, if their sketches agree.
    2. Prefixes are shortened to the depth at which a pair at the threshold is found with probability ``recall``. Buckets whose members
       are one set already are done. In the others pairs of different sets are compared by their sketches, block against
       block, and those that agree are tied. So texts that share a passage but little else meet in a bucket and stay apart.
    3. Within a connected set of ties all pairs are verified exactly, block against block in tasks of bounded size; a block
       returns link counts and one row per document, not its pairs.

    Sketches agree if 0.75 of the threshold of their bytes are equal, seven standard deviations below what a pair at the threshold
    shows, so they lose nothing that the prefixes find. Ties are stars, a row per member and bucket, so one group of any size is spread
    over many tasks.

    Returns per row: ``id_col``, ``class_id`` (the least id that chains of links reach) and ``n_links`` (other rows linked with
    it, copies included). Texts of fewer than ``shingle`` words are one shingle; texts without words (null, empty) link to
    nothing and are a class of their own. Rows with a null id link to nothing and have a null class. Repeated rows count as
    copies. Other columns are ignored, whatever their names. ``detail`` adds ``text_key``, the SHA-256 of the text, and
    ``class_key``, which names the class also where ids repeat (null without words or id).
    """
    depth = forest_depth(threshold, trees, longest, recall)
    agree = 0.75 * threshold
    levels = [longest, depth]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kept = rows.withColumn("text_key", F.sha2(F.col("_text").cast("binary"), 256)) if detail else rows
    made = [_FIELD("digest", T.BinaryType()), _FIELD("sketch", T.BinaryType()), _FIELD("prefixes", T.ArrayType(T.LongType()))]
    signed = materialize(map_text(kept, "_text", _signature(shingle, trees, levels), made), "jaccard-signatures")

    usable = signed.filter("digest is not null and _id is not null")
    vertices = usable.groupBy("digest").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("prefixes").alias("prefixes"))
    vertices = materialize(vertices, "jaccard-vertices")
    first = _sets_of(_first_ties(vertices, trees, agree), "jaccard-first")
    later = _later_ties(vertices, first, 1, trees, agree)
    groups = _sets_of(first.filter("v <> label").select(F.col("v").alias("a"), F.col("label").alias("b")).union(later), "jaccard-candidates")

    members = materialize(groups.join(vertices.drop("prefixes", "sketch"), groups["v"] == vertices["digest"]).select("digest", "label", "rep", "copies"), "jaccard-members")
    known = rows.join(checked_broadcast(members.withColumnRenamed("rep", "_id"), "8"), "_id")
    sets = map_text(known, "_text", lambda: _sets(shingle), [_FIELD("shingles", T.BinaryType()), _FIELD("n", T.LongType())])
    sets = sets.filter(F.unhex(F.md5("shingles")) == F.col("digest")).dropDuplicates(["digest"]).drop("_id")
    sets = materialize(sets, "jaccard-sets")
    sizes = sets.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = sets.join(checked_broadcast(sizes, "2"), "label").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "digest", "copies", "shingles")
    verified = dealt.groupBy("label", "one", "two").applyInArrow(_verify(threshold), "digest binary, links long, low binary")
    verified = materialize(verified, "jaccard-verified")

    joined = components(verified.filter("digest <> low").select(F.col("digest").alias("a"), F.col("low").alias("b")), "jaccard-classes")
    links = verified.groupBy("digest").agg(F.sum("links").alias("links"))
    found = vertices.select("digest", "rep", "copies").join(joined.select(F.col("v").alias("digest"), "label"), "digest", "left").join(links, "digest", "left")
    found = found.withColumn("label", F.coalesce("label", "digest"))
    least = found.groupBy("label").agg(F.min("rep").alias("class_id"))
    found = found.join(least, "label").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.hex("label").alias("class_key"))
    more = ["text_key"] if detail else []
    out = signed.select("_id", *more, F.when(F.col("_id").isNotNull(), F.col("digest")).alias("digest")).join(found, "digest", "left")
    more += ["class_key"] if detail else []
    return out.select(F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)
