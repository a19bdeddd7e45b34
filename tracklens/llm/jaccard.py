"""N-gram Jaccard join: which texts share enough word shingles, by prefix trees.

A text's set holds its distinct SHINGLE-word shingles as 64-bit hashes (a text of
fewer words has its whole sequence as one; without words, null or empty, the set
is empty and linked with nothing).  Two texts are linked when
100 * |A & B| >= PERCENT * |A | B|, with PERCENT 85 by default.  Hashes stand for shingles
and 128 bits for sets: what could be wrong is below one in 10**10 per pair.

Texts of equal sets form a class, and classes are joined:

1. Of each set in hash order the first n - ceil(P n) + l elements are kept, l = n/20.
   Linked sets share at least the smaller l of the two, which is 0.85 n/20 at
   least.  Elements that only one text keeps drop out; classes left with fewer than
   that have no link.  This removes most texts
   after shuffling a fifth of all shingles once for counts and once to join them.
2. Among the rest, each prefix is ordered by frequency, rarest first, and but one
   of as many elements are dropped from its end: linked sets still share an
   element.  The classes that share an element form its group; of groups with the
   same members one is kept, and groups with the same least member become one
   where that saves comparisons.
3. In PIVOT_ROUNDS rounds every group compares one member, its pivot, with the
   others; members already known to be connected are left out.  Pairs are first
   compared on their prefixes: below the smaller of the prefixes' last hashes both
   sets are known in full, so elements of one that the other lacks there count
   against the differences that linked sets may have.  What passes is compared on
   whole sets.
4. Groups that still hold several components compare all members outside the
   largest component with all members on whole sets, in blocks of bounded size.

A block's sets are stored in a trie, ordered by frequency within the block, so
that near copies share long paths.  A probe walks the trie once, carrying the
overlap so far; a subtree is pruned when what remains of the probe and of the
subtree's sets cannot reach the threshold.  A link within a known component
isn't needed, so blocks report spanning links only.  From step 2 on, 64 bits of
its hash name a class.

No group is gathered in one task: counts are combined before they are shuffled,
joins on an element have the other side unique and deal hot elements by (element, salt), and
work on groups is dealt by (group, block) over all shuffle partitions.

Null ids are allowed; rows that repeat an id are classified each by its own text;
columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import few_files, gathered, maybe_broadcast, partitions, small_batches, written

SHINGLE = 4
PERCENT = 85
PIVOT_ROUNDS = 1
#: Sets, and elements, in a block.
BLOCK_SETS = 1024
BLOCK_ELEMENTS = 1_000_000
#: An element with more rows than this, and than a millionth of all, is dealt to several tasks.
HOT_ROWS = 1024

_U = np.uint64
_WEIGHTS = wordhash.mix(np.arange(11, 11 + 64, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for _, n, words, first in wordhash.batch_words(texts):
        grams = np.zeros(max(0, len(words) - size + 1), _U)
        for k in range(size):
            grams += words[k : k + len(grams)] * _WEIGHTS[k]
        grams = wordhash.mix(grams)
        for row in range(n):
            a, b = int(first[row]), int(first[row + 1])
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:
                whole = (words[a:b] * _WEIGHTS[size : size + b - a]).sum(dtype=_U) + _U(b - a)
                yield wordhash.mix(np.array([whole], dtype=_U))
            else:
                yield np.zeros(0, _U)


def set_key(elements: np.ndarray) -> bytes:
    """128 bits for a set."""
    a = wordhash.mix(elements ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U)
    b = wordhash.mix(elements + _U(0x0123456789ABCDEF)).sum(dtype=_U) ^ _U(len(elements))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _least(n: int, percent: int) -> int:
    """ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _sets(docs: DataFrame, size: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, key, cid and elements: the prefix, or all if ``whole``."""
    small_batches(docs.sparkSession)

    def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, keys, kept = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n = len(s)
                counts.append(n)
                keys.append(set_key(s) if n else None)
                kept.append(s if whole else s[: n - _least(n, percent) + max(1, n // 20)])
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in kept])))
            values = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            elements = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values))
            cids = [None if k is None else int.from_bytes(k[:8], "big", signed=True) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(cids, pa.int64()), elements], names=["doc_id", "n", "key", "cid", "elements"])

    return docs.mapInArrow(batches, f"doc_id {docs.schema[0].dataType.simpleString()}, n bigint, key binary, cid bigint, elements array<bigint>")


class _Node:
    __slots__ = ("children", "end", "largest", "of", "sets", "smallest", "start")

    def __init__(self, start: int, end: int, of: int) -> None:
        self.start, self.end, self.of = start, end, of
        self.children: list[_Node] = []
        self.sets: list[int] = []
        self.smallest = self.largest = 0


class Trie:
    """Sets as paths of elements, the most frequent first; edges are runs of elements."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.elements, inverse, counts = np.unique(np.concatenate(sets) if sets else np.zeros(0, _U), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.elements, -counts))] = np.arange(len(counts))
        self.rank = rank
        edges = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(int)
        paths = [np.sort(rank[inverse[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i4").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.root = _Node(0, 0, 0)
        stack = [self.root]
        previous = np.zeros(0, np.int64)
        for i, path in enumerate(self.paths):
            m = min(len(path), len(previous))
            apart = np.flatnonzero(path[:m] != previous[:m])
            shared = int(apart[0]) if len(apart) else m
            last = None
            while stack[-1].end > shared:
                last = stack.pop()
            if stack[-1].end < shared:
                middle = _Node(stack[-1].end, shared, last.of)
                middle.children.append(last)
                last.start = shared
                stack[-1].children[-1] = middle
                stack.append(middle)
            if len(path) > shared:
                leaf = _Node(shared, len(path), i)
                stack[-1].children.append(leaf)
                stack.append(leaf)
            stack[-1].sets.append(i)
            previous = path
        self._sizes()

    def _sizes(self) -> None:
        todo, seen = [self.root], []
        while todo:
            node = todo.pop()
            seen.append(node)
            todo += node.children
        for node in reversed(seen):
            sizes = [node.end] * bool(node.sets) + [x for c in node.children for x in (c.smallest, c.largest)]
            node.smallest, node.largest = min(sizes, default=0), max(sizes, default=0)

    def similar(self, probe: np.ndarray, percent: int) -> list[int]:
        """Numbers of the stored sets that are linked with the probe."""
        n, out = len(probe), []
        at = np.searchsorted(self.elements, probe)
        at[at == len(self.elements)] = 0
        known = np.sort(self.rank[at[self.elements[at] == probe]]) if len(self.elements) else np.zeros(0, np.int64)
        member = np.zeros(len(self.elements) + 1, bool)
        member[known] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            for child in node.children:
                run = self.paths[child.of][child.start : child.end]
                common = overlap + int(member[run].sum())
                left = len(known) - int(np.searchsorted(known, run[-1], "right"))
                depth = child.end
                size = min(max(depth + left, child.smallest), child.largest)
                if (100 + percent) * (common + min(size - depth, left)) < percent * (n + size):
                    continue
                if child.sets and (100 + percent) * common >= percent * (n + depth):
                    out += [self.order[i] for i in child.sets]
                stack.append((child, common))
        return out


def _linked(units: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning links of one block: probes against stored sets."""
    sets = [np.array(x, dtype=np.int64).view(_U) for x in units["elements"]]
    keys, labels, probe = units["key"].tolist(), units["label"].tolist(), units["probe"].to_numpy(bool)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := parent.get(x, x)) != x:
            parent[x] = parent.get(above, above)
            x = above
        return x

    stored = np.flatnonzero(~probe)
    trie = Trie([sets[i] for i in stored])
    out = []
    for i in np.flatnonzero(probe):
        for j in trie.similar(sets[i], percent):
            k = stored[j]
            a, b = find(labels[i]), find(labels[k])
            if a != b:
                parent[a] = b
                out.append((keys[i], keys[k]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _alike(units: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The pairs of one block, of probes and stored sets of different components,
    whose prefixes allow a link."""
    prefixes = [np.array(x, dtype=np.int64).view(_U) for x in units["elements"]]
    keys, labels, sizes, probe = units["key"].to_numpy(), units["label"].to_numpy(), units["n"].to_numpy(), units["probe"].to_numpy(bool)
    stored, out = np.flatnonzero(~probe), []
    if len(stored):
        elements, inverse = np.unique(np.concatenate([prefixes[k] for k in stored]), return_inverse=True)
        counts = np.array([len(prefixes[k]) for k in stored])
        owner = np.repeat(np.arange(len(stored)), counts)
        last = np.array([prefixes[k][-1] for k in stored], dtype=_U)
    for i in np.flatnonzero(probe) if len(stored) else ():
        mine = prefixes[i]
        member = np.zeros(len(elements), bool)
        at = np.searchsorted(elements, mine)
        at[at == len(elements)] = 0
        member[at[elements[at] == mine]] = True
        hit = owner[member[inverse]]
        common = np.bincount(hit, minlength=len(stored))
        upto = np.minimum(last, mine[-1])
        ours = np.searchsorted(mine, upto, "right")
        theirs = np.array([c if x <= mine[-1] else np.searchsorted(prefixes[k], mine[-1], "right") for c, x, k in zip(counts, last, stored, strict=True)])
        both = sizes[i] + sizes[stored]
        least = -(-percent * both // (100 + percent))
        fits = (common > 0) & (ours - common <= sizes[i] - least) & (theirs - common <= sizes[stored] - least) & (labels[stored] != labels[i]) & (least <= np.minimum(sizes[i], sizes[stored]))
        out += [(keys[i], labels[i], sizes[i], keys[k], labels[k], sizes[k]) for k in stored[fits]]
    return pd.DataFrame(out, columns=["pivot", "pivot_label", "pivot_n", "key", "label", "n"], dtype="int64")


_PAIR = "pivot bigint, pivot_label bigint, pivot_n bigint, key bigint, label bigint, n bigint"


def _in_units(units: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The units' rows, dealt by unit over all shuffle partitions; units are written, so counted cheaply."""
    return rows.join(maybe_broadcast(units, 96), "key").select(*columns).repartition(partitions(rows.sparkSession), "unit")


def _candidates(units: DataFrame, prefixes: DataFrame, percent: int, rows_about: int) -> DataFrame:
    """Pairs that prefixes allow; units has unit, probe, key and label."""
    rows = _in_units(units, prefixes, ["unit", "probe", "key", "label", "n", "elements"])
    pairs = rows.groupBy("unit").applyInPandas(lambda df: _alike(df, percent), _PAIR).distinct()
    return written(few_files(pairs, rows_about, 20_000), "candidates")


def _verified(units: DataFrame, sets: DataFrame, percent: int, rows_about: int) -> DataFrame:
    """Spanning links within each unit."""
    rows = _in_units(units, sets, ["unit", "probe", "key", "label", "elements"])
    links = rows.groupBy("unit").applyInPandas(lambda df: _linked(df, percent), "a bigint, b bigint")
    return written(gathered(links, rows_about), "links")


def _hot(rows: DataFrame, n: int) -> DataFrame | None:
    """(token, salts): the tokens of more than HOT_ROWS and a millionth of the n rows,
    a million at most, and into how many parts to deal them; None if there are none."""
    most = max(HOT_ROWS, n // 1_000_000)
    counted = rows.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > most)
    hot = written(counted.select("token", F.ceil(F.col("c") / most).alias("salts")).coalesce(1), "hot")
    return None if hot.isEmpty() else F.broadcast(hot)


def _by_token(rows: DataFrame, unique: DataFrame, hot: DataFrame | None, how: str = "inner", spread: str = "key") -> DataFrame:
    """rows joined with what is known of each token; the rows of a hot one go to several tasks."""
    if hot is None:
        return rows.join(unique, "token", how)
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    left = rows.join(hot, "token", "left").withColumn("__salt", F.pmod(F.xxhash64(spread), salts)).drop("salts")
    right = unique.join(hot, "token", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
    return left.join(right, ["token", "__salt"], how).drop("__salt")


def connected(edges: DataFrame) -> DataFrame:
    """(key, label): the least key of each node's component, from edges (a, b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(few_files(both, 2 * edges.count()), "edges")
    n = both.count()
    first = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("key"), F.least("a", "low").alias("label"))
    labels = written(few_files(first, n), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["key"] == near["a"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("key").alias("via"), F.col("label").alias("far"))
        after = lower.join(jump, "via", "left").select("key", "old", F.least("via", "far").alias("label"))
        after = written(few_files(after, n), "labels")
        labels = after.select("key", "label")
        if after.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the known component of their key."""
    members = members.select("token", "key", "n")
    if labels is None:
        return members.withColumn("label", F.col("key"))
    return members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _blocks(count: Column, elements: Column) -> Column:
    return F.greatest(F.ceil(count / BLOCK_SETS), F.ceil(elements / BLOCK_ELEMENTS), F.lit(1)).cast("int")


def _pair_units(pairs: DataFrame, rows_about: int) -> DataFrame:
    """Blocks that hold each pivot as a probe and its partners as stored sets."""
    pairs = pairs.withColumnRenamed("pivot", "token")
    sizes = pairs.groupBy("token").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    dealt = _by_token(pairs, sizes, _hot(pairs, rows_about)).withColumn("unit", F.concat_ws(":", "token", F.pmod(F.xxhash64("key"), F.col("blocks"))))
    stored = dealt.select("unit", F.lit(False).alias("probe"), "key", "label")
    return stored.unionByName(dealt.select("unit", F.lit(True).alias("probe"), F.col("token").alias("key"), F.col("pivot_label").alias("label")).distinct())


def _pivot_pairs(members: DataFrame, hot: DataFrame | None, percent: int, rows_about: int) -> tuple[DataFrame, DataFrame]:
    """Each group's pivot with the others, every pair once, and what is left of the groups."""
    pivots = members.groupBy("token").agg(F.min(F.struct("key", "label", "n")).alias("p"))
    with_pivot = _by_token(members, pivots, hot)
    pairs = with_pivot.where((F.col("label") != F.col("p.label")) & (F.col("key") != F.col("p.key")))
    n, m = F.col("n"), F.col("p.n")
    pairs = pairs.where(100 * F.least(n, m) >= percent * F.greatest(n, m))
    pairs = pairs.select(F.col("p.key").alias("pivot"), F.col("p.label").alias("pivot_label"), F.col("p.n").alias("pivot_n"), "key", "label", "n").distinct()
    pairs = written(few_files(pairs, rows_about), "pairs")
    left = with_pivot.where(F.col("key") != F.col("p.key")).select("token", "key", "n")
    return pairs, left


def _distinct_groups(members: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Members of groups that hold several components, of groups with the same members one."""
    sums = [F.sum(F.xxhash64("key", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]
    groups = members.groupBy("token").agg(F.count("*").alias("c"), *sums, F.min("label").alias("low"), F.max("label").alias("high"))
    kept = groups.where("low <> high").groupBy("c", "h0", "h1").agg(F.min("token").alias("token")).select("token")
    return _by_token(members, kept, hot, "left_semi")


def _merged_groups(members: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Groups of one least member become one, where comparing its members costs no
    more than comparing those of each group: near copies share many elements, and
    so would meet again and again."""
    members = members.select("token", "key", "n", "label")
    groups = members.groupBy("token").agg(F.count("*").alias("c"), F.min("key").alias("pivot"))
    apart = groups.groupBy("pivot").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("apart"), F.count("*").alias("n_groups")).where("n_groups > 1")
    met = _by_token(members, groups.select("token", "pivot"), hot).select("pivot", "key").distinct().groupBy("pivot").agg(F.count("*").alias("u"))
    cheaper = apart.join(met, "pivot").where("u * u <= apart").select("pivot")
    renamed = groups.select("token", "pivot").join(cheaper, "pivot").select("token", F.xxhash64("pivot", F.lit("merged")).alias("merged"))
    named = _by_token(members, renamed, hot, "left").select(F.coalesce("merged", "token").alias("token"), F.col("merged").isNotNull().alias("m"), "key", "n", "label")
    return named.where("not m").unionByName(named.where("m").distinct()).drop("m")


def _rest_units(members: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Blocks that hold all members outside a group's largest component against all members."""
    largest = members.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("largest"))
    outside = F.col("label") != F.col("largest")
    sizes = _by_token(members, largest, hot).groupBy("token", "largest").agg(
        _blocks(F.count("*"), F.sum("n")).alias("stored_blocks"), _blocks(F.count_if(outside), F.sum(F.when(outside, F.col("n")).otherwise(0))).alias("probe_blocks")
    )
    marked = _by_token(members, sizes, hot).withColumn("outside", outside)
    spot = F.xxhash64("key")
    stored = marked.withColumn("s", F.pmod(spot, F.col("stored_blocks"))).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)))
    probes = marked.where("outside").withColumn("p", F.pmod(spot, F.col("probe_blocks"))).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("stored_blocks") - 1)))
    unit = F.concat_ws(":", F.col("token"), F.col("s"), F.col("p"))
    return stored.select(unit.alias("unit"), F.lit(False).alias("probe"), "key", "label").unionByName(probes.select(unit.alias("unit"), F.lit(True).alias("probe"), "key", "label"))


def _groups(docs: DataFrame, found: DataFrame, classes: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (token, key, n) of candidate groups, and the prefixes and whole sets of their keys."""
    shared = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 2000))
    rows = found.where("n > 0").select("cid", F.explode("elements").alias("token"))
    # Hot tokens are counted where all rows are counted anyway.
    counted = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    repeated = written(counted, "repeated")
    n_rows = repeated.agg(F.sum("c")).first()[0] or 0
    most = max(HOT_ROWS, n_rows // 1_000_000)
    hot = written(repeated.where(F.col("c") > most).select("token", F.ceil(F.col("c") / most).alias("salts")).coalesce(1), "hot")
    hot = None if hot.isEmpty() else F.broadcast(hot)
    hits = _by_token(rows, repeated.select("token"), hot, "left_semi", "cid").groupBy("cid").agg(F.count("*").alias("hits"))
    n_classes = classes.count()
    alive = classes.join(hits, "cid").where(F.col("hits") >= shared * F.col("copies")).select("key", "rep")
    alive = written(few_files(alive, n_classes), "alive")

    known = maybe_broadcast(alive, 64)
    one = found.join(known, "key").where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["key"]).select(F.col("cid").alias("key"), "rep", "n", "elements")
    one = written(few_files(one, n_classes, 10_000), "prefixes")
    rows = one.select("key", "n", F.explode("elements").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df"))
    ordered = _by_token(rows, counts, hot).groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
    first = F.slice("all", F.lit(1), (F.size("all") - shared + 1).cast("int"))
    members = ordered.select("key", "n", F.explode(first).alias("e")).where("e.df > 1").select(F.col("e.token").alias("token"), "key", "n")
    members = written(members, "members")
    members = written(few_files(_distinct_groups(_labelled(members, None), hot), members.count()), "members")
    members = written(few_files(_merged_groups(members, hot), members.count()), "members")

    wanted = members.select("key").distinct()
    ids = maybe_broadcast(written(few_files(wanted.join(one.select("key", "rep"), "key").select("rep").distinct(), members.count()), "wanted"), 16)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")
    # Rows that repeat an id may come along; they are looked up by key only.
    sets = written(_sets(texts, size, percent, whole=True).where("n > 0").select(F.col("cid").alias("key"), "elements"), "sets")
    prefixes = one.select("key", "n", "elements").join(maybe_broadcast(wanted, 16), "key", "left_semi")
    return members, written(few_files(prefixes, n_classes, 10_000), "prefixes"), sets


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the least doc_id that
    links reach, its own included (null ids are passed over).  Repeated rows stay.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = written(_sets(docs, size, percent, whole=False), "prefixes")
    classes = found.where("n > 0").groupBy("key").agg(F.min("cid").alias("cid"), F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(few_files(classes, found.count()), "classes")
    members, prefixes, sets = _groups(docs, found, classes, size, percent)

    links, labels = None, None
    left, n = members, members.count()
    for k in range(PIVOT_ROUNDS + 1):
        if left.isEmpty():
            break
        hot = _hot(left, n)
        if k < PIVOT_ROUNDS:
            pairs, left = _pivot_pairs(left, hot, percent, n)
            first = written(few_files(_pair_units(pairs, n), n), "units")
            units = written(few_files(_pair_units(_candidates(first, prefixes, percent, n), n), n), "units")
        else:
            rest = written(few_files(_merged_groups(left, hot), n), "rest")
            units = written(few_files(_rest_units(rest, _hot(rest, n)), n), "units")
        new = _verified(units, sets, percent, n)
        links = new if links is None else links.unionByName(new)
        labels = connected(links)
        if k < PIVOT_ROUNDS:
            left = written(few_files(_distinct_groups(_labelled(left, labels), hot), n), "open")

    if labels is None:
        of_class = classes.select("key", F.col("rep").alias("component"))
    else:
        named = labels.withColumnRenamed("key", "cid")
        rooted = classes.select("key", "cid", "rep").join(named, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        roots = rooted.groupBy("label").agg(F.min("rep").alias("component"))
        of_class = rooted.join(roots, "label").select("key", "component")
    out = found.select("doc_id", "n", "key").join(of_class, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
