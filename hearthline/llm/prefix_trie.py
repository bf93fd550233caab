"""Texts whose word n-grams overlap, joined over prefix trees of globally ordered n-gram sets.

A text's set is its distinct word n-grams, as 64-bit hashes; equal sets are one class. All n-grams have one order: first
a quarter of them, chosen by hash, from the rarest to the most common (frequencies in steps), then the others by hash. Two
sets that link share an n-gram within their prefixes in this order, whatever the order is, where the prefix of a set is
the part that could be missing from its partner, and one more. N-grams of the quarter that match nothing come first, as
one class alone holds them or two whose sizes rule out a link, so a class whose prefix is made of them is done; only the
other classes ("open" ones) are read again in full.

Open classes that share a prefix n-gram meet in blocks of bounded size. One block is a trie of its ordered sets. The sets
of the other go down the trie level by level, all at once: an overlap counted on a path is shared by all sets below it,
and a subtree is left when the overlap so far and what can still match, on the shorter of both remainders, fall short of
what the smallest set below needs. Where a path ends the overlap is exact, and so is the test of a link.

Groups are first merged under their hubs: the hub of an n-gram is the one of its classes that stands in most groups, and
all classes that share an n-gram with the same hub are one group, so a class is sent to a few hubs and not once for each
n-gram. Two rounds keep groups of copies linear: each class meets one hub, linked classes become components, and groups
that then hold more than one component are joined again without pairs inside the largest one.
Only components are returned, so pairs within a component need no test. Nothing is collected but a filter of at most 32 MB
that spares the reading of texts; frequencies, groups and components are partial aggregates and joins.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and form their own component; a
text with fewer words than an n-gram has its whole sequence as one; repeated rows share a class; rows that share a
doc_id are judged each by its own text; a component without any doc_id has none; long texts are read whole; an empty
table gives an empty table; columns other than doc_id and text are not read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm import near_copies
from hearthline.llm.common import columns_only, materialise, mix, release, shingle_sets
from hearthline.llm.near_copies import components

#: Hashes and sets of a block, about; tokens of a trie node; (set, token) cells held at a time.
BLOCK, BLOCK_SETS, NODE, CELLS = 96_000, 400, 32, 1 << 23
#: N-grams whose hash has these top bits clear are counted: a quarter.
COUNTED_BITS = 2
#: Steps of frequency, two for each doubling, and the level of n-grams that are not counted.
TOP_LEVEL = 63
#: Bits of the filter of texts to read again.
FILTER_BITS = 28

_U = np.uint64


def counted(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - COUNTED_BITS)) == 0


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each set, 0 for empty ones."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(hashes + _U(11)), bounds[:-1][full]))
    return out


def class_rows(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, counted, f) of each row: sizes of the set and of its counted part, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for first, end, hashes, bounds in shingle_sets(batch.column(1), size):
                part = np.concatenate([[0], np.cumsum(counted(hashes))])
                columns = [batch.column(0).slice(first, end - first), pa.array(np.diff(bounds)), pa.array(np.diff(part[bounds])), pa.array(fingerprints(hashes, bounds).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "counted", "f"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, counted bigint, f bigint")


def counted_ngrams(docs: DataFrame, size: int, remembered: int = 1 << 20) -> DataFrame:
    """(f, n, token) of the counted n-grams, once for equal sets that follow each other within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[int] = set()
        for batch in batches:
            for _, _, hashes, bounds in shingle_sets(batch.column(0), size):
                f, n = fingerprints(hashes, bounds), np.diff(bounds)
                new = np.zeros(len(f), dtype=bool)
                for i, value in enumerate(f.tolist()):
                    if value not in seen:
                        new[i] = True
                        seen.add(value)
                if len(seen) > remembered:
                    seen.clear()
                keep = counted(hashes) & np.repeat(new, n)
                columns = [np.repeat(f, n)[keep].view(np.int64), np.repeat(n, n)[keep].astype(np.int32), hashes[keep].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["f", "n", "token"])

    return columns_only(docs, "text").mapInArrow(run, "f bigint, n int, token bigint")


def prefix_length(n: Column, percent: int) -> Column:
    """What can be missing from a partner's set, and one."""
    return n - F.ceil(n * percent / F.lit(100)) + 1


def open_classes(docs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(f, head, n, take, known): classes that may have a partner, the smallest doc_id of each, how many of its n-grams after
    those that match nothing are in its prefix, and its counted n-grams that may match, with their frequencies.

    Of an n-gram with two holders, the smallest and the largest size are theirs, and tell whether they could link."""
    tokens = counted_ngrams(docs, size)
    holders = tokens.groupBy("token").agg(F.count("*").alias("held"), F.min("f").alias("low"), F.max("f").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    several = holders.where((F.col("low") < F.col("high")) & ((F.col("held") > 2) | (F.col("least") * 100 >= F.col("most") * percent)))
    several = materialise(several.select("token", "held"))
    known = tokens.select("f", "token").join(several, "token").groupBy("f").agg(F.collect_set(F.struct("token", "held")).alias("known"))
    classes = rows.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("head"), F.min("n").alias("n"), F.min("counted").alias("counted"))
    alone = F.col("counted") - F.coalesce(F.size("known"), F.lit(0))
    both = classes.join(known, "f", "left").withColumn("take", prefix_length(F.col("n"), percent) - alone)
    return materialise(both.where("take > 0").select("f", "head", "n", "take", "known"))


def bit_of(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def filter_words(keys: DataFrame, name: str) -> np.ndarray:
    """A one-hash Bloom filter of a column as 64-bit words; at most 2 ** (FILTER_BITS - 6) rows reach the driver."""
    bit = keys.select(bit_of(F.col(name)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def ordered_sets(docs: DataFrame, opened: DataFrame, size: int) -> DataFrame:
    """(f, n, take, keys): the n-grams of each open class that may match, as keys that ascend in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_words(opened, "head"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        words = shared.value
        for batch in batches:
            bit = batch.column(0).to_numpy()
            for _, _, hashes, bounds in shingle_sets(batch.column(1).filter(pa.array((words[bit >> 6] >> (bit & 63) & 1) == 1)), size):
                sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(hashes, bounds).view(np.int64)), sets], names=["f", "hashes"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            hashes, known = batch.column(3), batch.column(4)
            parts = []
            for i in range(len(batch)):
                every = hashes.slice(i, 1).flatten().to_numpy().view(np.uint64)
                pairs = known.slice(i, 1).flatten()
                parts.append(order_keys(every, pairs.field(0).to_numpy().view(np.uint64), pairs.field(1).to_numpy()))
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            keys = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), keys], names=["f", "n", "take", "keys"])

    full = docs.select(bit_of(F.col("doc_id")).alias("bit"), "text").mapInArrow(read, "f bigint, hashes array<bigint>")
    both = full.join(opened.select("f", "n", "take", "known"), "f").select("f", "n", "take", "hashes", "known")
    return materialise(both.mapInArrow(order, "f bigint, n bigint, take bigint, keys array<bigint>").dropDuplicates(["f"]))


def order_keys(hashes: np.ndarray, tokens: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sorted keys of the n-grams that may match: six bits of frequency level, then the hash. Counted n-grams that are not
    among `tokens` match nothing and are left out."""
    levels = np.minimum(np.floor(2 * np.log2(np.maximum(held, 1))).astype(np.uint64), _U(TOP_LEVEL - 1))
    rest = hashes[~counted(hashes)]
    return np.sort(np.concatenate([levels << _U(58) | tokens >> _U(6 - COUNTED_BITS) & _U((1 << 58) - 1), _U(TOP_LEVEL) << _U(58) | rest >> _U(6)]))


class Trie:
    """A path-compressed trie of sorted sets; edges are cut into nodes of at most NODE tokens."""

    def __init__(self, keys: np.ndarray, bounds: np.ndarray, n: np.ndarray) -> None:
        self.n = n
        self.vocabulary, self.tokens = np.unique(keys, return_inverse=True)
        big = self.tokens.astype(">u4").tobytes()
        order = sorted(range(len(n)), key=lambda i: big[4 * bounds[i] : 4 * bounds[i + 1]])
        self.sets, self.length = np.array(order), np.diff(bounds)[order]
        self.starts = bounds[:-1][order]
        shared = [0]
        for i in range(1, len(order)):
            k = min(self.length[i - 1], self.length[i])
            a, b = self.starts[i - 1], self.starts[i]
            apart = np.flatnonzero(self.tokens[a : a + k] != self.tokens[b : b + k])
            shared.append(int(apart[0]) if len(apart) else int(k))
        self.shared = np.array(shared)
        self.first: list[int] = []  # first token of a node, as a place in `tokens`, and the number of its tokens
        self.size: list[int] = []
        self.below: list[tuple[int, int]] = []  # smallest n of the sets below, and the most tokens one still has
        self.ends: dict[int, tuple[int, int]] = {}  # sets that end at a node, as a run of the order
        self.children: list[list[int]] = []
        self.roots = self._grow()
        self.first_of, self.size_of = np.array(self.first), np.array(self.size)
        self.least, self.left = (np.array(x) for x in zip(*self.below, strict=True))
        self.child_count = np.array([len(c) for c in self.children])
        self.child_start = np.cumsum(self.child_count) - self.child_count
        self.child = np.array([c for cs in self.children for c in cs], dtype=np.int64)
        self.end_low, self.end_high = np.zeros((2, len(self.first)), dtype=np.int64)
        for node, (low, high) in self.ends.items():
            self.end_low[node], self.end_high[node] = low, high

    def _node(self, low: int, high: int, depth: int, size: int) -> int:
        self.first.append(int(self.starts[low]) + depth)
        self.size.append(size)
        self.below.append((int(self.n[self.sets[low:high]].min()), int(self.length[low:high].max()) - depth - size))
        self.children.append([])
        return len(self.first) - 1

    def _grow(self) -> list[int]:
        """Splits runs of the sorted sets where their common prefix ends; without recursion."""
        roots: list[int] = []
        waiting = [(0, len(self.sets), 0, roots)]
        while waiting:
            low, high, depth, siblings = waiting.pop()
            reach = int(self.shared[low + 1 : high].min()) if high - low > 1 else int(self.length[low])
            if reach > depth:
                node = self._node(low, high, depth, min(NODE, reach - depth))
                siblings.append(node)
                while (at := depth + self.size[node]) < reach:
                    depth = at
                    deeper = self._node(low, high, depth, min(NODE, reach - depth))
                    self.children[node].append(deeper)
                    node = deeper
                done = low
                while done < high and self.length[done] == reach:
                    done += 1
                if done > low:
                    self.ends[node] = (low, done)
                low = done
                siblings = self.children[node]
            if low < high:
                cuts = [low, *(low + 1 + np.flatnonzero(self.shared[low + 1 : high] == reach)).tolist(), high]
                waiting += [(a, b, reach, siblings) for a, b in zip(cuts, cuts[1:], strict=False)]
        return roots

    def links(self, keys: np.ndarray, bounds: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of a probe, place of a set of the trie) of all links with the given ordered sets."""
        fits = (n * 100 >= self.n.min() * percent) & (self.n.max() * 100 >= n * percent)
        most, found = max(1, CELLS // len(self.vocabulary)), []
        for a in range(0, len(n), most):
            part = slice(a, min(a + most, len(n)))
            if fits[part].any():
                x, y = self._links(keys[bounds[part.start] : bounds[part.stop]], bounds[part.start : part.stop + 1] - bounds[part.start], n[part], np.flatnonzero(fits[part]), percent)
                found.append((x + a, y))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _links(self, keys: np.ndarray, bounds: np.ndarray, n: np.ndarray, fits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        has = np.zeros((len(n), len(self.vocabulary)), dtype=np.uint8)
        owner = np.repeat(np.arange(len(n)), np.diff(bounds))
        at = np.minimum(np.searchsorted(self.vocabulary, keys), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == keys
        has[owner[hit], at[hit]] = 1
        upto = np.cumsum(has, axis=1, dtype=np.int32)
        probe, node = np.repeat(fits, len(self.roots)), np.tile(np.array(self.roots, dtype=np.int64), len(fits))
        overlap = np.zeros(len(probe), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(probe):
            overlap = overlap + self._matches(has, probe, node)
            last = self.tokens[self.first_of[node] + self.size_of[node] - 1]
            rest = upto[probe, -1] - upto[probe, last]
            most = overlap + np.minimum(rest, self.left[node])
            keep = most * (100 + percent) >= (n[probe] + self.least[node]) * percent
            probe, node, overlap = probe[keep], node[keep], overlap[keep]
            ending = self.end_high[node] - self.end_low[node]
            who = np.repeat(np.arange(len(node)), ending)
            place = self.sets[self.end_low[node][who] + np.arange(len(who)) - np.repeat(np.cumsum(ending) - ending, ending)]
            linked = overlap[who] * (100 + percent) >= (n[probe[who]] + self.n[place]) * percent
            found.append((probe[who][linked], place[linked]))
            many = self.child_count[node]
            who = np.repeat(np.arange(len(node)), many)
            below = self.child[self.child_start[node][who] + np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)] if len(who) else np.zeros(0, dtype=np.int64)
            probe, node, overlap = probe[who], below, overlap[who]
        return np.concatenate([p for p, _ in found]), np.concatenate([s for _, s in found])

    def _matches(self, has: np.ndarray, probe: np.ndarray, node: np.ndarray) -> np.ndarray:
        """How many tokens of each node its probe holds."""
        out = np.zeros(len(probe), dtype=np.int64)
        for a in range(0, len(probe), CELLS // NODE):
            p, v = probe[a : a + CELLS // NODE], node[a : a + CELLS // NODE]
            size = self.size_of[v]
            starts = np.cumsum(size) - size
            place = np.repeat(self.first_of[v] - starts, size) + np.arange(int(size.sum()))
            out[a : a + len(p)] = np.add.reduceat(has[np.repeat(p, size), self.tokens[place]], starts, dtype=np.int64)
        return out


def forest(edges: list[list[int]]) -> list[list[int]]:
    """As few of the edges as join the same nodes."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    out = []
    for edge in edges:
        a, b = map(top, edge)
        if a != b:
            above[a] = b
            out.append(edge)
    return out


def joined(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (ca, cb) between components, as many as it takes to join them, from pairs of blocks (one, other), each an array
    of (f, component, n, keys)."""

    def unpack(column: pa.Array, i: int) -> tuple[np.ndarray, ...]:
        block = column.slice(i, 1).flatten()
        keys = block.field(3)
        return block.field(1).to_numpy(), block.field(2).to_numpy(), keys.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(len(batch)):
                ca, na, ka, ba = unpack(batch.column(0), i)
                cb, nb, kb, bb = unpack(batch.column(1), i)
                x, y = Trie(kb, bb, nb).links(ka, ba, na, percent)
                across = forest(np.unique(np.stack([ca[x], cb[y]])[:, ca[x] != cb[y]], axis=1).T.tolist())
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in across], pa.int64()) for k in range(2)], names=["ca", "cb"])

    return pairs.select("one", "other").mapInArrow(run, "ca bigint, cb bigint").distinct()


def chunk_of(f: Column, hashes: Column, sets: Column) -> Column:
    """The block of a set within a group with that many hashes and sets."""
    return F.pmod(F.xxhash64(f), F.greatest(F.ceil(hashes / F.lit(BLOCK)), F.ceil(sets / F.lit(BLOCK_SETS)))).cast("int")


def entry() -> Column:
    return F.struct("f", "component", "n", "keys")


def hub_groups(prefixes: DataFrame) -> DataFrame:
    """(hub, f, n): classes that share an n-gram of their prefixes with a hub. Classes that share one meet under its hub.
    prefixes: (f, n, key), one row for each n-gram of a prefix."""
    crowds = prefixes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    members = materialise(prefixes.join(crowds, "key"))
    degrees = members.groupBy("f").agg(F.count("*").alias("degree"))
    hubs = members.join(degrees, "f").groupBy("key").agg(F.max_by("f", F.struct("degree", "f")).alias("hub"))
    return materialise(members.join(hubs, "key").select("hub", "f", "n").distinct())


def hub_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each class with the hub of its largest group."""
    groups = members.groupBy("hub").agg(F.count("*").alias("k"))
    stars = members.join(groups, "hub").where("hub <> f").groupBy("f").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub"))
    followers = sets.join(stars, "f")
    totals = followers.groupBy("hub").agg(F.count("*").alias("k"), F.sum(F.size("keys")).alias("hashes"))
    placed = followers.join(totals, "hub").withColumn("chunk", chunk_of(F.col("f"), F.col("hashes"), F.col("k"))).withColumn("component", F.col("f"))
    blocks = placed.groupBy("hub", "chunk").agg(F.collect_list(entry()).alias("other"))
    heads = sets.withColumn("component", F.col("f")).select(F.col("f").alias("hub"), F.array(entry()).alias("one"))
    return joined(blocks.join(heads, "hub"), percent)


def remaining_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a group. members: (hub, f, n, component); groups of one component are done."""
    mixed = members.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("hub")
    left = materialise(members.join(mixed, "hub"))
    counts = left.groupBy("hub", "component").agg(F.count("*").alias("k"), F.sum("n").alias("hashes"))
    main = counts.groupBy("hub").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("hashes").alias("hashes"), F.sum("k").alias("k"))
    placed = left.drop("n").join(main, "hub").select("hub", "f", "component", (F.col("component") != F.col("main")).alias("aside"), chunk_of(F.col("f"), F.col("hashes"), F.col("k")).alias("chunk"))
    blocks = materialise(placed.join(sets, "f").groupBy("hub", "chunk", "aside").agg(F.collect_list(entry()).alias("block")))
    ones = blocks.where("aside").select("hub", F.col("chunk").alias("c1"), F.col("block").alias("one"))
    others = blocks.select("hub", F.col("chunk").alias("c2"), F.col("aside").alias("aside2"), F.col("block").alias("other"))
    return joined(ones.join(others, "hub").where("not aside2 or c1 <= c2"), percent)


def linked_texts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the size of its set and the smallest doc_id reachable over links."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = materialise(class_rows(docs, size))
    opened = open_classes(docs, rows, size, percent)
    sets = ordered_sets(docs, opened, size)
    prefixes = sets.select("f", "n", F.explode(F.slice("keys", F.lit(1), F.col("take").cast("int"))).alias("key"))
    members, full = hub_groups(prefixes), sets.select("f", "n", "keys")
    found = materialise(components(hub_links(members, full, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    labelled = members.join(found, members["f"] == found["node"], "left").select("hub", "f", "n", F.coalesce("component", "f").alias("component"))
    more = remaining_links(labelled, full, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    again = materialise(components(more)).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    first = found.join(again, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    every = first.unionByName(again.select(F.col("component").alias("node"), F.col("whole").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    classes = rows.where("n > 0").groupBy("f").agg(F.min("doc_id").alias("head"))
    labels = classes.join(every, classes["f"] == every["node"], "left").select("f", "head", F.coalesce("component", "f").alias("component"))
    heads = labels.groupBy("component").agg(F.min("head").alias("component_id"))
    named = labels.join(heads, "component").select("f", "component_id")
    out = rows.where("n > 0").join(named, "f").select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def oracle(size: int, percent: int) -> str:
    return f"SELECT doc_id, n_shingles, component_id FROM ({near_copies.oracle(size, percent)})"
