"""N-gram Jaccard self-join with signature trees.

A document is its set of distinct n-word shingles; documents link when the Jaccard index of their
sets reaches a percentage. The join is exact up to 64-bit shingle hashes and loses no link:

1. Equal sets are one class, represented by its smallest doc_id.
2. Two sets that link share a shingle among the first |set| - ceil(t |set|) + 1 of both, in any
   one order of all shingles. The order here is by how often a shingle's bucket occurs in the
   corpus, rare ones first, so passages that many documents share come last. Documents with a
   common such shingle form a cell.
3. A star pass compares every member of a cell with its smallest one and contracts what links, so
   a crowd of near copies becomes one component with as many comparisons as members.
4. The cells that still hold several components are cut by size bands and searched by signature
   trees: leaves are documents, nodes hold the OR of their members' token bitmaps and the range of their set sizes,
   and a dual traversal drops pairs of nodes by size range, by common component, and by the most
   overlap that their bitmaps allow. The upper nodes of a large cell are rows of a table, joined
   with each other; the lower levels are numpy inside a task.
   A first search follows only candidates that span the components of a pair of nodes.
5. Pairs that remain are verified on the sets themselves.

Empty and null texts have no shingles and link with nothing; a text of fewer than n words is one
shingle. Rows of one doc_id are one document with several texts: it links by any of them. Rows
without doc_id are left out of linking and have no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tapelens.llm.common import arrow_map, arrow_rows, mix, packed, pick, shingle_hashes, slices, summed_parts
from tapelens.operators.components import connected_components
from tapelens.session import stored

#: 64-bit words of a token bitmap; shingles for one bucket of the frequency table; its least and greatest size in bits.
BITMAP_WORDS, BUCKET_LOAD, BUCKET_BITS = 32, 4, (16, 25)
#: Characters of a word with its blank, roughly: only to choose the size of that table.
WORD_CHARS = 6
#: Members of an upper node, and of a lower one; rows of nodes, and of texts, in one Arrow batch.
NODE, LEAF = 256, 16
NODE_ROWS, TEXT_ROWS = 32, 200
#: Bits a candidate of the filter that picks the texts to fetch, and its greatest size; false hits only fetch more.
BLOOM_SHARE, BLOOM_BITS = 16, (16, 27)

SIGNATURES = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("size", pa.int64()),
                        ("prefix", pa.list_(pa.int64())), ("short", pa.int32()), ("bitmap", pa.binary())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Candidates, and (without a and b) the cells from which some were put off.
FOUND = pa.schema([*PAIRS, ("token", pa.int64()), ("band", pa.int32())])


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased (bytes.lower knows only those)."""
    return shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), n)


def needed(size_a, size_b, percent: int):
    """Least intersection with which sets of these sizes link: ceil(p (|A| + |B|) / (100 + p))."""
    return -(-percent * (size_a + size_b) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    """Shingles of which one must be shared, whatever the size of the other set."""
    return size - -(-percent * size // 100) + 1


def short_length(size: int, percent: int) -> int:
    """The same when the other set is no smaller: it must then share more of them."""
    return size - needed(size, size, percent) + 1


def sized(n: float, bits: tuple[int, int]) -> int:
    """Power of two for n entries, between two bounds."""
    return 1 << min(max(math.ceil(math.log2(max(n, 1))), bits[0]), bits[1])


def bucket_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """Frequency rank of each bucket of shingles, one byte each, counted over all texts.

    Documents of a bucket are counted up to 65,535 and ranked in steps of an eighth; the table grows
    with the texts to its bound, beyond which the order is coarser and links are the same.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = sized(chars / WORD_CHARS / BUCKET_LOAD, BUCKET_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.uint16)
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, n) for t in part.column(0).to_pylist() if t]
                if sets:
                    at, more = np.unique((np.concatenate(sets) & np.uint64(buckets - 1)).astype(np.uint32), return_counts=True)
                    total[at] = np.minimum(total[at].astype(np.int64) + more, 65_535)
        yield packed(total, sparse=True)

    counts = summed_parts(pick(docs, text="text").mapInArrow(count, "part binary"), added, np.zeros(buckets, np.uint16), sparse=True)
    return np.minimum(np.log2(np.arange(65_536) + 1) * 6, 255).astype(np.uint8)[counts]


#: The rank of a bucket that holds one shingle of one document: no other set can share it.
LONE = 6


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum in place, up to the greatest value that fits; never below either of the two."""
    a += b
    a[a < b] = 65_535
    return a


def bitmap_of(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITMAP_WORDS, np.uint64)
    at = mix(tokens) >> np.uint64(64 - 6 - BITMAP_WORDS.bit_length() + 1)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """SIGNATURES of every row, written once."""
    table = docs.sparkSession.sparkContext.broadcast(bucket_ranks(docs, n))  # at most 2^25 bytes

    def step(cols):
        ranks = table.value
        out = {f.name: [] for f in SIGNATURES}
        for text in cols["text"]:
            s = shingles(text, n)
            d = xxhash.xxh3_128_digest(s.tobytes())
            rank = ranks[(s & np.uint64(len(ranks) - 1)).astype(np.int64)]
            order = np.lexsort((s, rank))[: prefix_length(len(s), percent)] if len(s) else np.empty(0, np.int64)
            shared = rank[order] > LONE  # nothing can share a lone one
            short = int(shared[: short_length(len(s), percent)].sum())
            for k, v in zip(("h1", "h2", "size", "prefix", "short", "bitmap"), (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                                                                         len(s), s[order[shared]].view(np.int64), short, bitmap_of(s).tobytes())):
                out[k].append(v)
        return out | {"doc_id": cols["doc_id"]}

    out = stored(arrow_map(pick(docs, doc_id="doc_id", text="text"), SIGNATURES, step), "signatures")
    table.destroy()
    return out


def could_link(a: dict, b: dict, percent: int) -> np.ndarray:
    """Which pairs of members may link: sizes, and the overlap that the bitmaps leave possible.

    Every bit set in one bitmap and not in the other stands for a token the other set lacks.
    """
    need = needed(a["size"], b["size"], percent)
    ok = (np.minimum(a["size"], b["size"]) >= need)
    ok &= a["size"] - np.bitwise_count(a["bitmap"] & ~b["bitmap"]).sum(axis=-1, dtype=np.int64) >= need
    return ok & (b["size"] - np.bitwise_count(b["bitmap"] & ~a["bitmap"]).sum(axis=-1, dtype=np.int64) >= need)


def bitmaps(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64).reshape(len(values), BITMAP_WORDS)


class Tree:
    """Leaves of LEAF members in order of size, each with the OR of its bitmaps, its size range and its components."""

    def __init__(self, ids, sizes, comps, maps):
        order = np.lexsort((ids, sizes))
        self.ids, self.sizes, self.comps, self.maps = ids[order], sizes[order], comps[order], maps[order]
        at = np.arange(0, len(ids), LEAF)
        self.at = np.append(at, len(ids))
        self.bits = np.bitwise_or.reduceat(self.maps, at)
        self.low, self.high = np.minimum.reduceat(self.sizes, at), np.maximum.reduceat(self.sizes, at)
        self.first, self.last = np.minimum.reduceat(self.comps, at), np.maximum.reduceat(self.comps, at)
        # every member of a node has at least so many bits of its own
        self.least = np.minimum.reduceat(np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64), at)

    def pairs(self, other: "Tree", percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: ids of the member pairs that no bound excludes."""
        i, j = np.meshgrid(np.arange(len(self.low)), np.arange(len(other.low)), indexing="ij")
        i, j = i.ravel(), j.ravel()
        if other is self:
            i, j = i[i <= j], j[i <= j]
        keep = (100 * self.high[i] >= percent * other.low[j]) & (100 * other.high[j] >= percent * self.low[i])
        keep &= ~((self.first[i] == self.last[i]) & (other.first[j] == other.last[j]) & (self.first[i] == other.first[j]))
        # a member lacks at most size - need tokens of the other one, so the two nodes must share that many bits less
        slack_a = self.high[i] - needed(self.high[i], np.maximum(other.low[j], -(-percent * self.high[i] // 100)), percent)
        slack_b = other.high[j] - needed(other.high[j], np.maximum(self.low[i], -(-percent * other.high[j] // 100)), percent)
        shared = np.bitwise_count(self.bits[i] & other.bits[j]).sum(axis=1, dtype=np.int64)
        keep &= (shared >= self.least[i] - slack_a) & (shared >= other.least[j] - slack_b)
        for x, y in zip(i[keep], j[keep]):
            a, b = slice(self.at[x], self.at[x + 1]), slice(other.at[y], other.at[y + 1])
            ok = could_link({"size": self.sizes[a, None], "bitmap": self.maps[a, None]}, {"size": other.sizes[None, b], "bitmap": other.maps[None, b]}, percent)
            ok &= self.comps[a, None] != other.comps[None, b]
            p, q = np.nonzero(ok)
            p, q = self.ids[a][p], other.ids[b][q]
            yield np.minimum(p, q), np.maximum(p, q)


def size_band(size, percent: int):
    """Sets that link lie in the same band of sizes or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.lit(math.log(100 / percent)) + F.lit(1e-9)).cast("int")


def node_pairs(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Candidate pairs (a, b) of cells: upper nodes joined inside a cell, lower levels inside the tasks.

    `members`: token, band (together the cell), n (its members), doc_id, size, comp, bitmap. With
    `forest` a pair of nodes gives only candidates that join components its earlier ones did not; a
    cell that put any off is named in a row of its own (token, band).
    """
    cell = ["token", "band"]
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / NODE)).cast("int")
    nodes = stored(members.groupBy(*cell, block.alias("block")).agg(
        F.collect_list(F.struct("doc_id", "size", "comp", "bitmap")).alias("members"),  # about NODE of them
        F.min("size").alias("low"), F.max("size").alias("high"), F.min("comp").alias("first"), F.max("comp").alias("last"), F.first("n").alias("n")), "signature-nodes")
    small = nodes.filter(F.col("n") <= NODE).select(*cell, F.col("members").alias("left"), F.lit(None).cast(nodes.schema["members"].dataType).alias("right"))
    large = nodes.filter(F.col("n") > NODE)
    left = large.select(*cell, "block", "low", "high", "first", "last", F.col("members").alias("left"))
    right = large.select(*cell, F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"),
                         F.col("first").alias("first2"), F.col("last").alias("last2"), F.col("members").alias("right"))
    crossed = left.join(right, cell).filter("block2 >= block")
    crossed = crossed.filter((100 * F.col("high2") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("low2"))
                             & ~((F.col("first") == F.col("last")) & (F.col("first2") == F.col("last2")) & (F.col("first") == F.col("first2"))))
    crossed = crossed.select(*cell, "left", F.when(F.col("block") != F.col("block2"), F.col("right")).alias("right"))

    def tree(members: list[dict]) -> Tree:
        return Tree(np.array([m["doc_id"] for m in members]), np.array([m["size"] for m in members]), np.array([m["comp"] for m in members]),
                    bitmaps([m["bitmap"] for m in members]))

    def step(cols):
        out, put_off = [(np.empty(0, np.int64),) * 2], set()
        for token, band, left, right in zip(cols["token"], cols["band"], cols["left"], cols["right"]):
            a = tree(left)
            b = a if right is None else tree(right)
            for p, q in a.pairs(b, percent) if not forest else spanning(a.pairs(b, percent), a, b, lambda: put_off.add((token, band))):
                out.append((p, q))
        a, b = (np.concatenate(x).tolist() for x in zip(*out))
        none, cells = [None] * len(a), sorted(put_off)
        return {"a": a + [None] * len(cells), "b": b + [None] * len(cells), "token": none + [t for t, _ in cells], "band": none + [d for _, d in cells]}

    found = arrow_map(small.unionByName(crossed), FOUND, step).filter("a IS NULL OR a <> b").distinct()
    with arrow_rows(found.sparkSession, NODE_ROWS):
        return stored(found, "jaccard-candidates")


def spanning(found: Iterator[tuple[np.ndarray, np.ndarray]], a: Tree, b: Tree, put_off=lambda: None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The candidates that join two components which earlier ones had left apart; `put_off` hears of the others."""
    comp = dict(zip(a.ids.tolist() + b.ids.tolist(), a.comps.tolist() + b.comps.tolist()))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for p, q in found:
        keep = []
        for x, y in zip(p.tolist(), q.tolist()):
            x, y = root(comp[x]), root(comp[y])
            keep.append(x != y)
            parent[y] = x
        if not all(keep):
            put_off()
        yield p[keep], q[keep]


def bounded_pairs(pairs: DataFrame, sig: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps of both leave possible: the leaf test of the tree, by joins."""
    side = sig.select("doc_id", "size", "bitmap")
    both = (pairs.join(side.select(F.col("doc_id").alias("a"), F.col("size").alias("sa"), F.col("bitmap").alias("ma")), "a")
            .join(side.select(F.col("doc_id").alias("b"), F.col("size").alias("sb"), F.col("bitmap").alias("mb")), "b"))

    def step(cols):
        ok = could_link({"size": np.array(cols["sa"], np.int64), "bitmap": bitmaps(cols["ma"])}, {"size": np.array(cols["sb"], np.int64), "bitmap": bitmaps(cols["mb"])}, percent)
        return {"a": np.array(cols["a"], np.int64)[ok], "b": np.array(cols["b"], np.int64)[ok]}

    sizes = 100 * F.least("sa", "sb") >= percent * F.greatest("sa", "sb")
    return arrow_map(both.filter(sizes).select("a", "b", "sa", "ma", "sb", "mb"), PAIRS, step).distinct()


def places(values: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each id in a filter of `size` bits."""
    h = mix(values.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    return np.concatenate([h % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)]).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """Packed bits of a Bloom filter of the given ids, sized by their number."""
    size = sized(ids.count() * BLOOM_SHARE, BLOOM_BITS)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = places(batch.column(0).to_numpy(zero_copy_only=False), size)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield packed(bits)

    return summed_parts(ids.mapInArrow(collect, "part binary"), np.bitwise_or, np.zeros(size // 8, np.uint8))


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets link. Texts of the documents concerned travel compressed, once per side."""
    pairs = stored(pairs, "jaccard-pairs")
    wanted = docs.sparkSession.sparkContext.broadcast(id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))

    def squeeze(cols):
        bits = wanted.value
        known = [(i, t) for i, t in zip(cols["doc_id"], cols["text"]) if i is not None]
        at = places(np.array([i for i, _ in known], np.int64), len(bits) * 8).reshape(2, -1)
        hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
        picked = [x for x, ok in zip(known, hit) if ok]
        return {"doc_id": [i for i, _ in picked], "body": [zstandard.compress((t or "").encode("utf-8", "surrogatepass"), 1) for _, t in picked]}

    texts = pick(docs, doc_id="doc_id", text="text")
    bodies = stored(arrow_map(texts, pa.schema([("doc_id", pa.int64()), ("body", pa.binary())]), squeeze), "jaccard-texts")
    wanted.destroy()
    if not bodies.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # only then are texts shuffled to drop repeated rows
        bodies = stored(bodies.distinct(), "jaccard-texts")
    both = (pairs.join(bodies.select(F.col("doc_id").alias("a"), F.col("body").alias("body_a")), "a")
            .join(bodies.select(F.col("doc_id").alias("b"), F.col("body").alias("body_b")), "b"))

    def step(cols):
        memory: dict[bytes, np.ndarray] = {}

        def get(body: bytes) -> np.ndarray:
            if body not in memory:
                memory[body] = shingles(zstandard.decompress(body).decode("utf-8", "surrogatepass"), n)
            return memory[body]

        ok = []
        for x, y in zip(cols["body_a"], cols["body_b"]):
            p, q = get(x), get(y)
            ok.append(len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q), percent))
        return {"a": np.array(cols["a"], np.int64)[ok], "b": np.array(cols["b"], np.int64)[ok]}

    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return stored(arrow_map(both.select("a", "b", "body_a", "body_b"), PAIRS, step).distinct(), "jaccard-links")


def linked(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    rows = signatures(docs, n, percent)
    real = rows.filter("size > 0 AND doc_id IS NOT NULL")
    classes = stored(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    # rows that repeat a doc_id and its text are equal, so a representative's own rows are told apart by id alone
    reps = real.join(classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left_semi")
    sig = stored(reps.dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "size", "prefix", "short", "bitmap"), "jaccard-reps")

    # one shuffle serves the count of a token and the join with it, so both read the same columns
    tokens = sig.select(F.posexplode("prefix").alias("at", "token"), "doc_id", "size", "short").select(
        "token", "doc_id", "size", (F.col("at") < F.col("short")).alias("short")).repartition("token")
    crowds = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "size", "short")).alias("first")).filter("n > 1").select(
        "token", F.struct("first.doc_id", size_band(F.col("first.size"), percent).alias("own")).alias("leader"))
    cells = stored(tokens.join(crowds, "token").withColumn("own", size_band(F.col("size"), percent)), "jaccard-cells")
    near = (F.col("doc_id") != F.col("leader.doc_id")) & (F.abs(F.col("own") - F.col("leader.own")) <= 1)
    stars = cells.filter(near).select(F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    star_links = verified(bounded_pairs(stars, sig, percent), docs, n, percent)

    # first the candidates that span each pair of nodes: near copies without a common centre are
    # contracted by a linear number of checks; then all candidates between what is still apart, in the
    # cells that put some off: the others have had all of theirs verified
    links, put_off = star_links, None
    for forest in (True, False):
        comps = stored(connected_components(links, []).select("node", "comp"), "jaccard-comps")
        members = cells.join(comps, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "size", "short", "own", F.coalesce("comp", "doc_id").alias("comp"))
        apart = members.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first < last").select("token")
        # a cell is a token and a band with the next one; cells of the same members are searched once;
        # of two sets that link the smaller one has the token in its short prefix
        placed = members.join(apart, "token", "left_semi").withColumn("band", F.explode(F.array("own", F.col("own") - 1)))
        placed = stored(placed if forest else placed.join(put_off, ["token", "band"], "left_semi"), "jaccard-placed")
        groups = placed.groupBy("token", "band").agg(
            F.count("*").alias("n"), F.min("comp").alias("first"), F.max("comp").alias("last"), F.max(F.col("own") == F.col("band")).alias("home"),
            F.sum(F.xxhash64("doc_id", "short").cast("decimal(38,0)")).alias("set"), F.min(F.when(F.col("short"), F.col("size"))).alias("least")).filter(
            "n > 1 AND first < last AND home AND least IS NOT NULL")
        once = groups.groupBy("n", "set").agg(F.min(F.struct("token", "band")).alias("k"), F.first("least").alias("least")).select("k.token", "k.band", "n", "least")
        searched = placed.drop("own").join(once, ["token", "band"]).filter(F.col("short") | (F.col("size") >= F.col("least"))).drop("short", "least")
        searched = searched.join(sig.select("doc_id", "bitmap"), "doc_id")
        found = node_pairs(searched, percent, forest)
        put_off = found.filter("a IS NULL").select("token", "band")
        links = stored(links.unionByName(verified(found.filter("a IS NOT NULL").select("a", "b"), docs, n, percent)), "jaccard-all-links")

    # a doc_id with several texts joins the classes of all of them
    own = real.join(classes, ["h1", "h2"]).select("doc_id", "rep")
    links = links.unionByName(own.filter("doc_id <> rep").join(sig.select("doc_id"), "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    several = own.join(least, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct()
    final = stored(connected_components(stored(links.unionByName(several), "jaccard-edges"), []).select("node", "comp"), "jaccard-components")

    of_class = stored(classes.join(final, F.col("rep") == F.col("node"), "left").select("h1", "h2", F.coalesce("comp", "rep").alias("component")), "jaccard-classes")
    out = rows.select("doc_id", "size", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
