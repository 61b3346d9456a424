"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Fingerprints: a document's words make 3-word shingles (repeats included); bit i of the fingerprint is set when it is set
in over half of the shingles' XXH64 values. Two fingerprints link when at most ``D`` of 64 bits differ.

Index over distinct fingerprints (copies collapse before anything is compared):

* Upper nodes: four 16-bit segments; two fingerprints within two bits agree on two segments at least, so each goes under
  the six masked patterns that keep two segments. A pattern with one fingerprint below it is pruned at once.
* Below a pattern the fingerprints stand in Gray order of their free bits, so neighbours differ in few bits, cut into
  groups of ``LEAF``. A group keeps the bits its members share (mask and pattern); two groups whose shared bits differ
  in over ``D`` places are pruned whole, the others are compared member by member.
* A node links as a forest: its members are united as links appear and only one link per united pair leaves it.
* A pattern with over ``NODE`` fingerprints below it does not go to one task. Its fingerprints go under patterns of
  63 bits instead: each fingerprint and its 64 one-bit neighbours are centres, two fingerprints within two bits share a
  centre, and all that share one are within two bits. A centre has at most 65 members. So nothing is capped.

Components then follow by star contraction over the links. No pair list of a group of copies is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded, fresh, keep, lookup, same, spread
from pathloom.operators.components import connected_components

D, LEAF, NODE, WORDS = 2, 32, 2048, 3
#: Of the filtering stage: shingle length, least Jaccard similarity, and the keys under which shingle sets are compared.
STAGE_WORDS, SIMILARITY, BANDS, BAND = 5, 0.8, 16, 3
#: Sets, and shingles in all, up to which the sets under a key are compared in one task.
PART, PART_SHINGLES = 1024, 2_000_000
MULTIPLIERS = np.random.default_rng(23).integers(1, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = bytes(range(65, 91)), bytes(range(97, 123))
TO_LOWER = bytes.maketrans(*SPACE)
#: Pairs of kept segments, as masks.
MASKS = [(0xFFFF << (16 * i)) | (0xFFFF << (16 * j)) for i in range(4) for j in range(i)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, of all words if there are fewer, of nothing if there are none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), ends[len(tokens) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:z], 42) for a, z in spans), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> int:
    """The code whose bits are set where over half of the hashes have them set; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint, unsigned; 0 for a null text or one without words."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a signed long) for every row of ``docs(doc_id, text)``."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fp = np.array([fingerprint(x) for x in part["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"], "fp": fp})

    return spread(docs.select("doc_id", "text")).mapInPandas(run, f"doc_id {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def node_links(members: np.ndarray, d: int = D, leaf: int = LEAF) -> list[tuple[int, int]]:
    """A forest of links between the distinct codes of one node: unions that leave the same components as all links."""
    codes = np.asarray(members, dtype=np.int64).view(np.uint64)
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    cuts = np.arange(0, len(codes), leaf)
    every, some = np.bitwise_and.reduceat(codes, cuts), np.bitwise_or.reduceat(codes, cuts)
    mask = ~(every ^ some)  # the bits a group shares
    label, out = np.arange(len(codes)), []
    for g, a in enumerate(cuts.tolist()):
        apart = np.bitwise_count((every[g] ^ every[g:]) & mask[g] & mask[g:])
        for h in (np.flatnonzero(apart <= d) + g).tolist():
            b = int(cuts[h])
            left, right = slice(a, a + leaf), slice(b, b + leaf)
            if (label[left] == label[a]).all() and (label[right] == label[a]).all():
                continue
            near = np.bitwise_count(codes[left, None] ^ codes[None, right]) <= d
            while (open_ := near & (label[left, None] != label[None, right])).any():
                i, j = divmod(int(open_.argmax()), open_.shape[1])
                x, y = sorted((int(label[a + i]), int(label[b + j])))
                label[label == y] = x
                out.append((int(codes[a + i].view(np.int64)), int(codes[b + j].view(np.int64))))
    return out


def _inside(lists: DataFrame, d: int) -> DataFrame:
    """Links within each list of ``lists(members)``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [x for members in part["members"] for x in node_links(members, d)]
            yield pd.DataFrame(got, columns=["u", "v"], dtype="int64")

    return lists.select("members").mapInPandas(run, "u long, v long")


def links(distinct: DataFrame) -> DataFrame:
    """(u, v) between the distinct codes of ``distinct(fp)``: enough links for the components of all within ``D`` bits."""
    masks = [m - 2**64 if m >= 2**63 else m for m in MASKS]
    nodes = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(nodes).alias("x")).select("fp", "x.m", "x.pattern")
    sizes = rows.groupBy("m", "pattern").agg(F.count("*").alias("size")).where("size > 1")
    rows = keep(rows.join(sizes, ["m", "pattern"]))

    small = rows.where(F.col("size") <= NODE).groupBy("m", "pattern").agg(F.collect_list("fp").alias("members"))
    near = _inside(small, D)
    hot = rows.where(F.col("size") > NODE).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (2**64 if i == 63 else 0))) for i in range(64)])
    centre = hot.select("fp", F.explode(flips).alias("centre")).groupBy("centre").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("members"))
    far = centre.where(F.size("members") > 1).select("u", F.explode("members").alias("v")).where("u <> v")
    return near.unionByName(far).distinct()


def _grouped(found: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, fp, component_id from ``found(doc_id, fp)`` and links between its codes."""
    first = keep(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    roots = connected_components(linked)
    members = roots.join(first, roots["id"] == first["fp"]).select("fp", "root", "first")
    lowest = members.groupBy("root").agg(F.min("first").alias("lowest"))
    moved = members.join(lowest, "root").select("fp", "lowest")
    named = keep(first.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"), "size"))
    return lookup(found, named, ["fp"], "size").select("doc_id", "fp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable, itself included).

    A null text or one without words has fingerprint zero and links like any other. Rows that repeat a doc_id are each
    kept. A null doc_id takes part in links but never names a component with a non-null id in it.
    """
    found = keep(fingerprints(docs))
    return _grouped(found, links(found.select("fp").distinct()))


def sketches(docs: DataFrame) -> DataFrame:
    """For each row doc_id, mark (hash of the text), sid (digest of its set of ``STAGE_WORDS``-word shingles), n (how many
    these are), fp (the fingerprint of its shingles), and ``BANDS`` keys, each of ``BAND`` minima of hashed shingles."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sids, sizes, codes, keys = [], [], [], []
            for text in part["text"]:
                hashes = shingle_hashes(text, STAGE_WORDS)
                codes.append(majority(hashes))
                hashes = np.unique(hashes)
                sids.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                sizes.append(len(hashes))
                low = np.full(BANDS * BAND, np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(hashes), 20_000):
                    h = hashes[None, at : at + 20_000] * MULTIPLIERS[:, None]
                    low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(axis=1))
                band = low.reshape(BANDS, BAND)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)
                for j in range(BAND):
                    key = (key ^ band[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                keys.append(key.view(np.int64))
            yield pd.DataFrame({"doc_id": part["doc_id"], "mark": part["mark"], "sid": np.array(sids, dtype=np.uint64).view(np.int64), "n": np.array(sizes, dtype=np.int64), "fp": np.array(codes, dtype=np.uint64).view(np.int64), "keys": keys})

    return spread(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")).mapInPandas(run, f"doc_id {kind}, mark long, sid long, n long, fp long, keys array<long>")


def set_links(sids: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of links between shingle sets of Jaccard similarity ``SIMILARITY`` or more: the components of all links."""
    if len(sets) < 2:
        return []
    size, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(code, kind="stable")]
    first, ends = np.cumsum(count) - count, np.cumsum(size)
    for i in range(len(sets)):
        open_ = (label != label[i]) & (np.minimum(size, size[i]) >= SIMILARITY * np.maximum(size, size[i]) - 1e-9)
        open_[:i] = False
        if not open_.any():
            continue
        mine = code[ends[i] - size[i] : ends[i]]
        n = count[mine]
        places = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(owner[places], minlength=len(sets))
        for j in np.flatnonzero(open_ & (shared >= SIMILARITY * (size + size[i] - shared) - 1e-9)).tolist():
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((sids[i], sids[j]))
    return out


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and its shingles' hashes, from the one row of ``docs`` that ``wanted(doc_id, mark, sid)`` names for each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"sid": part["sid"], "shingles": [np.unique(shingle_hashes(x, STAGE_WORDS)).tobytes() for x in part["text"]]})

    rows, small = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), bounded(wanted)
    rows = rows.join(small, same(rows, small, "doc_id", "mark")).select("sid", "text").dropDuplicates(["sid"])
    return rows.mapInPandas(run, "sid long, shingles binary")


def _verified(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within each list of ``lists(members)``, by the exact similarity of the sets."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sids, held = None, [], []
        for part in parts:
            got = []
            for name, sid, shingles in zip(part["list"].tolist(), part["sid"].tolist(), part["shingles"], strict=True):
                if name != at:
                    got += set_links(sids, held)
                    at, sids, held = name, [], []
                sids.append(sid)
                held.append(np.frombuffer(shingles, dtype="<u8"))
            yield pd.DataFrame(got, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(set_links(sids, held), columns=["u", "v"], dtype="int64")

    rows = lists.select("members").distinct().select(F.xxhash64("members").alias("list"), F.explode("members").alias("sid"))
    return rows.join(sets, "sid").repartition("list").sortWithinPartitions("list").mapInPandas(run, "u long, v long")


def _order() -> Column:
    """Of the rows of a group the least stays: the smallest doc_id, null being largest, then the smallest hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))


def fingerprint_keys(found: DataFrame) -> DataFrame:
    """sid, n and a key for each component of fingerprints that link within ``D`` bits: all such sets share it."""
    codes = keep(found.groupBy("fp").agg(F.count("*").alias("size")))
    roots = connected_components(links(codes.select("fp")))
    named = keep(codes.join(roots, codes["fp"] == roots["id"], "left").select("fp", "size", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key")))
    return lookup(found.select("sid", "n", "fp"), named, ["fp"], "size").select("sid", "n", "key")


def similar_links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links between the sets of ``found`` that share a key and have Jaccard similarity ``SIMILARITY`` or more.

    One key of a set is the component of its fingerprint in the Gray-order index, the others are its minima's.
    The sets under a key are one list, compared in one task. A key over ``PART`` sets or ``PART_SHINGLES`` shingles is cut
    into parts that have the key's first and last set in common. If its sets are then not all of one component, blocks of
    them are compared pair by pair; only blocks that lie within the same component are not. So nothing is left out."""
    rows = found.select("sid", "n", F.explode("keys").alias("key")).unionByName(fingerprint_keys(found)).distinct()
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    many = lambda size, weight: F.ceil(F.greatest(size / PART, weight / PART_SHINGLES, F.lit(1.0)))
    rows = keep(rows.join(sizes, "key").select("key", "sid", "n", many(F.col("size"), F.col("weight")).alias("parts")))
    shared = rows.select("sid").distinct()
    wanted = found.join(shared, "sid").groupBy("sid").agg(F.min(_order()).alias("first"))
    sets = _shingle_sets(docs, keep(wanted.select("first.doc_id", "first.mark", "sid")))

    hot = rows.where("parts > 1")
    ends = hot.groupBy("key", "parts").agg(F.min("sid").alias("a"), F.max("sid").alias("b"))
    ends = ends.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "a", "b").select("key", "part", F.explode(F.array("a", "b")).alias("sid"))
    listed = rows.select("key", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part"), "sid").unionByName(ends)
    near = keep(_verified(listed.groupBy("key", "part").agg(F.array_sort(F.collect_set("sid")).alias("members")).where(F.size("members") > 1), sets))
    if hot.isEmpty():
        return near

    roots = connected_components(near)
    rooted = hot.join(roots, hot["sid"] == roots["id"], "left").select("key", "sid", "n", "parts", F.coalesce("root", "sid").alias("root"))
    rooted = keep(rooted.join(rooted.groupBy("key").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed"), "key"))
    if rooted.isEmpty():
        return near
    sub = rooted.groupBy("key", "root").agg(many(F.count("*"), F.sum("n")).alias("sub"))
    big, place = F.col("sub") > 1, F.xxhash64("sid")
    block = F.struct(F.when(big, F.col("root")).alias("root"), F.when(big, F.pmod(place, F.col("sub"))).otherwise(F.pmod(F.xxhash64("root"), F.col("parts"))).alias("at"))
    blocks = keep(rooted.join(sub, ["key", "root"]).select("key", "sid", block.alias("block")).groupBy("key", "block").agg(F.collect_list("sid").alias("members")))
    a, b = blocks.alias("a"), blocks.alias("b")
    apart = F.col("a.block.root").isNull() | F.col("b.block.root").isNull() | (F.col("a.block.root") != F.col("b.block.root"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & apart)
    return near.unionByName(_verified(pairs.select(F.array_sort(F.array_union("a.members", "b.members")).alias("members")), sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint in hex and its component."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id stays (null is largest).

    A group here is a component of documents whose sets of five-word shingles have Jaccard similarity ``SIMILARITY`` or
    more. Pairs are found by the fingerprints' index (those of one component of links within ``D`` bits are compared) and by
    ``BANDS`` keys of ``BAND`` minima, which a pair at 0.8 shares none of once in 100,000 times; each is verified by its sets. A row is known by its doc_id and its text: rows that repeat both are one, rows that share
    a doc_id (or have none) over different texts are documents of their own. Of rows without a word one stays.
    """
    found = keep(sketches(docs))
    roots = connected_components(similar_links(docs, found))
    first = found.groupBy("sid").agg(F.min(_order()).alias("first"), F.count("*").alias("size"))
    named = keep(first.join(roots, first["sid"] == roots["id"], "left").select("sid", F.coalesce("root", "sid").alias("root"), "first", "size"))
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    groups = lookup(found, keep(named.join(stays, "root").select("sid", "stays", "size")), ["sid"], "size")
    (mark,) = fresh(docs.columns, "_text_mark")
    gone = bounded(keep(groups.where(_order() != F.col("stays")).select("doc_id", "mark").distinct()).withColumnRenamed("mark", mark))
    kept = docs.withColumn(mark, F.xxhash64("text"))
    kept = kept.join(gone, same(kept, gone, "doc_id", mark), "left_anti")
    again = keep(found.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.col("mark").alias(mark)))
    if again.isEmpty():
        return kept.drop(mark)
    again = bounded(again)
    once, more = (kept.join(again, same(kept, again, "doc_id", mark), how) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates(["doc_id", mark])).drop(mark)
