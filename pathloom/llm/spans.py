"""Remove every byte covered by a ``LENGTH``-byte string that starts more than once in the corpus. Exact.

The index is a logarithmic family of sparse suffix arrays. A suffix array of every byte position takes eight bytes for
each byte of text before anything is sorted, so suffixes are kept at *anchors* only: of the ``GRAM``-byte strings in a
window of ``LENGTH`` bytes the one with the least hash (leftmost if equal). Equal windows have equal anchors at equal
places, so two windows can only be equal where their anchors are, and one anchor serves a run of windows (about 75). An
array is sorted by the hash of the suffix's first ``GRAM`` bytes (equality is all that is asked of the order); an entry
has that hash, how often it stands, and the least and greatest hash of what its runs cover.

1. Documents come in batches. A batch's suffix array is merge-scanned against every level: entries in both are *shared*
   anchors, and so are those that stand twice in the batch. Then it becomes a level itself, and while the last two levels
   are of equal size they merge into one of twice the size, so n batches leave log n levels and an entry is rewritten
   log n times.
2. Runs without a shared anchor are done: nothing in them repeats. Where all runs of an anchor cover equal bytes, and
   among the others where two runs do, every window of them repeats.
3. What is left are classes of runs that share an anchor but not all bytes (the edges of a passage, the edits of a near
   copy). Of each class the covered bytes of one run are read again; the classes of an anchor meet and their windows are
   compared by anchor and window hash: 128 bits. An anchor of over ``LOCAL`` classes does not meet in one task: its runs are
   cut into parts by distance from the anchor, which meet by the bytes that all windows of the part share.

Counts are combined before each shuffle, hot anchors and classes are joined by a broadcast of at most a thousand keys, and
no group of equal strings is ever gathered, so a passage that stands in a third of all documents costs one row for each
place it stands.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import BROADCAST_ROWS, bounded, forget, keep, lookup, same, spread  # noqa: F401
from pathloom.llm.rolling import Rolling, mix

LENGTH, GRAM, CHUNK = 200, 48, 1_000_000
#: Batches that a table is dealt into, at least; bytes of text in a batch, at most.
BATCHES, BATCH_BYTES = 3, 1 << 40
#: Classes of an anchor up to which they are compared in one task; representatives up to which their list is broadcast.
LOCAL, LISTED = 1024, 200_000
WIDTH = LENGTH - GRAM + 1  # anchors to choose from; up to 256
#: Distances from the anchor in a part, by rounds.
WIDTHS = (39, 10, 3, 1)
_LOW = np.uint64(255)


def batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``CHUNK`` bytes together (a longer one alone)."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def runs_of(texts: list[bytes]) -> pd.DataFrame:
    """For each run of windows with one anchor: text number, lo, n (windows, and the anchor's distance from lo times 256), ah (anchor), ch (bytes covered)."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(size)
    starts = ends - size
    if len(b) < LENGTH:
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("text", "lo", "n", "ah", "ch")})
    roll = Rolling(b)
    gram = roll.each(GRAM)
    blocks = -(-len(gram) // WIDTH)
    padded = np.full(blocks * WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.bitwise_and(gram, ~_LOW, out=padded[: len(gram)])
    padded.reshape(blocks, WIDTH)[:, :] |= np.arange(WIDTH, dtype=np.uint64)
    grid = padded.reshape(blocks, WIDTH)
    to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    from_start = np.minimum.accumulate(grid, axis=1).reshape(-1)
    del padded, grid
    s = np.arange(len(b) - LENGTH + 1)
    first, second = to_end[: len(s)], from_start[WIDTH - 1 : WIDTH - 1 + len(s)]
    left = (first & ~_LOW) <= (second & ~_LOW)
    place = np.where(left, s, s + (WIDTH - 1)) // WIDTH * WIDTH + (np.where(left, first, second) & _LOW).astype(np.int64)
    del to_end, from_start, first, second, left
    text = np.repeat(np.arange(len(texts)), size)[: len(s)]
    ok = s + LENGTH <= ends[text]
    s, place, text = s[ok], place[ok], text[ok]
    if not len(s):
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in ("text", "lo", "n", "ah", "ch")})
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    lo, text, anchor = s[new], text[new], place[new]
    n = np.diff(np.append(new, len(s)))
    covered = roll.at(lo, lo + n + LENGTH - 1) ^ mix(((anchor - lo) << 16 | n).astype(np.uint64))
    return pd.DataFrame({"text": text, "lo": lo - starts[text], "n": (anchor - lo) << 8 | n, "ah": gram[anchor].view(np.int64), "ch": covered.view(np.int64)})


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _runs(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "mark", "batch", "ah", "ch", "lo", "n"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [_bytes(t) for t in part["text"]]
            for a, z in batches([len(t) for t in texts]):
                got = runs_of(texts[a:z])
                rows = got.pop("text").to_numpy() + a
                yield got.assign(**{c: part[c].to_numpy()[rows] for c in ("doc_id", "mark", "batch")})[names]

    return spread(docs).mapInPandas(run, f"doc_id {kind}, mark long, batch int, ah long, ch long, lo int, n int")


class SpanIndex:
    """Levels of sorted anchors, each twice as large as the next; ``add`` scans and stores one batch of runs."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def _entries(self, runs: DataFrame) -> DataFrame:
        return runs.groupBy("ah").agg(F.sum("places").alias("places"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).sortWithinPartitions("ah")

    def add(self, runs: DataFrame) -> DataFrame:
        """Store the runs ``(ah, ch)`` of a batch; return the anchors it shares with itself or with what was there."""
        new = keep(self._entries(runs.select("ah", F.lit(1).cast("long").alias("places"), F.col("ch").alias("c0"), F.col("ch").alias("c1"))))
        shared = new.where("places > 1")
        for _, level in self.levels:
            both = new.alias("x").hint("merge").join(level.alias("y"), F.col("x.ah") == F.col("y.ah"))
            shared = shared.unionByName(both.select("x.ah", F.expr("x.places + y.places").alias("places"), F.least("x.c0", "y.c0").alias("c0"), F.greatest("x.c1", "y.c1").alias("c1")))
        self.found.append(keep(self._entries(shared)))
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            merged = keep(self._entries(old.unionByName(new)))
            forget(old)
            forget(new)
            new, size = merged, 2 * size
        self.levels.append((size, new))
        return self.found[-1]

    def anchors(self) -> DataFrame:
        """ah, places, mixed: every anchor that stands twice, and whether its runs cover different bytes. ``places`` may count
        a place again for each later batch that met it."""
        every = self.found[0]
        for more in self.found[1:]:
            every = every.unionByName(more)
        return self._entries(every).select("ah", "places", (F.col("c0") != F.col("c1")).alias("mixed"))


def _covered(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes that the listed runs cover: ah, many, lone, doc_id, mark, lo, at (the anchor's distance from lo), b. A repeated document gives them repeatedly."""
    kind = dict(rows.dtypes)["doc_id"]
    listed = keep(rows.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("ah", "many", "lone", "lo", "n")).alias("runs")))
    few = rows.count() <= LISTED
    listed = F.broadcast(listed) if few else listed.hint("shuffle_hash")
    if few:
        again = docs
    else:
        named = bounded(listed.select("doc_id", "mark"))
        again = docs.join(named, same(docs, named, "doc_id", "mark"), "left_semi")
    both = again.join(listed, same(again, listed, "doc_id", "mark")).select(again["doc_id"], again["mark"], "text", "runs")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, mark, text, runs in zip(part["doc_id"], part["mark"], part["text"], part["runs"], strict=True):
                data = _bytes(text)
                out += [(r["ah"], r["many"], r["lone"], doc, mark, r["lo"], r["n"] >> 8, data[r["lo"] : r["lo"] + (r["n"] & 255) + LENGTH - 1]) for r in runs]
            yield pd.DataFrame(out, columns=["ah", "many", "lone", "doc_id", "mark", "lo", "at", "b"])

    return both.mapInPandas(run, f"ah long, many long, lone boolean, doc_id {kind}, mark long, lo int, at int, b binary")


def windows_in(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the byte strings: string number, place in it, hash."""
    size = np.array([len(x) for x in rows], dtype=np.int64)
    n = size - LENGTH + 1
    who = np.repeat(np.arange(len(rows)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[who] + place
    return who, place, Rolling(np.frombuffer(b"".join(rows), dtype=np.uint8)).at(at, at + LENGTH)


def repeated_in(group: np.ndarray, lone: np.ndarray, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of lone strings that another string of the same group has: string number, first window, windows."""
    who, place, wh = windows_in(rows)
    key = wh ^ mix(group[who].view(np.uint64))
    order = np.argsort(key, kind="stable")
    pair = (np.diff(key[order]) == 0) & (np.diff(group[who[order]]) == 0) if len(order) else np.zeros(0, bool)
    hit = np.zeros(len(who) + 1, dtype=bool)
    hit[order[:-1][pair]] = hit[order[1:][pair]] = True
    hit[:-1] &= lone[who]
    return stretches(who, place, hit[:-1])


def stretches(who: np.ndarray, place: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hit windows: string number, first window, windows."""
    hit = np.append(hit, False)
    begin = np.flatnonzero(hit[:-1] & ((place == 0) | ~np.append(False, hit[:-2])))
    last = np.flatnonzero(hit[:-1] & (~hit[1:] | np.append(place[1:] == 0, True)))
    return who[begin], place[begin], last - begin + 1


def _compared(rows: DataFrame) -> DataFrame:
    """doc_id, mark, lo, n of the repeated windows of lone classes; the classes of an anchor meet in one task."""
    kind = dict(rows.dtypes)["doc_id"]

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        part = part[~part.duplicated(["ah", "doc_id", "mark", "lo"])]
        who, first, n = repeated_in(part["ah"].to_numpy(), part["lone"].to_numpy(dtype=bool), part["b"].tolist())
        return pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[who], "mark": part["mark"].to_numpy()[who], "lo": part["lo"].to_numpy()[who] + first, "n": n})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:
            part = part if left is None else pd.concat([left, part], ignore_index=True)
            whole = part["ah"].to_numpy() != part["ah"].iloc[-1]  # the last group may go on
            left = part[~whole]
            if whole.any():
                yield judge(part[whole])
        if left is not None:
            yield judge(left)

    return rows.drop("many").repartition("ah").sortWithinPartitions("ah").mapInPandas(run, f"doc_id {kind}, mark long, lo int, n int")


def pieces_of(ah: np.ndarray, at: np.ndarray, rows: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Byte strings cut by the distance of their windows from the anchor, in parts of ``width`` distances: string number, key
    (anchor, part, bytes that all windows of the part have in common), hash of what is covered, distance of the first window, its place, windows.

    Equal windows have their anchor at equal distances, so they are in the same part and have the same key."""
    size = np.array([len(x) for x in rows], dtype=np.int64)
    low = at - (size - LENGTH)
    n = at // width - low // width + 1
    who = np.repeat(np.arange(len(rows)), n)
    part = (low // width)[who] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near, far = np.maximum(low[who], part * width), np.minimum(at[who], part * width + width - 1)
    anchor = (np.cumsum(size) - size + at)[who]
    roll = Rolling(np.frombuffer(b"".join(rows), dtype=np.uint8))
    core = roll.at(anchor - part * width, anchor - (part * width + width - 1) + LENGTH)
    key = mix(core ^ mix(ah[who].view(np.uint64) ^ mix((part + 1).astype(np.uint64))))
    cover = roll.at(anchor - far, anchor - near + LENGTH) ^ mix((far << 16 | near).astype(np.uint64))
    return who, key.view(np.int64), cover.view(np.int64), far, at[who] - far, far - near + 1


def _pieces(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` cut by ``pieces_of``: a row for each part (at most one more than ``WIDTH`` / ``width``), whose ``ah`` is the key."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a, z in batches([len(b) for b in part["b"]]):
                some = part.iloc[a:z]
                b = some["b"].tolist()
                who, key, cover, far, first, n = pieces_of(some["ah"].to_numpy(), some["at"].to_numpy(dtype=np.int64), b, width)
                cols = {c: some[c].to_numpy()[who] for c in ("lone", "doc_id", "mark")}
                cut_ = [b[i][f : f + k + LENGTH - 1] for i, f, k in zip(who.tolist(), first.tolist(), n.tolist(), strict=True)]
                yield pd.DataFrame({"ah": key, "ch": cover, **cols, "lo": some["lo"].to_numpy()[who] + first, "at": far, "b": cut_})

    return rows.select("ah", "lone", "doc_id", "mark", "lo", "at", "b").mapInPandas(run, f"ah long, ch long, lone boolean, doc_id {kind}, mark long, lo int, at int, b binary")


def _refined(rows: DataFrame) -> DataFrame:
    """As ``_compared``, for anchors of any number of classes, which are cut into pieces by ever narrower parts.

    Pieces meet by anchor, part and the bytes that the part's windows have in common. Pieces that cover equal bytes repeat
    whole, and one of them stands for all; a key of one piece is done; up to ``LOCAL`` are compared in one task; more are cut
    again. Parts of one window have nothing left to compare."""
    rows, out = rows.dropDuplicates(["ah", "doc_id", "mark", "lo"]), []
    for width in WIDTHS:
        pieces = keep(_pieces(rows, width))
        one = F.min(F.struct("lone", "doc_id", "mark", "lo", "at", "b")).alias("one")
        covers = keep(pieces.groupBy("ah", "ch").agg(F.count("*").alias("size"), one).select("ah", "ch", "size", ((F.col("size") == 1) & F.col("one.lone")).alias("lone"), *(f"one.{c}" for c in ("doc_id", "mark", "lo", "at", "b"))))
        twice = lookup(pieces.where("lone"), covers.where("size > 1").select("ah", "ch", "size"), ["ah", "ch"], "size")
        out.append(twice.select("doc_id", "mark", "lo", (F.length("b") - (LENGTH - 1)).alias("n")))
        open_ = keep(covers.groupBy("ah").agg(F.count("*").alias("many"), F.max("lone").alias("some")).where("many > 1 and some").select("ah", "many"))
        left = keep(lookup(covers.drop("ch", "size"), open_, ["ah"], "many"))
        out.append(_compared(left.where(F.col("many") <= LOCAL)))
        rows = left.where(F.col("many") > LOCAL)
        if rows.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, out)


def repeats(docs: DataFrame, parts: int = BATCHES) -> DataFrame:
    """(doc_id, mark, lo, n): windows lo to lo + n - 1 of the document repeat. ``docs`` has doc_id, text, mark.

    The table is dealt into ``parts`` batches that the index takes one after the other; the result does not depend on them."""
    runs = keep(_runs(docs.select("doc_id", "mark", F.pmod(F.xxhash64("mark"), F.lit(parts)).cast("int").alias("batch"), "text")))
    index = SpanIndex()
    for k in range(parts):
        index.add(runs.where(F.col("batch") == k))
    shared = keep(lookup(runs.drop("batch"), keep(index.anchors()), ["ah"], "places"))
    forget(runs)
    for _, level in index.levels:
        forget(level)
    mixed = shared.where("mixed")
    one = F.min(F.struct("doc_id", "mark", "lo", "n")).alias("one")
    classes = keep(mixed.groupBy("ah", "ch").agg(F.count("*").alias("size"), one))
    twins = lookup(mixed, classes.where("size > 1").select("ah", "ch", "size"), ["ah", "ch"], "size")
    open_ = keep(classes.groupBy("ah").agg(F.min("size").alias("least"), F.count("*").alias("many")).where("least = 1").select("ah", "many"))
    rows = keep(_covered(docs, keep(lookup(classes, open_, ["ah"], "many").select("ah", "many", "one.*", (F.col("size") == 1).alias("lone")))))
    named = lambda df, n="n": df.select("doc_id", "mark", "lo", F.expr(n).cast("int").alias("n"))
    out = named(shared.where("not mixed"), "n & 255").unionByName(named(twins, "n & 255")).unionByName(named(_compared(rows.where(F.col("many") <= LOCAL))))
    large = rows.where(F.col("many") > LOCAL)
    return out if large.isEmpty() else out.unionByName(named(_refined(large)))


def cut(data: bytes, spans) -> tuple[bytes, int]:
    """What is left without the bytes of the repeated windows, and the number of maximal runs removed."""
    if spans is None or not len(spans):
        return data, 0
    step = np.zeros(len(data) + 1, dtype=np.int32)
    lo, n = np.array([s["lo"] for s in spans]), np.array([s["n"] for s in spans])
    np.add.at(step, lo, 1)
    np.add.at(step, lo + n + LENGTH - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    return np.frombuffer(data, dtype=np.uint8)[~gone].tobytes(), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())


def _batches(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(BATCHES, -(-size // BATCH_BYTES))


def _joined(docs: DataFrame) -> DataFrame:
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    # rows that repeat a document have the same spans: a set, so that their number is of no account
    found = keep(repeats(marked, _batches(docs)).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))).hint("shuffle_hash")
    return marked.join(found, same(marked, found, "doc_id", "mark"), "left").select(marked["doc_id"], "text", "spans")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs(doc_id, text)``.

    A null text is empty; texts under ``LENGTH`` bytes keep all; rows that repeat a document are copies of each other
    and lose every byte if long enough.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, text, spans in part.itertuples(index=False):
                kept, n = cut(data := _bytes(text), spans)
                out.append((doc, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs).mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the text that is left (bytes that no longer form a character are dropped)."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": [cut(_bytes(t), s)[0].decode("utf-8", "ignore") for t, s in zip(part["text"], part["spans"], strict=True)]})

    return _joined(docs).mapInPandas(run, f"doc_id {kind}, text string")
