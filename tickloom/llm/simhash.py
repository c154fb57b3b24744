"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit SimHash. Equal fingerprints are collapsed first,
so a group of copies is one row from then on. Each bit position carries a
non-zero vector of radius + 1 bits, and each of the 2**(radius + 1) - 1 masks
keeps the positions whose vector has an odd product with the mask's number
(Pagh, "CoveringLSH", 2016). For any two fingerprints that differ in at most
`radius` positions some mask avoids all of them, so they meet in that mask's
table: no link is lost. A bucket with more than SPLIT fingerprints is covered
again over the positions its mask left out, and again until the free positions
alone bound its size; nothing is capped. Within a bucket the links found are
reduced to a spanning forest, then components are contracted on the cluster.

`representatives` keeps one row of each group of near-duplicates: texts with a share LIKE or more of their distinct
five-word shingles in common. A 64-bit SimHash of shingles puts such texts nine bits apart on average, which no small
radius spans; of distinct words it puts them three bits apart. So each text gets PARTS SimHashes of its distinct words,
each covered to WORD_RADIUS bits: two texts meet if any of them is so near, and their shingles then decide. Before that,
shingles are counted over all distinct texts. One that no other text has is missing from any partner, so a text with more
than a share 1 - LIKE of such ones has no partner and takes no further part, and neither does a pair that has too many of
them together: what meets by chance goes, at a cost in proportion to the texts, and no link does. Then each text is
compared with some leaders of its buckets, which makes a large group of copies one component; then every pair that meets
and that no component holds yet is compared: nothing is capped.

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other (`representatives` has them as
equal); a very long text is hashed piece by piece; a text of fewer words than a shingle is one shingle; rows with equal
doc_id count as they are; a null doc_id is never the smallest of a component unless all are null; of tied rows the one
that stays has the smallest doc_id (nulls last), then text hash, then other columns, and of equal rows one stays; an
empty table gives an empty one; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_digest

from .common import bound_batches, forget, hashed_words, materialize, mix64, sized_batches, text_buffer, text_slices, trimming, window_hashes
from .components import components
from .tally import bucketed, distinct, sent, tallied, totals_of

RADIUS, SHINGLE, SEED = 2, 3, 42
#: A bucket of more fingerprints is covered again; the last level leaves so few free positions that it needs no bound.
SPLIT, LEVELS = 64, 3
#: Words hashed at a time; fits counters of 16 bits.
PIECE = 1 << 15
#: Near-duplicates: words of a shingle and the similarity that links, as a fraction of integers; SimHashes of words and the radius of each.
WORDS, LIKE, PARTS, WORD_RADIUS = 5, (4, 5), 4, 4
#: Eighths of all shingles that are counted over all texts, then over those left; any part gives a bound that loses no link.
COUNTED = (3, 8)
#: Longs of a text's sketch: bit i is the parity of its shingles whose hash falls on i.
SKETCH = 8
#: Turns, at most, in which each text meets up to LEADERS leaders of its buckets; pairs are listed once there are at most DENSE a bucket row.
TURNS, LEADERS, DENSE = 4, 16, 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    if len(words) < shingle:
        joined: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    while digests := b"".join(map(xxh64_digest, islice(joined, PIECE), repeat(SEED))):  # a long text's hashes are never held together
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp is the 64-bit fingerprint as a signed long."""

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "text"):
            fps = [simhash(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    rows = bound_batches(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    return rows.mapInArrow(run, schema)


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions such that any `radius` of them are avoided by some mask."""
    n = (1 << (radius + 1)) - 1
    vector = {p: 1 + i % n for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(level: int, radius: int) -> list[int]:
    """Masks of a level: those of the level before, each joined by the masks over what it leaves free."""
    masks = [0]
    for _ in range(level):
        masks = [m | x for m in masks for x in covering_masks([p for p in range(64) if not m >> p & 1], radius)]
    return masks


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (fingerprint, earlier one) that span the components of one bucket under distance <= radius."""
    fps = np.unique(fps)
    bits, out, left = fps.view(np.uint64), [], np.arange(1, len(fps))
    queue = [0]
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        near = np.bitwise_count(bits[left] ^ bits[at]) <= radius
        out += [(int(fps[x]), int(fps[at])) for x in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return out


def _spanning(buckets: DataFrame, radius: int) -> DataFrame:
    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [x for fps in batch.column(0) for x in _forest(np.array(fps.as_py(), np.int64), radius)]
            u, v = zip(*links, strict=True) if links else ((), ())
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return buckets.mapInArrow(run, "u long, v long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp) that span all components under distance <= radius."""
    edges, rest = None, fps.select("fp", F.lit(0).alias("t"))
    for level in range(1, LEVELS + 1):
        n = (1 << (radius + 1)) - 1
        masks = _tables(level, radius)
        # mask number t of this level continues mask t // n of the one before
        table = F.array(*[F.lit(signed(m)) for m in masks])
        step = F.explode(F.sequence(F.col("t") * n, F.col("t") * n + n - 1)).alias("t")
        keyed = rest.select("fp", step).select("fp", "t", F.col("fp").bitwiseAND(F.element_at(table, F.col("t") + 1)).alias("key"))
        sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
        keyed = keyed.join(sizes, ["t", "key"])
        small = keyed if level == LEVELS else keyed.filter(F.col("n") <= SPLIT)
        found = _spanning(small.groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps"), radius)
        edges = found if edges is None else edges.union(found)
        rest = keyed.filter(F.col("n") > SPLIT).select("fp", "t")
    return edges


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id reachable over links."""
    rows = materialize(signatures(docs, doc_id, text, shingle))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, radius))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(grouped.join(least, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, size: int = WORDS) -> set[bytes]:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)))


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the Jaccard similarity is at least LIKE; two empty sets are equal."""
    shared = len(a & b)
    return shared * LIKE[1] >= (len(a) + len(b) - shared) * LIKE[0]


def _distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(44 bits of each text's distinct hashes, the text of each), ordered by text."""
    keys = np.sort(text.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    return keys & np.uint64((1 << 44) - 1), (keys >> np.uint64(44)).astype(np.int64)


def _bit_sums(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words of each run have each of 64 bits; four counters of 16 bits are summed at a time."""
    out = np.empty((len(starts), 4, 16), np.int64)
    for j in range(16):
        lanes = np.add.reduceat(words >> np.uint64(j) & np.uint64(0x0001000100010001), starts)
        out[:, :, j] = lanes.view("<u2").reshape(-1, 4)
    return out.reshape(-1, 64)


def word_prints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct shingles, PARTS SimHashes of the distinct words) of each of 2**20 texts at most.

    About a megabyte of text, or one longer text, is hashed at a time. The numbers of shingles are those of their hashes.
    """
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    sizes, prints = np.zeros(n, np.int64), np.zeros((n, PARTS), np.uint64)
    for lo, hi in text_slices(offsets):
        words, firsts = hashed_words(_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo])
        text = np.repeat(np.arange(hi - lo), np.diff(firsts))
        runs, inside = window_hashes(words, WORDS), text[: max(0, len(words) - WORDS + 1)] == text[WORDS - 1 :]
        owner = text[: len(inside)][inside]
        sizes[lo:hi] = np.maximum(np.bincount(_distinct(runs[inside], owner)[1], minlength=hi - lo), np.diff(firsts) > 0)
        words, text = _distinct(words, text)
        counts = np.zeros((hi - lo, PARTS, 64), np.int64)
        for at in range(0, len(words), PIECE):
            piece, owner = words[at : at + PIECE], text[at : at + PIECE]
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            for k in range(PARTS):
                counts[owner[starts], k] += _bit_sums(mix64(piece + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), starts)
        over = 2 * counts > np.bincount(text, minlength=hi - lo)[:, None, None]
        prints[lo:hi] = np.packbits(over, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    return sizes, prints


def _runs(column: pa.Array | pa.ChunkedArray, eighths: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, in order, the text of each, number of each text's shingles).

    With less than eight eighths, hashes are those of that part of all shingles, and repeats are in the numbers.
    """
    data, offsets = text_buffer(column)
    keys, owners, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in text_slices(offsets):
        words, firsts = hashed_words(_LOWER[data[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo])
        n = np.diff(firsts)
        text = np.repeat(np.arange(lo, hi), n)
        runs = window_hashes(words, WORDS)
        inside = text[: len(runs)] == text[WORDS - 1 :]
        few = np.flatnonzero((n > 0) & (n < WORDS))  # fewer words than a shingle: one shingle
        few_runs = [window_hashes(words[firsts[i] : firsts[i + 1]], int(n[i]), int(n[i])) for i in few]
        hashes, text = np.concatenate([runs[inside], *few_runs]), np.concatenate([text[: len(runs)][inside], few + lo])
        sizes[lo:hi] = np.bincount(text - lo, minlength=hi - lo)
        if eighths < 8:
            part = hashes & np.uint64(7) < eighths
            hashes, text = hashes[part], text[part]
        order = np.lexsort((hashes, text))
        hashes, text = hashes[order], text[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
        keys.append(hashes[new])
        owners.append(text[new])
        if eighths == 8:
            sizes[lo:hi] = np.bincount(text[new] - lo, minlength=hi - lo)
    return np.concatenate(keys), np.concatenate(owners), sizes


def sketches(runs: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """SKETCH longs for each of n texts; two texts' sketches differ in no more bits than their sets of shingles in shingles."""
    bits = 64 * SKETCH
    place = text * bits + (runs >> np.uint64(32)).astype(np.int64) % bits
    odd = np.bincount(place, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(n, SKETCH, 64), axis=2, bitorder="little").view(np.int64)[:, :, 0]


def _send_runs(table: pa.Table, ranges: int, eighths: int) -> pa.Table:
    keys, _, counts, _ = distinct(_runs(table["text"], eighths)[0])
    return sent(table["b"][0].as_py(), keys, None, np.minimum(counts, 2), ranges)


def _with_partners(table: pa.Table, totals: pa.Table, eighths: int) -> pa.Table:
    """h, text, n (shingles), own (those counted that no other text has), prints and sketch of a bucket's texts that can have a partner."""
    runs, text, sizes = _runs(table["text"], eighths)
    _, _, _, place = distinct(runs)
    own = np.bincount(text[totals_of(totals, "u1")[place] == 1], minlength=len(sizes))
    stay = own * LIKE[1] <= sizes * (LIKE[1] - LIKE[0])
    texts, left = table["text"].filter(pa.array(stay)).combine_chunks(), int(stay.sum())
    prints = sketch = np.zeros((left, 0), np.int64)
    if eighths == COUNTED[-1]:  # the last count is over few texts: only they get prints
        prints, sketch = word_prints(texts)[1].view(np.int64), sketches(runs, text, len(sizes))[stay]
    lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(left + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel()))
    h = pc.struct_field(table["row"], "h").filter(pa.array(stay))
    return pa.table([h, texts, pa.array(sizes[stay]), pa.array(own[stay]), lists(prints), lists(sketch)], ["h", "text", "n", "own", "prints", "sketch"])


WITH_PARTNERS = "h long, text string, n long, own long, prints array<long>, sketch array<long>"


def with_partners(texts: DataFrame) -> DataFrame:
    """Those of the distinct texts (h, text) that others may be alike to, as a written table with n, own, prints and sketch; loses none that has a partner."""
    left = materialize(texts.groupBy("h").agg(F.first("text").alias("text")))
    for eighths in COUNTED:
        dealt = bucketed(left)
        totals = tallied(dealt.gather(lambda table, ranges, e=eighths: _send_runs(table, ranges, e)), most=2)
        counted = dealt.with_totals(totals, lambda table, given, e=eighths: _with_partners(table, given, e), WITH_PARTNERS)
        before, left = left, materialize(counted if eighths == COUNTED[-1] else counted.select("h", "text"))
        forget(before)
    return left


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose texts are alike; hashes of their shingles refuse most of the others."""

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "b"):
            us, vs = (batch.column(i).to_numpy() for i in (0, 1))
            # rows of one u mostly follow each other
            new = np.diff(us, prepend=~us[:1]) != 0
            first, mine = np.flatnonzero(new), np.cumsum(new) - 1
            a, b = batch.column("a").take(pa.array(first)), batch.column("b")
            (runs1, text1, _), (runs2, text2, _) = _runs(a), _runs(b)
            cuts1, cuts2 = np.searchsorted(text1, np.arange(len(a) + 1)), np.searchsorted(text2, np.arange(len(b) + 1))
            good, at, whole = np.zeros(len(us), bool), -1, set()
            for i, j in enumerate(mine.tolist()):
                one, two = runs1[cuts1[j] : cuts1[j + 1]], runs2[cuts2[i] : cuts2[i + 1]]
                place = np.searchsorted(one, two)
                place[place == len(one)] = 0
                shared = int(np.count_nonzero(one[place] == two)) if len(one) else 0
                if shared * LIKE[1] >= (len(one) + len(two) - shared) * LIKE[0]:
                    if j != at:
                        at, whole = j, shingles(a[j].as_py())
                    good[i] = alike(whole, shingles(b[i].as_py()))
            yield pa.record_batch([pa.array(us[good]), pa.array(vs[good])], ["u", "v"])

    side = lambda h, text: texts.select(F.col("h").alias(h), F.col("text").alias(text))
    rows = bound_batches(pairs).join(side("v", "b"), "v").join(side("u", "a"), "u").select("u", "v", "a", "b")
    return rows.mapInArrow(run, "u long, v long")


def _near(one: Column, two: Column) -> Column:
    return F.bit_count(one.bitwiseXOR(two)) <= WORD_RADIUS


def _may_be_alike(one: Column, two: Column) -> Column:
    """False only for pairs that cannot be alike, by n, own and sketch of both (fields of structs).

    Alike are texts with (LIKE[1] + LIKE[0]) * d <= (LIKE[1] - LIKE[0]) * (n1 + n2), d being the shingles that one of them
    lacks. Each lacks the other's own ones, what one has more than the other follows from n1 - n2, and d is no less than
    the bits in which the sketches differ.
    """
    n1, n2 = one["n"], two["n"]
    differ = [F.bit_count(one["sketch"][f"s{i}"].bitwiseXOR(two["sketch"][f"s{i}"])) for i in range(SKETCH)]
    least = F.greatest(2 * one["own"] - n1 + n2, 2 * two["own"] - n2 + n1, sum(differ[1:], differ[0]).cast("long"))
    return least * (LIKE[1] + LIKE[0]) <= (n1 + n2) * (LIKE[1] - LIKE[0])


def alike_links(texts: DataFrame) -> DataFrame:
    """(u, v): links among the distinct texts (columns h and text; rows may repeat) that span the components of the pairs that meet and are alike."""
    masks = covering_masks(list(range(64)), WORD_RADIUS)
    wanted = with_partners(texts)
    table, n = F.array(*[F.lit(signed(m)) for m in masks]), len(masks)
    sketch = F.struct(*[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]).alias("sketch")
    keyed = wanted.select("h", F.struct("n", "own", sketch).alias("set"), "prints", F.explode(F.sequence(F.lit(0), F.lit(PARTS * n - 1))).alias("t"))
    keyed = keyed.select("h", "set", "t", F.element_at("prints", F.floor(F.col("t") / n).cast("int") + 1).alias("fp"))
    keyed = keyed.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.element_at(table, F.col("t") % n + 1))).alias("key"), "h", "set", "fp")
    shared = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select("key")
    left = materialize(keyed.join(shared, "key").withColumn("root", F.col("h")))
    edges: list[DataFrame] = []  # what is linked so far, as links of each text to its component's root
    for turn in range(TURNS):
        # a bucket's leader, another in each turn; buckets of one component are done
        leader = F.min(F.struct(F.xxhash64(F.lit(turn), "h").alias("lot"), "h", "set", "fp", "root")).alias("lead")
        leads = left.groupBy("key").agg(leader, F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key", "lead")
        held = left.join(leads, "key")
        sizes = held.groupBy("key").agg(F.count("*").alias("size"))
        rows, pairs = sizes.agg(F.sum("size"), F.sum(F.col("size").cast("double") * (F.col("size") - 1) / 2)).first()
        if not rows or turn and pairs <= DENSE * rows:
            break
        may = _near(F.col("fp"), F.col("lead.fp")) & _may_be_alike(F.col("set"), F.col("lead.set"))
        close = held.filter((F.col("root") != F.col("lead.root")) & may).select("h", F.col("lead.h").alias("u")).distinct()
        order = Window.partitionBy("h").orderBy(F.xxhash64("h", "u"))
        close = close.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEADERS)
        found = materialize(_verified(close.select("u", F.col("h").alias("v")), wanted))
        linked = materialize(components(_union([*edges, found])).select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = linked.select(F.col("u").alias("h"), F.col("v").alias("root"))
        now = held.select("key", "h", "set", "fp").join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
        before, left = left, materialize(now)
        forget(before, found, *edges)
        edges = [linked]
    side = lambda x: left.select("key", *[F.col(c).alias(f"{c}{x}") for c in ("h", "set", "fp", "root")])
    may = _near(F.col("fp1"), F.col("fp2")) & _may_be_alike(F.col("set1"), F.col("set2"))
    pairs = side(1).join(side(2), "key").filter((F.col("h1") < F.col("h2")) & (F.col("root1") != F.col("root2")) & may)
    found = materialize(_verified(pairs.select(F.col("h1").alias("u"), F.col("h2").alias("v")).distinct(), wanted))
    forget(left, wanted)
    return _union([*edges, found])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.union(table)
    return out


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when one row of each group of near-duplicates does, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    field = lambda c: F.col(f"row.`{c}`")
    whole = whole.select(F.xxhash64(F.coalesce(field(text), F.lit(""))).alias("h"), "row")
    roots = materialize(components(alike_links(whole.select("h", field(text).alias("text")))).withColumnRenamed("node", "h"))
    rest = [field(c) for c, kind in docs.dtypes if c not in (doc_id, text) and "map<" not in kind]
    order = F.struct(field(doc_id).isNull(), field(doc_id), "h", *rest)
    # copies of a text first, so that a large component's rows are summed up where they lie
    first = whole.groupBy("h").agg(F.min_by("row", order).alias("row"))
    alone = first.join(roots, "h", "left_anti").select("row")
    joined = first.join(roots, "h").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row")
    return alone.union(joined).select(*[field(c).alias(c) for c in docs.columns])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def component_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
