"""N-gram Jaccard self-join in size-banded tiles with hashed bitmap signatures.

1. Every text becomes a set of 64-bit shingle hashes.  Identical sets are one representative.
2. Sizes fall into bands (powers of two).  In a band, hash space is cut into more parts than two
   linking sets of that band can differ in, so that two linking sets agree on one non-empty part
   at least; a *tile* is a band, a part and what a set has in that part.  A set enters its own
   band's tiles, and the band's below if a set there can be large enough.  A set with too few
   non-empty parts also enters its band's tile for such sets.  So every link lies in some tile.
3. A set with e non-empty parts that may differ from a partner in D of them shares e - D tiles with
   it, so it may leave its e - D - 1 most frequent tiles: of the tiles that two linking sets share,
   neither leaves the least frequent.  Tiles of common passages empty that way, at no loss.
4. Each set is first compared with the least set of the tiles that it shares most with, and with
   the one other set of tiles that hold two.  Bitmap
   signatures (a bit is the parity of the set's hashes in its place) bound the intersection from
   above: a bit that differs stands for a shingle of one set alone.  Pairs that may still link have
   their sorted arrays intersected.
5. What is connected already needs no more comparisons.  Tiles that still hold several components
   are compared across these, again by bitmaps and then exactly.  First rounds take as few pairs
   of a tile as would connect all that bitmaps leave open; when most of these no longer link,
   rounds with a growing allowance follow until no pair is left over.  So a group of thousands of
   near copies costs a few spanning trees of comparisons, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import BoundedWords, byte_blocks, discard, materialise, text_or_empty, tidy
from docloom.llm.components import connected_components

#: Bits of a signature for each shingle, and bytes of the largest signature.
BITS_EACH, MOST_BYTES = 2, 2_048
#: Rows of a tile that are held at once while components are compared.
BLOCK = 4_096
FIRST_ALLOWANCE = 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(BoundedWords):
    """Hashes of words."""

    def value(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def shingle_set(text: bytes, n: int, words: dict) -> np.ndarray:
    """The sorted distinct hashes of the ``n``-word shingles of ``text``.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``; fewer words are one shingle, none
    give the empty set.
    """
    split = text.lower().split()
    count = len(split)
    if not count:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, split), np.uint64, count)
    width = min(n, count)
    total = np.full(count - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total + hashes[i : count - width + 1 + i])
    total.sort()
    if count > width:
        total = total[np.concatenate(([True], total[1:] != total[:-1]))]
    return total


def _parts(band: int, num: int, den: int) -> int:
    """How many parts the hash space has in a band, at a threshold of num/den."""
    return (108 * (((2 << band) - 1) * (den - num) // num + 1) + 99) // 100 + 6


def tile_keys(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Keys of the tiles of a set, and how many of the even and of the odd ones it may leave.

    A key has 48 bits, the lowest is that of the band's number.  A set that can link with none but
    its equals has no keys.
    """
    n, spare = len(hashes), [0, 0]
    if n * den < num * (n + 1):  # not even a superset with one more shingle would link
        return np.empty(0, np.uint64), spare
    own, differ = n.bit_length() - 1, n * (den - num) // num
    high, mixed = hashes >> np.uint64(32), np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(hashes + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)))
    keys = []
    for band in (own, own - 1):
        if band < 0 or (band < own and n * num > ((1 << own) - 1) * den):
            continue
        part = (high * np.uint64(_parts(band, num, den))) >> np.uint64(32)
        starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        ends = np.append(starts[1:], n)
        held = mixed[ends] - mixed[starts]
        tile = np.unique(_key(_mixed(held + _mixed(part[starts] * np.uint64(64) + np.uint64(band)) + (ends - starts).astype(np.uint64)), band))
        if len(tile) > differ:
            spare[band & 1] = len(tile) - differ - 1
        else:
            tile = np.unique(np.append(tile, _key(_mixed(np.array([(1 << 40) + band], np.uint64)), band)))
        keys.append(tile)
    return np.concatenate(keys), spare


def _key(mixed: np.ndarray, band: int) -> np.ndarray:
    return (mixed >> np.uint64(17) << np.uint64(1)) | np.uint64(band & 1)


def bitmap(hashes: np.ndarray) -> bytes:
    """The signature of a set: parities of its hashes modulo a power of two that grows with the set, so
    that a longer one can be folded to a shorter one's length."""
    size = min(8 * MOST_BYTES, max(64, 1 << (BITS_EACH * len(hashes)).bit_length()))
    counts = np.bincount((hashes & np.uint64(size - 1)).astype(np.intp), minlength=size)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def folded(signature: np.ndarray, size: int) -> np.ndarray:
    """A signature of bytes as one of ``size`` bytes."""
    return np.bitwise_xor.reduce(signature.reshape(-1, size), 0)


def may_link(n: int | np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of sizes ``n`` and ``m`` may link, and the most that they can share.

    A bit that differs stands for a shingle that one of the sets alone has, at least.
    """
    most = np.minimum(np.minimum(n, m), (n + m - np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)) // 2)
    return den * most >= num * (n + m - most), most


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _sum64(x: np.ndarray) -> int:
    return int(np.sum(x, dtype=np.uint64).astype(np.int64)) if len(x) else 0


def _fingerprints(hashes: np.ndarray) -> tuple[int, int]:
    return _sum64(_mixed(hashes ^ _M2)), _sum64(_mixed(hashes + _M1))


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(id, digest, n, f1, f2, even, odd, keys) of each document (id, text, digest): size and fingerprints
    of its set, how many even and odd tiles it may leave, and its tiles."""
    names = ["id", "digest", "n", "f1", "f2", "even", "odd", "keys"]
    schema = pa.schema([*((c, pa.int64()) for c in names[:-1]), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in byte_blocks(batches, 1, 4_000_000):
            rows, keys = [], []
            for text in batch.column(1):
                hashes = shingle_set(text.as_buffer().to_pybytes(), n, words)
                tiles, spare = tile_keys(hashes, num, den)
                rows.append((len(hashes), *_fingerprints(hashes), *spare))
                keys.append(_signed(tiles))
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), lists], schema=schema)

    return docs.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names[:-1]) + ", keys array<long>")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, bitmap, hashes) of each row (id, text, n, f1, f2) whose text has the set of that size and
    these fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in byte_blocks(batches, 1, 4_000_000):
            sets, kept = [], []
            for i, (text, *given) in enumerate(zip(batch.column(1), *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                hashes = shingle_set(text.as_buffer().to_pybytes(), n, words)
                if [len(hashes), *_fingerprints(hashes)] == given:
                    sets.append(hashes)
                    kept.append(i)
            if not kept:
                continue
            sizes = [len(s) for s in sets]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(_signed(np.concatenate(sets))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(sizes, pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), lists], names=["id", "n", "bitmap", "hashes"])

    return docs.mapInArrow(tidy(run), "id long, n long, bitmap binary, hashes array<long>")


def _bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint8)


def _open_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that bitmaps leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for i, (n, m, x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)):
                x, y = _bytes(x), _bytes(y)
                size = min(len(x), len(y))
                if may_link(n, m, folded(x, size), folded(y, size), num, den)[0]:
                    hits.append(i)
            if hits:
                yield batch.select(["a", "b"]).take(pa.array(hits))

    side = lambda end: sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("bitmap").alias(f"bitmap_{end}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.where((den * F.least("n_a", "n_b")) >= num * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b").mapInArrow(tidy(run), "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
            hits = []
            for i in range(batch.num_rows):
                x, y = (v[o[i] : o[i + 1]] for v, o in flat)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int(np.count_nonzero(y[at] == x)) if len(y) else 0
                if common and den * common >= num * (len(x) + len(y) - common):
                    hits.append(i)
            if hits:
                yield batch.select(["a", "b"]).take(pa.array(hits))

    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("s")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("t")), "b").select("a", "b", "s", "t")
    return both.mapInArrow(tidy(run), "a long, b long")


def _across(tiles: DataFrame, allowance: int, num: int, den: int) -> DataFrame:
    """(a, b, more): pairs of a tile's components that bitmaps leave open.

    ``tiles``: (tile, side, id, n, component, bitmap); a tile's rows in ``side`` 0 are compared
    with each other, or, where there is a side 1, with those.  For a row and a component of the
    others, the likeliest ``allowance`` pairs are given; ``more`` says that there were more.  An
    allowance of 0 gives a spanning forest of a tile's components over its open pairs.
    """

    def compare(table: pa.Table) -> tuple[list[int], list[int], list[bool]]:
        side, ids, sizes, comps = (table.column(c).to_numpy() for c in ("side", "id", "n", "component"))
        raw = [_bytes(x) for x in table.column("bitmap")]
        width = min(map(len, raw))
        words = np.stack([folded(x, width) for x in raw]).view(np.uint64)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(side)), None)
        out: tuple[list[int], list[int], list[bool]] = ([], [], [])
        comps = comps.copy()  # a forest's pairs join components
        for k, i in enumerate(left):
            others = left[k + 1 :] if right is None else right
            others = others[(comps[others] != comps[i]) & (sizes[others] * den >= num * sizes[i]) & (sizes[i] * den >= num * sizes[others])]
            if not len(others):
                continue
            fits, most = may_link(sizes[i], sizes[others], words[i], words[others], num, den)
            others, most = others[fits], most[fits]
            if not len(others):
                continue
            order = np.lexsort((-most / (sizes[i] + sizes[others] - most), comps[others]))
            ranked = others[order]
            starts = np.flatnonzero(np.concatenate(([True], comps[ranked][1:] != comps[ranked][:-1])))
            place = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
            near = ids[ranked[place < max(1, allowance)]]
            if not allowance:
                comps[np.isin(comps, comps[ranked[starts]])] = comps[i]
            out[0].extend(np.minimum(near, ids[i]).tolist())
            out[1].extend(np.maximum(near, ids[i]).tolist())
            out[2].extend([bool((place >= allowance).any())] * len(near))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish() -> Iterator[pa.RecordBatch]:
            if held:
                a, b, more = compare(pa.Table.from_batches(held))
                held.clear()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], names=["a", "b", "more"])

        now = None
        for batch in batches:
            tile = np.array(batch.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)] if len(tile) else [0]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if tile[s] != now:
                    yield from finish()
                    now = tile[s]
                held.append(batch.slice(s, e - s))
        yield from finish()

    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(tidy(run), "a long, b long, more boolean")


def _blocks(members: DataFrame) -> DataFrame:
    """Tiles of about BLOCK rows at most as they are; of larger ones a tile for each two blocks of rows."""
    large = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1")
    if large.isEmpty():
        return members.select(F.col("key").cast("string").alias("tile"), F.lit(0).cast("long").alias("side"), "id", "n", "component")
    large = materialise(large, "large", few=True)
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    dealt = members.join(large, "key", "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select(F.concat_ws(":", "key", low, high).alias("tile"), F.when((low == high) | (F.col("block") == low), 0).otherwise(1).cast("long").alias("side"), "id", "n", "component")


def _ends(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) with their components (ca, cb)."""
    end = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    both = pairs.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    return both.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links; only components that these touch are contracted."""
    over = connected_components(_ends(links, groups).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    known = groups.unionByName(over.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
    moved = known.join(over.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left")
    return materialise(moved.select("id", F.coalesce("top", "component").alias("component")), "groups", few=True)


def jaccard_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of distinct
    ``n``-word shingles (``threshold`` = num, den); component_id is the smallest doc_id that links
    reach.  The threshold is over a half.  Texts without words (null, empty, blank) have an empty set and link with nothing: their
    component_id is their own doc_id.  Texts with fewer words than ``n`` have one shingle.  Rows
    with a null doc_id count in no group: component_id is null.  Rows that repeat a doc_id are all
    returned, each with its own text's set and component; they link by their texts only.  Other columns are ignored; no rows give no rows.
    """
    num, den = threshold
    read = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().cast("binary").alias("text")).withColumn("digest", F.xxhash64("text"))
    signs = materialise(_signatures(read, n, num, den), "signatures")
    same = ["n", "f1", "f2"]
    # A set is a node of its own number, whatever doc_ids its texts have; of its rows, the least stands for it.
    least = signs.where("n > 0 and id is not null").groupBy(*same).agg(F.min(F.struct("id", "digest")).alias("row"))
    firsts = materialise(least.select(*same, "row.id", "row.digest").withColumn("node", F.monotonically_increasing_id()), "firsts", few=True)
    members = signs.select("id", *same).join(firsts.select(*same, "node", F.col("id").alias("least")), same, "left").select("id", "n", "node", "least")
    members = materialise(members, "members", few=True)
    tiles = _tiles(signs, firsts, same)

    wanted = firsts.join(tiles.select(F.explode(F.array("id", "pivot")).alias("node")).distinct(), "node")
    texts = read.join(wanted.select("id", "digest", "node", *same), ["id", "digest"]).dropDuplicates(["id", "digest"])
    sets = materialise(_sets(texts.select(F.col("node").alias("id"), "text", *same), n), "sets")
    groups = _components(tiles, sets, num, den)
    discard(tiles, sets)

    named = groups.withColumnRenamed("id", "node")
    tops = named.join(firsts.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("top"))
    joined = members.join(named.join(tops, "component").select("node", "top"), "node", "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("top", "least", "id"))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _tiles(signs: DataFrame, firsts: DataFrame, same: list[str]) -> DataFrame:
    """(key, id, n, pivot, rows) of each set's tiles that other sets share, but for the most frequent
    that it may leave; ``pivot`` and ``rows`` are the least set and the number of sets with that key.

    ``signs`` is deleted as soon as its keys are not needed.
    """
    keyed = signs.where(F.size("keys") > 0).select("id", "digest", *same, "even", "odd", "keys")
    # Of rows that repeat a text, one brings the keys.
    alone = materialise(keyed.join(firsts, ["id", "digest", *same]).select("node", "n", "even", "odd", "keys").dropDuplicates(["node"]), "keyed")
    discard(signs)
    rows = alone.select(F.explode("keys").alias("key"), F.col("node").alias("id"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("pivot")).where("rows > 1")
    both = rows.join(shared, "key").join(alone.select(F.col("node").alias("id"), "n", "even", "odd"), "id")
    odd = F.col("key").bitwiseAND(F.lit(1))
    hottest = Window.partitionBy("id", odd).orderBy(F.desc("rows"), "key")
    left = both.withColumn("place", F.row_number().over(hottest)).where(F.col("place") > F.when(odd == 1, F.col("odd")).otherwise(F.col("even")))
    tiles = materialise(left.select("key", "id", "n", "pivot", "rows"), "tiles", few=True)
    discard(alone)
    return tiles


def _components(tiles: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, component) of the sets that link."""
    # First each set and the pivot that it shares most tiles with, and pairs that are a tile by themselves.
    pairs = tiles.where("pivot <> id").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b"))
    star = materialise(pairs.agg(F.count(F.lit(1)).alias("shared"), F.min("rows").alias("least")), "star", few=True)
    nearest = star.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    first = nearest.unionByName(star.where("least = 2").select("a", "b")).distinct()
    # Written in between, as two Python steps in one task would take two workers.
    opened = materialise(_open_pairs(first, sets, num, den), "open", few=True)
    groups = connected_components(_linked(opened, sets, num, den))
    spread = tiles.where("rows > 2").select("key", "id", "n")
    allowance = 0
    while True:
        labelled = spread.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        left = materialise(labelled.join(mixed, "key", "left_semi").select("key", "id", "n", "component"), "left", few=True)
        rows = _blocks(left).join(sets.select("id", "bitmap"), "id").select("tile", "side", "id", "n", "component", "bitmap")
        found = materialise(_across(rows, allowance, num, den), "across", few=True)
        discard(left)
        if found.isEmpty():
            return groups
        tried = found.select("a", "b").distinct()
        links = materialise(_linked(tried, sets, num, den), "linked", few=True)
        joined = links.count()
        if joined:
            groups = _joined(groups, links)
        if allowance:
            if found.where("more").isEmpty():
                return groups
            allowance *= 8
        elif 2 * joined < tried.count():
            allowance = FIRST_ALLOWANCE
        discard(found, links)


def one_of_each(docs: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's; rows without doc_id stay."""
    stay = components.where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("__doc"))
    kept = row.join(stay, F.col("__doc") == F.col("__id"), "left_semi")
    return kept.unionByName(row.where("__doc is null")).select("row.*")
