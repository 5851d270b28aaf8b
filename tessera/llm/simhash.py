"""SimHash near-dedup with bit-sliced comparison.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits; components are the
transitive closure. Work is done on distinct fingerprints, each with its smallest doc_id,
so exact copies cost one aggregation.

Candidates: the 64 bits are cut into parts, of which at least ``parts - radius`` are equal
in any linked pair, so each choice of that many parts is a bucket key. A bucket with more
than ``BUCKET`` members is cut again by its free bits (radius + 1 parts, one of them
equal), until it is small: with few free bits left it has few members, so no bucket is
ever cut off. Inside a bucket, bit planes are stored vertically, one 64-bit word for 64
members; members are compared with those ``shift`` lanes on, by carry-save counters over
the planes, until all lanes have passed the radius. A bucket yields a star of its linked
members, never its pairs.

Defined results: a null text is empty; no words give fingerprint zero; a null doc_id is
ignored when the smallest is taken, and its component_id is that of its component (null
if no id in it is known); repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

BUCKET = 1024
#: Members of consecutive buckets that are compared in one go.
LANES = 1 << 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text: majority of the bits of its shingles' XXH64 (seed 42)."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(shingle, len(words))
    starts = [0, *[e + 1 for e in ends]]
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :], strict=False)], dtype=">u8")
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = np.array([simhash(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    C.ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"))
    return base.mapInArrow(_fingerprint_rows(shingle), "doc_id long, fp long")


# --- bit-sliced comparison ----------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 lanes to a word."""
    lanes = -(-max(len(fps), 1) // 64) * 64
    padded = np.zeros(lanes, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def _shifted(p: np.ndarray, shift: int) -> np.ndarray:
    """Lane i of the result is lane i + shift of p; lanes from past the end are zero."""
    whole, rest = divmod(shift, 64)
    out = np.zeros_like(p)
    n = p.shape[-1] - whole
    if n <= 0:
        return out
    out[..., :n] = p[..., whole:]
    if rest:
        out >>= np.uint64(rest)
        out[..., : n - 1] |= p[..., whole + 1 :] << np.uint64(64 - rest)
    return out


def within(p: np.ndarray, shift: int, radius: int, valid: np.ndarray) -> np.ndarray:
    """Lanes (packed) that differ from the lane ``shift`` on in at most ``radius`` bits."""
    return _compare(p, shift, radius, valid)[0]


def linked(p: np.ndarray, shift: int, radius: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of such lanes among those marked in ``same``, and their distances."""
    valid = np.zeros(p.shape[1] * 64, dtype=np.uint8)
    valid[: len(same)] = same
    ok, digits = _compare(p, shift, radius, np.packbits(valid, bitorder="little").view("<u8"))
    a = np.flatnonzero(np.unpackbits(ok.view(np.uint8), bitorder="little"))
    distance = np.zeros(len(a), dtype=np.int64)
    for k, d in enumerate(digits):
        distance += (d[a // 64] >> (a % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64) << k
    return a, distance


def _compare(p: np.ndarray, shift: int, radius: int, valid: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    q = _shifted(p, shift)
    digits = [np.zeros(p.shape[1], dtype=np.uint64) for _ in range((radius + 1).bit_length())]
    over = ~valid
    limit = radius + 1
    for b in range(64):
        carry = p[b] ^ q[b]
        for d in digits:
            d ^= carry
            carry = carry & ~d
        over |= carry
        if b % 8 == 7:
            reached = _at_least(digits, limit)
            over |= reached
            if bool((over == np.uint64(0xFFFFFFFFFFFFFFFF)).all()):
                break
    return ~over, digits


def _at_least(digits: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter (bits in ``digits``, low first) is at least ``limit``."""
    more, same = np.zeros_like(digits[0]), np.full_like(digits[0], 0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(digits))):
        if limit >> k & 1:
            same &= digits[k]
        else:
            more |= same & digits[k]
    return more | same


def link_stars(bucket: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For each member the first member of its bucket that it is linked to, by any path.

    ``bucket`` numbers the buckets, members of one bucket are next to each other.
    """
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return parent
    p = planes(fps)
    _, size = np.unique(bucket, return_counts=True)
    for shift in range(1, int(size.max())):
        same = bucket[shift:] == bucket[:-shift]
        if not same.any():
            break
        a, _ = linked(p, shift, radius, same)
        b = a + shift
        while len(a):
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent


def _star_rows(radius: int):
    def flush(val, fps, node) -> pa.RecordBatch:
        bucket = np.cumsum(np.concatenate(([True], val[1:] != val[:-1])))
        root = link_stars(bucket, fps.view(np.uint64), radius)
        # the root with the smallest node is as good as any: members are sorted by it
        far = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "val", "fp", "node")))
            total += batch.num_rows
            if total < LANES:
                continue
            mask, val, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            key = mask.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ C.mix(val.view(np.uint64))
            last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
            if last:
                yield flush(key[:last], fp[:last], node[:last])
            held, total = [(mask[last:], val[last:], fp[last:], node[last:])], len(mask) - last
        if total:
            mask, val, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            yield flush(mask.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ C.mix(val.view(np.uint64)), fp, node)

    return run


# --- candidate buckets ----------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [[int(b) for b in x] for x in np.array_split(np.array(bits, dtype=int), parts) if len(x)]


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def bucket_masks(radius: int, parts: int) -> list[int]:
    groups = _split(list(range(64)), parts)
    return [_mask(b for g in chosen for b in g) for chosen in combinations(groups, parts - radius)]


def _finer(mask: int, radius: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | _mask(g) for g in _split(free, radius + 1)]


def stars(nodes: DataFrame, radius: int = 2, parts: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v), u > v, that join just the nodes (node, fp distinct) within the radius."""
    C.ship(nodes.sparkSession)
    masks = bucket_masks(radius, parts)
    rows = nodes.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp", "node")
    out = None
    while True:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp", "node")
        sizes = rows.groupBy("mask", "val").count().where("count > 1")
        rows = C.cut(rows.join(sizes, ["mask", "val"]))
        small = rows.where(F.col("count") <= bucket).drop("count")
        found = (
            small.repartition("mask", "val")
            .sortWithinPartitions("mask", "val", "node")
            .mapInArrow(_star_rows(radius), "u long, v long")
        )
        out = found if out is None else out.unionByName(found)
        # a bucket without free bits to cut has no more than 2 ** radius members
        rows = rows.where(F.col("count") > bucket).drop("count")
        if rows.isEmpty():
            return out
        used = sorted({r.mask for r in rows.select("mask").distinct().collect()})  # a few masks, not data
        finer = F.create_map(*[x for m in used for x in (F.lit(m), F.array(*[F.lit(_signed(k)) for k in _finer(m % (1 << 64), radius)]))])
        rows = rows.select(F.explode(finer[F.col("mask")]).alias("mask"), "fp", "node")


# --- connected components ---------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each linked node can reach.

    Links are rewritten by large-star and small-star steps, in turn, until every node
    hangs on its root. Minima are aggregated before they are joined back, so a hub is no
    hot spot.
    """
    e = C.cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        # large star: every larger neighbour of a node hangs on the node's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node itself, hangs on the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = C.cut(low.select("u", F.col("m").alias("v")).union(moved).distinct())
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and (
            e.groupBy("u").count().where("count > 1").isEmpty()
        ):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 2, parts: int = 4) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    prints = C.cut(fingerprints(docs, shingle))
    nodes = C.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("known")))
    # the fingerprint is the node: rows without an id link others, but name no component
    roots = components(stars(nodes.select("fp", F.col("fp").alias("node")), radius, parts))
    members = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "known", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("known").alias("component_id"))
    named = members.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Query form: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    found = near_components(docs)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
