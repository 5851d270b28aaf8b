"""Token ids in binary blocks: an adaptive context-mixing range coder.

Documents are encoded with a byte-level BPE tokenizer, an end id is appended to each, and
the ids are written in ascending doc_id order. The ids of a shard (a range of doc_ids)
are cut into blocks of ``BLOCK`` ids. Each block is coded on its own, with all models
reset, and carries a CRC-32 of its ids, so a damaged block is found and spoils no other.

Coding an id: an order-2 and an order-1 model predict it (the id that followed last in
the same context, with a confidence). Their hits are coded as binary decisions. Three
estimates of a hit (by the confidences of both models, by the last four outcomes, and of
all) are mixed in the logistic domain by weights that follow the coding error. An id that
neither predicts goes to the order-0 model, which counts the ids it has coded; an escape
announces one that the block has not had, by an adaptive distribution of its bit length
and its lower bits. All decisions drive one 32-bit range coder, in integers only, so every
machine decodes what any other has coded.

The coder stands here twice, bit by bit the same: ``token_coder.java`` codes the files, one
block after the other in the executors' JVM; ``compress`` and ``decompress`` code blocks side
by side in numpy, one lane for each block, where no Spark is at hand.

File format: Parquet rows (shard, block, n_ids, crc32, payload, doc_ids, doc_sizes),
shards ascending with doc_id, blocks ascending within; doc_ids and doc_sizes list the
documents that start in a block, with their numbers of ids.

Defined results: a null text is empty (the end id alone); null doc_ids come first; equal
ids are ordered by a hash of their texts; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import json
import math
import struct
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common as C

BLOCK = 4096
LANES = 1024
SLOTS = 1 << 12
END = 2
#: Blocks that a worker hands over, or takes, at once.
BATCH = 64
CACHE = 1_200_000
_TOP, _BOT = 1 << 24, 1 << 16
_M32 = np.int64(0xFFFFFFFF)
CLASSES = 18  # bit lengths 0 to 17 of an id
_ONE = 1 << 12  # probabilities of hits
_FULL = 1 << 15  # distribution of bit lengths
RATE = 6  # of the mixing weights
_SPEED = np.array([[4], [4], [5]], dtype=np.int16)  # shifts by which the three estimates of a hit follow


# --- tokenizer ------------------------------------------------------------------------


def _spelling() -> str:
    """The character of each byte in a byte-level vocabulary: its own if it can be printed."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printed]
    return "".join(chr(b if b in printed else 256 + rest.index(b)) for b in range(256))


_SPELT = _spelling()


class Encoder:
    """The tokenizers library behind a memory of pieces.

    The library splits a text by a fixed pattern before it merges, and merges never cross
    a split; so each piece is handed to the library once and remembered. With
    ``added_tokens`` the file's added tokens are ids where they stand in a text, and such a
    text is handed over whole; without, they are spelt as ordinary pieces.
    """

    def __init__(self, model: str, added_tokens: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = not added_tokens
        self._split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        import re

        # the same pattern for texts of ASCII and Latin letters only, where the classes are
        # short; what starts with a letter or digit comes first, as no other branch does
        letter, space = "A-Za-zÀ-ÖØ-öø-ɏ", r"\t-\r "
        self._fast = re.compile(
            f" ?[{letter}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{space}0-9{letter}]+|[{space}]+(?![^{space}])|[{space}]+"
        ).findall
        self._odd = re.compile("[^\x00-\x1b\x20-\x7fÀ-ɏ]").search
        file = json.loads(model)
        known = file.get("added_tokens", [])
        added = [re.escape(t["content"]) for t in known] if added_tokens else []
        self._whole = re.compile("|".join(added)).search if added else None
        # where the library would only split a piece again and spell its bytes, its model
        # gets the spelt piece at once
        split = file.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain &= file.get("normalizer") is None and file["model"].get("type") == "BPE" and all(t["special"] for t in known)
        self._merge = self.tokenizer.model.tokenize if plain else None
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _fresh(self, piece: str) -> bytes:
        got = self._older.get(piece)
        if got is None:
            if self._merge:
                ids = [t.id for t in self._merge(codecs.charmap_decode(piece.encode(), "strict", _SPELT)[0])]
            else:
                ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self._known) >= CACHE // 2:  # pieces still in use come back from there
                self._older, self._known = self._known, {}
            self._known[piece] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self._whole and self._whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = (self._split if self._odd(text) else self._fast)(text)
        get, fresh = self._known.get, self._fresh
        return b"".join([get(p) or fresh(p) for p in pieces])


_encoders: dict[tuple[int, bool], Encoder] = {}


def encoder(model: str, added_tokens: bool = False) -> Encoder:
    """One for each worker, tokenizer file and reading of its added tokens."""
    key = zlib.crc32(model.encode()), added_tokens
    if key not in _encoders:
        _encoders[key] = Encoder(model, added_tokens)
    return _encoders[key]


# --- range coder in lanes ----------------------------------------------------------------


class _Coder:
    """State common to both directions: a carry-less range coder for each lane."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, 0xFFFFFFFF, dtype=np.int64)

    def unit(self, at, total) -> np.ndarray:
        size = self.range.take(at)
        return size >> (total.bit_length() - 1) if isinstance(total, int) else size // total

    def code(self, at, start, width, total) -> None:
        """Narrow lanes ``at`` to [start, start + width) of total (if an int, a power of 2).

        Bytes move while the top one is settled; a range that straddles is cut short.
        """
        unit = self.unit(at, total)
        low, size = (self.low.take(at) + start * unit) & _M32, unit * width
        # the interval may wrap: compare as the coder does, modulo 2**32
        k = np.flatnonzero(((low ^ ((low + size) & _M32)) < _TOP) | (size < _BOT))
        while len(k):
            floor, room = low[k], size[k]
            cut = (room < _BOT) & ((floor ^ ((floor + room) & _M32)) >= _TOP)
            if cut.any():
                room = np.where(cut, -floor & (_BOT - 1), room)
            self.move(at[k], floor)
            low[k] = floor = (floor << 8) & _M32
            size[k] = room = (room << 8) & _M32
            k = k[((floor ^ ((floor + room) & _M32)) < _TOP) | (room < _BOT)]
        self.low[at], self.range[at] = low, size


class _Encoder(_Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, room), dtype=np.uint8)
        self.size = np.zeros(lanes, dtype=np.int64)

    def move(self, at, low) -> None:
        self.out[at, self.size[at]] = low >> 24
        self.size[at] += 1

    def bit(self, at, chance, hit) -> np.ndarray:
        """Code the decisions ``hit`` of lanes ``at``, of probability chance / _ONE."""
        self.code(at, np.where(hit, 0, chance), np.where(hit, chance, _ONE - chance), _ONE)
        return hit

    def finish(self) -> list[bytes]:
        at = np.arange(len(self.low))
        for _ in range(4):
            self.out[at, self.size] = self.low >> 24
            self.size += 1
            self.low = (self.low << 8) & _M32
        return [self.out[k, : self.size[k]].tobytes() for k in at]


class _Decoder(_Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        self.data = np.zeros((len(payloads), max(map(len, payloads)) + 8), dtype=np.uint8)
        for k, p in enumerate(payloads):
            self.data[k, : len(p)] = np.frombuffer(p, dtype=np.uint8)
        self.at = np.full(len(payloads), 4, dtype=np.int64)
        self.code_ = np.zeros(len(payloads), dtype=np.int64)
        for k in range(4):
            self.code_ = self.code_ << 8 | self.data[:, k]

    def move(self, at, low) -> None:
        self.code_[at] = (self.code_[at] << 8 & _M32) | self.data[at, np.minimum(self.at[at], self.data.shape[1] - 1)]
        self.at[at] += 1

    def peek(self, at, total) -> np.ndarray:
        """Where in 0 .. total - 1 the coded point of lanes ``at`` lies."""
        unit = np.maximum(self.unit(at, total), 1)
        return np.minimum(((self.code_.take(at) - self.low.take(at)) & _M32) // unit, total - 1)

    def bit(self, at, chance, hit=None) -> np.ndarray:
        hit = ((self.code_.take(at) - self.low.take(at)) & _M32) < chance * self.unit(at, _ONE)
        self.code(at, np.where(hit, 0, chance), np.where(hit, chance, _ONE - chance), _ONE)
        return hit


def _logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch: 256 ln(p / (1 - p)) of p / _ONE; squash: its inverse for -2047 to 2047."""
    stretch = [round(256 * math.log((p + 0.5) / (_ONE - p - 0.5))) for p in range(_ONE)]
    squash = [round(_ONE / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)]
    return np.clip(stretch, -2047, 2047), np.clip(squash, 32, _ONE - 32)


_STRETCH, _SQUASH = _logistic()


class _Models:
    """Order-2, order-1 and order-0 models of every lane, in flat arrays.

    Ids are known by their ranks, 1 for the block's first distinct id, 2 for the next.
    """

    def __init__(self, lanes: int, steps: int):
        self.two = np.zeros(lanes * SLOTS, dtype=np.uint16)  # rank << 2 | confidence
        self.one = np.zeros(lanes * SLOTS, dtype=np.uint16)
        # by order and lane: hits at 16 confidences, after 16 histories, and at all
        self.chances = np.full(2 * lanes * 33, _ONE // 2, dtype=np.int16)
        self.weights = np.full((2, 3, lanes), 26_000, dtype=np.int64)  # of 1 << 16
        self.history = np.zeros((2, lanes), dtype=np.int64)  # the last four hits
        self.lanes, self.top = lanes, -(-steps // 256)
        # how often each rank was coded by order 0: by 256, by 16 and alone
        self.tops = np.zeros((lanes, self.top), dtype=np.uint16)
        self.tens = np.zeros((lanes * self.top, 16), dtype=np.uint16)
        self.counts = np.zeros((lanes * self.top * 16, 16), dtype=np.uint16)
        self.total = np.zeros(lanes, dtype=np.int64)
        self.seen = np.zeros(lanes, dtype=np.int64)
        self.ids = np.zeros((lanes, steps + 1), dtype=np.int32)  # by rank
        self.bits = np.broadcast_to(np.arange(CLASSES + 1) * (_FULL // CLASSES), (lanes, CLASSES + 1)).astype(np.int32)
        self.bits[:, -1] = _FULL
        self.last, self.before = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)

    def chance(self, order, at, context):
        """Probability of a hit, of ``_ONE``: three estimates, mixed by the lane's weights."""
        self.cells = np.empty((3, len(at)), dtype=np.int64)
        self.cells[2] = (at + order * self.lanes) * 33
        np.add(self.cells[2], context, out=self.cells[0])
        np.add(self.cells[2], self.history[order].take(at) + 16, out=self.cells[1])
        self.cells[2] += 32
        self.estimates = self.chances.take(self.cells)
        self.inputs = _STRETCH.take(self.estimates)
        self.held = self.weights[order].take(at, axis=1)
        dot = (self.inputs * self.held).sum(axis=0) >> 16
        self.mixed = _SQUASH.take(dot + 2047, mode="clip")
        return self.mixed

    def learn_hit(self, order, at, hit):
        """Move the estimates towards the outcome, and the weights against the error."""
        goal = np.where(hit, np.int16(_ONE - 1), np.int16(0))
        error = (goal - self.mixed) * RATE
        self.weights[order][:, at] = self.held + ((self.inputs * error) >> 16)
        self.chances[self.cells] = self.estimates + ((goal - self.estimates) >> _SPEED)
        self.history[order][at] = (self.history[order].take(at) << 1 & 15) | hit

    def learn_bits(self, at, n):
        """Move the distribution of bit lengths towards n; every length keeps a share."""
        cdf = self.bits.take(at, axis=0)
        self.bits[at] = cdf + ((_GOALS.take(n, axis=0) - cdf) >> 5)

    def learn(self, slot2, slot1, two, one, ranks):
        for table, slot, was in ((self.two, slot2, two), (self.one, slot1, one)):
            right = (was >> 2) == ranks
            sure = was & 3
            keep = right | (sure > 1)
            table[slot] = np.where(keep, (was & ~3) | np.where(right, np.minimum(sure + 1, 3), sure - 1), ranks << 2)
        n = len(ranks)
        self.before[:n] = self.last[:n]
        self.last[:n] = ranks


# what learn_bits moves to at each bit length
_GOALS = np.array([[_FULL - (CLASSES - k) if k > n else k for k in range(CLASSES + 1)] for n in range(CLASSES)], dtype=np.int32)


def _step(coder, model, at, ranks, ids) -> np.ndarray:
    """Code, or decode where ranks and ids are None, the next id of the first lanes ``at``: its rank."""
    last, base = model.last[: len(at)], at * SLOTS
    slot2 = base + ((last * 40503 + model.before[: len(at)] * 30011 + 7) % 65521 & (SLOTS - 1))
    slot1 = base + (last & (SLOTS - 1))
    two, one = model.two.take(slot2).astype(np.int64), model.one.take(slot1).astype(np.int64)
    context = (two & 3) << 2 | (one & 3)
    guess2, guess1 = two >> 2, one >> 2
    got = np.zeros(len(at), dtype=np.int64)
    for order, guess in enumerate((guess2, guess1)):
        ask = np.flatnonzero((guess > 0) & ((got == 0) & (guess1 != guess2) if order else True))
        if len(ask):
            lanes, guess = at[ask], guess[ask]
            p = model.chance(order, lanes, context[ask])
            hit = coder.bit(lanes, p, None if ranks is None else ranks[ask] == guess)
            model.learn_hit(order, lanes, hit)
            got[ask] = np.where(hit, guess, 0)
    rest = np.flatnonzero(got == 0)
    if len(rest):
        got[rest] = _order_0(coder, model, at[rest], *([None, None] if ranks is None else [ranks[rest], ids[rest]]))
    model.learn(slot2, slot1, two, one, got)
    return got


def _order_0(coder, model, at, ranks, ids) -> np.ndarray:
    """A known rank by its count, or the escape to an id that the block has not had."""
    row, seen, total = np.arange(len(at)), model.seen.take(at), model.total.take(at)
    escape = np.maximum(seen, 1)
    if ranks is None:
        spot = coder.peek(at, total + escape)
        new = spot >= total
    else:
        new = ranks > seen
        place = np.where(new, 0, ranks - 1)
    start, used = np.zeros(len(at), dtype=np.int64), int(seen.max()) // 256 + 1
    found = at * model.top
    for level, counts in enumerate((model.tops, model.tens, model.counts)):
        part = counts.take(found, axis=0) if level else counts[at, :used]
        upto = part.cumsum(axis=1, dtype=np.int32)
        if ranks is None:
            digit = np.where(new, 0, (upto <= (spot - start)[:, None]).sum(axis=1))
        else:
            digit = place >> (8 - 4 * level) & (15 if level else -1)
        width = part[row, digit].astype(np.int64)
        start += upto[row, digit] - width
        found = found * 16 + digit if level else found + digit
    coder.code(at, np.where(new, total, start), np.where(new, escape, width), total + escape)
    found -= at * (model.top * 256)
    k = np.flatnonzero(new)
    if len(k):
        lanes, place = at[k], seen[k]
        found[k] = place
        model.seen[lanes] = place + 1
        model.ids[lanes, place + 1] = _new_id(coder, model, lanes, None if ids is None else ids[k])
    for level, counts in enumerate((model.tops, model.tens, model.counts)):
        counts.reshape(-1)[at * (model.top * 16**level) + (found >> (8 - 4 * level))] += 1
    model.total[at] = total + 1
    return found + 1


def _new_id(coder, model, at, ids) -> np.ndarray:
    """The bit length by its adaptive distribution, then the bits below the leading one."""
    if ids is None:
        n = (model.bits[at, 1:] <= coder.peek(at, _FULL)[:, None]).sum(axis=1)
    else:
        n = np.frexp(ids.astype(np.float64))[1].astype(np.int64)
    start = model.bits[at, n].astype(np.int64)
    coder.code(at, start, model.bits[at, n + 1] - start, _FULL)
    model.learn_bits(at, n)
    one = np.ones(len(at), dtype=np.int64)
    total = one << np.maximum(n - 1, 0)  # 2**16 at most, as large as the smallest range
    tail = coder.peek(at, total) if ids is None else ids & (total - 1)
    coder.code(at, tail, one, total)
    return np.where(n > 0, total | tail, 0)


def _ranks(ids: np.ndarray) -> np.ndarray:
    """For every id the rank, from 1, at which it first came up."""
    _, first, of = np.unique(ids, return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(1, len(first) + 1)
    return rank[of]


def compress(blocks: list[np.ndarray]) -> list[bytes]:
    """Code each block of ids (below 2**17, at most 2**14 - 1 in a block) on its own."""
    out: list[bytes] = []
    if max(map(len, blocks), default=0) >= 1 << 14:
        raise ValueError("a block has 2**14 ids or more")
    for lo in range(0, len(blocks), LANES):
        part = blocks[lo : lo + LANES]
        size = np.array([len(b) for b in part])
        order = np.argsort(-size, kind="stable")
        lanes, steps = len(part), int(size.max(initial=0))
        ids, ranks = np.zeros((2, steps, lanes), dtype=np.int64)
        for k, b in enumerate(order):
            ids[: size[b], k], ranks[: size[b], k] = part[b], _ranks(part[b])
        size = size[order]
        coder, model = _Encoder(lanes, steps * 6 + 16), _Models(lanes, steps)
        for t in range(steps):
            at = np.arange(int(np.searchsorted(-size, -t, side="left")))
            _step(coder, model, at, ranks[t, at], ids[t, at])
        done = coder.finish()
        back: list[bytes] = [b""] * lanes
        for k, b in enumerate(order):
            back[b] = done[k]
        out += back
    return out


def decompress(payloads: list[bytes], sizes: list[int], checksums: list[int] | None = None) -> list[np.ndarray]:
    """The ids of each block; a wrong checksum raises ValueError."""
    out: list[np.ndarray] = []
    for lo in range(0, len(payloads), LANES):
        size = np.array(sizes[lo : lo + LANES])
        order = np.argsort(-size, kind="stable")
        steps, lanes = int(size.max(initial=0)), len(size)
        coder, model = _Decoder([payloads[lo + k] for k in order]), _Models(lanes, steps)
        size = size[order]
        ranks = np.zeros((steps, lanes), dtype=np.int64)
        for t in range(steps):
            at = np.arange(int(np.searchsorted(-size, -t, side="left")))
            ranks[t, at] = _step(coder, model, at, None, None)
        back: list[np.ndarray] = [np.zeros(0)] * lanes
        for k, b in enumerate(order):
            back[b] = model.ids[k, ranks[: size[k], k]].astype("<u4")
        out += back
    if checksums is not None:
        for k, (b, want) in enumerate(zip(out, checksums, strict=True)):
            if zlib.crc32(b.tobytes()) != want:
                raise ValueError(f"block {k} is damaged")
    return out


# --- the same coder in the executors' JVM --------------------------------------------------

_shipped: dict[str, str] = {}  # jar by application


def coder_functions(spark: SparkSession) -> None:
    """SQL functions token_encode(ids) and token_decode(payload, n_ids) in this session.

    token_coder.java is compiled by the compiler that Spark uses for its own plans, and the
    executors fetch the classes from the driver as they fetch any jar.
    """
    sc, jvm = spark.sparkContext, spark._jvm
    source = (Path(__file__).parent / "token_coder.java").read_text(encoding="utf-8")
    values = {"TOP": _TOP, "BOT": _BOT, "SLOTS": SLOTS, "CLASSES": CLASSES, "ONE": _ONE, "FULL": _FULL, "RATE": RATE}
    values |= {name: "".join(f"{x + 2048:04x}" for x in t.tolist()) for name, t in (("STRETCH", _STRETCH), ("SQUASH", _SQUASH))}
    for name, value in values.items():
        source = source.replace(f"@{name}@", str(value))
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    if sc.applicationId not in _shipped:
        _shipped[sc.applicationId] = jar = f"{tempfile.mkdtemp(prefix='coder')}/token-coder.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.sc().addJar(jar)
    for name, cls in (("token_encode", "TokenEncode"), ("token_decode", "TokenDecode")):
        function = compiler.getClassLoader().loadClass(cls).newInstance()
        spark._jsparkSession.udf().register(name, function, jvm.org.apache.spark.sql.types.DataTypes.BinaryType)


# --- tables ------------------------------------------------------------------------------


_PLAIN = "shard int, block int, n_ids int, crc32 long, ids binary, doc_ids array<long>, doc_sizes array<int>"
_FILE = "shard int, block int, n_ids int, crc32 long, payload binary, doc_ids array<long>, doc_sizes array<int>"


def _write_rows(model, end: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(model.value, added_tokens), TaskContext.get().partitionId()
        tail = np.array([end], dtype="<u4").tobytes()
        held, size, number = [], 0, 0
        docs: list[tuple[int, int | None, int]] = []  # (first id in the held ones, doc_id, ids)

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, size, number, docs
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            whole = size if last else size // BLOCK * BLOCK
            blocks = [ids[k : k + BLOCK] for k in range(0, whole, BLOCK)]
            starts: list[tuple[list, list]] = [([], []) for _ in blocks]
            for at, doc_id, n in docs:
                if at < whole:
                    starts[at // BLOCK][0].append(doc_id)
                    starts[at // BLOCK][1].append(n)
            out = pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard] * len(blocks), pa.int32()),
                    "block": pa.array(range(number, number + len(blocks)), pa.int32()),
                    "n_ids": pa.array([len(b) for b in blocks], pa.int32()),
                    "crc32": pa.array([zlib.crc32(b.tobytes()) for b in blocks], pa.int64()),
                    "ids": pa.array([b.tobytes() for b in blocks], pa.binary()),
                    "doc_ids": pa.array([s[0] for s in starts], pa.list_(pa.int64())),
                    "doc_sizes": pa.array([s[1] for s in starts], pa.list_(pa.int32())),
                }
            )
            number += len(blocks)
            docs = [(at - whole, d, n) for at, d, n in docs if at >= whole]
            held, size = [ids[whole:].tobytes()], size - whole
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = enc.encode_bytes(text.as_py() or "") + tail
                docs.append((size, doc_id, len(got) // 4))
                held.append(got)
                size += len(got) // 4
                if size >= BATCH * BLOCK:
                    yield flush(False)
        if size:
            yield flush(True)

    return run


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of whole shards, whose blocks come in order."""
    shard, place, crc, open_docs = None, 0, 0, []

    def documents(rows) -> Iterator[tuple]:
        nonlocal shard, place, crc, open_docs
        for r in rows:
            data, n_ids = r["ids"], r["n_ids"]
            if zlib.crc32(data) != r["crc32"]:
                raise ValueError(f"block {r['block']} of shard {r['shard']} is damaged")
            if r["shard"] != shard:
                shard, place, crc, open_docs = r["shard"], 0, 0, []
            # documents that start in this block follow any that is still open
            open_docs += [[d, n, n] for d, n in zip(r["doc_ids"], r["doc_sizes"], strict=True)]
            at = 0
            while at < n_ids and open_docs:
                doc = open_docs[0]
                n = min(doc[2], n_ids - at)
                crc = zlib.crc32(data[4 * at : 4 * (at + n)], crc)
                at, doc[2] = at + n, doc[2] - n
                if not doc[2]:
                    yield shard, doc[0], place, doc[1], crc
                    place, crc = place + doc[1], 0
                    open_docs.pop(0)

    def group(rows) -> pa.RecordBatch:
        found = list(zip(*documents(rows), strict=True)) or [()] * 5
        names = ["shard", "doc_id", "place", "n_tokens", "ids_crc32"]
        kinds = [pa.int32(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(found, kinds, strict=True)], names=names)

    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            yield group(batch.slice(k, BATCH).to_pylist())


def write_tokens(docs: DataFrame, path: str, model_path: str | None = None, end: int = END, added_tokens: bool = False) -> None:
    """Write the ids of all documents, ascending by doc_id, to a directory."""
    spark = docs.sparkSession
    C.ship(spark)
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("byte_bpe_50k.json")
    with open(model_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())  # the tokenizer file, 2 MB
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"), F.xxhash64(C.text_column()).alias("tie"))
    ordered = base.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    plain = ordered.mapInArrow(_write_rows(model, end, added_tokens), _PLAIN)
    coder_functions(spark)
    plain.select("shard", "block", "n_ids", "crc32", F.call_function("token_encode", "ids").alias("payload"), "doc_ids", "doc_sizes").write.parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the rows of the file format."""
    C.ship(files.sparkSession)
    coder_functions(files.sparkSession)
    rows = files.repartition("shard").sortWithinPartitions("shard", "block")
    plain = rows.select("shard", "block", "n_ids", "crc32", F.call_function("token_decode", "payload", "n_ids").alias("ids"), "doc_ids", "doc_sizes")
    found = plain.mapInArrow(_read_rows, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, model_path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Write all ids, then read the files back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    spark = docs.sparkSession
    path = f"{C.shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, model_path, added_tokens=added_tokens)
    C.release(spark)
    return read_tokens(spark.read.schema(_FILE).parquet(path))
