"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to a transducer of three parts: the normaliser (spaces to the
model's space mark, a mark in front), the pieces, and the byte fallback for characters
outside the vocabulary. Composing it with an input gives a lattice of piece arcs; the
encoding is its tropical-semiring shortest path.

* Unigram models: an arc weighs minus the piece's score.
* BPE models: the states remember the last piece. An arc weighs 0 if the pair (last
  piece, next piece) is what BPE makes of the two pieces' joined text, and infinity if
  not. Exactly one path of finite weight leads to each position, the BPE encoding of that
  prefix, so the shortest path equals the merge procedure.

Where no piece has a space mark after another character, the text is cut before space
marks without changing the result, and paths of chunks are remembered (a bounded cache).

Defined results: a null or empty text has no pieces and decodes to ""; doc_id may be null
or repeated; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks remembered by each worker.
CACHE = 700_000
_INF = float("inf")


class Transducer:
    """A compiled model: pieces with scores, byte fallback and normaliser options."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True, squeeze: bool = False, byte_fallback: bool = True):
        odd = {k for _, _, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}
        if odd:
            raise ValueError(f"piece types {sorted(odd)} are not supported")
        self.bpe, self.dummy_prefix, self.squeeze = bpe, dummy_prefix, squeeze
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.text = [p for p, _, _ in pieces]
        self._scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.unk = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE} if byte_fallback else {}
        self.unk_weight = 10.0 - min((s for _, s, k in pieces if k == NORMAL), default=0.0)
        joined = [p for p in self.ids if len(p) > 1]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in joined)
        # a character that no longer piece holds is always a piece of its own
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in joined))
        c = re.escape(alone)
        self._chunks = re.compile(f"{MARK}*[^{MARK}{c}]+|{MARK}+" + (f"|[{c}]" if alone else "")) if self.cuts else re.compile(r"(?s).+")
        if bpe:  # pieces that the merges never form have no arc
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self._merged(p) == [p]}
        #: prefix tree of the pieces: id, or -1 for a prefix that is no piece
        self._arcs: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self._after: dict[int, dict[int, bool]] = {}
        self._cache: dict[str, bytes] = {}
        self._raw = [b"" if k in (CONTROL,) else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, _, k in pieces]

    @staticmethod
    def load(model: bytes) -> Transducer:
        """Compile a serialised model."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        n, t = m.normalizer_spec, m.trainer_spec
        if n.precompiled_charsmap or not n.escape_whitespaces or t.treat_whitespace_as_suffix or t.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with the identity character map are supported")
        return Transducer([(p.piece, p.score, p.type) for p in m.pieces], t.model_type == 2, n.add_dummy_prefix, n.remove_extra_whitespaces, t.byte_fallback)

    # --- normaliser

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)

    # --- arcs

    def _merged(self, text: str) -> list[str]:
        """BPE by its definition, for the weights of arcs: best score first, then leftmost."""
        s, get = list(text), self._scores.get
        joins = [get(a + b, -_INF) for a, b in zip(s, s[1:], strict=False)]
        while joins:
            best = max(joins)
            if best == -_INF:
                break
            at = joins.index(best)
            s[at : at + 2] = [s[at] + s[at + 1]]
            del joins[at]
            if at:
                joins[at - 1] = get(s[at - 1] + s[at], -_INF)
            if at < len(joins):
                joins[at] = get(s[at] + s[at + 1], -_INF)
        return s

    def _follows(self, last: int, piece: int) -> bool:
        """Whether the arc for ``piece`` after ``last`` has weight 0."""
        parts = [self.text[last], self.text[piece]]
        known = self._after[last][piece] = self._merged("".join(parts)) == parts
        return known

    # --- shortest path

    def _path(self, chunk: str) -> list[int]:
        arcs, bpe = self._arcs, self.bpe
        n = len(chunk)
        weight = [_INF] * (n + 1)
        weight[0] = 0.0
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        for j in range(n):
            here, before = weight[j], last[j]
            if here == _INF:
                continue
            if bpe and before >= 0:
                after = self._after.get(before)
                if after is None:
                    after = self._after[before] = {}
            for i in range(j + 1, n + 1):
                piece = arcs.get(chunk[j:i])
                if piece is None:
                    break
                if piece < 0:
                    continue
                if bpe:
                    if weight[i] == _INF:
                        ok = True
                        if before >= 0:
                            ok = after.get(piece)
                            if ok is None:
                                ok = self._follows(before, piece)
                        if ok:
                            weight[i], last[i], back[i] = 0.0, piece, j
                elif here - self.score[piece] < weight[i]:
                    weight[i], last[i], back[i] = here - self.score[piece], piece, j
            if chunk[j] not in self.ids:
                # outside the vocabulary: the fallback arc, which nothing merges across
                to = here + (0.0 if bpe else self.unk_weight)
                if to < weight[j + 1]:
                    weight[j + 1], last[j + 1], back[j + 1] = to, -1, j
        out: list[int] = []
        i = n
        while i > 0:
            j = back[i]
            if last[i] >= 0:
                out.append(last[i])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(chunk[j:i].encode())]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)  # a run of unknown characters is one unknown piece
            i = j
        out.reverse()
        return out

    def _fresh(self, chunk: str) -> bytes:
        if len(self._cache) >= CACHE:
            self._cache.clear()
        got = np.array(self._path(chunk), dtype=np.int32).tobytes()
        if len(chunk) <= 64:
            self._cache[chunk] = got
        return got

    def encode_bytes(self, text: str) -> bytes:
        get, fresh = self._cache.get, self._fresh
        return b"".join([get(c) or fresh(c) for c in self._chunks.findall(self.normalise(text))])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        out = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy_prefix and out.startswith(" ") else out


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """One transducer for each model, compiled on the driver."""
    key = zlib.crc32(model)
    if key not in _compiled:
        _compiled[key] = Transducer.load(model)
    return _compiled[key]


def compiled_once(spark, path: str | None = None):
    """The compiled transducer as a broadcast (a few MB, whatever the corpus)."""
    return spark.sparkContext.broadcast(compiled(read_model(path)))


def read_model(path: str | None = None) -> bytes:
    """The model file, read on the driver (executors need not have it)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _encode_rows(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = model.value
        for batch in batches:
            column = batch.column("text")
            offsets, _ = C.string_buffers(column)
            for i, j in C.slices(offsets):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                parts = [fst.encode_bytes(t) for t in texts]
                sizes = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                values = np.frombuffer(b"".join(parts), dtype=np.int32)
                at = np.concatenate(([0], np.cumsum(sizes)))
                back = [fst.decode(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
                out = {c: batch.column(c).slice(i, j - i) for c in keep}
                out |= {
                    "n_pieces": pa.array(sizes),
                    "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)),
                    "decoded_crc32": pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back], pa.int64()),
                    "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)]),
                }
                yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, decoded_crc32 and round_trip (the ids decode to the text).

    One pass over whole texts without a shuffle; the model (half a MB) is broadcast.
    """
    spark = docs.sparkSession
    C.ship(spark)
    model = compiled_once(spark, path)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"))
    return base.mapInArrow(_encode_rows(model, ["doc_id"]), "doc_id long, n_pieces long, ids array<int>, decoded_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids decode to ""."""
    spark = encoded.sparkSession
    C.ship(spark)
    model = compiled_once(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = model.value
        for batch in batches:
            texts = [fst.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return base.mapInArrow(run, "doc_id long, text string")
