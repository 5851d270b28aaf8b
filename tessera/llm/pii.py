"""Personal data: exact patterns plus a character BiLSTM-CRF trained in numpy.

Base spans come from four patterns (email, ip, card, phone), leftmost and
non-overlapping within a kind. A bidirectional LSTM over characters (input
and forget gates coupled) with a CRF on top (tags O and B/I of each kind) learns the labelled spans of a bounded sample of
documents and adds spans that it finds elsewhere; base spans stay. Texts are cut into
overlapping windows, each window is decoded by Viterbi, every character takes its tag
from the window in which it lies furthest from a cut edge, and spans are read off the
joined tags of the whole text.

Windows that hold neither a digit nor ``@`` are not run, unless a span reaches them from a
neighbour, as no added span is without either; windows whose best path provably is "all O"
(every other tag trails by more than any transitions can win back) skip Viterbi. The result
is the same as without either saving.

Defined results: a null text is empty and has no spans; doc_id may be null or repeated,
rows are independent; added spans overlap no base span and hold ``@``, three dots, or
enough digits for their kind; with no
labelled span in the sample only base spans are returned; an empty table gives an empty
result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits can match only if the run's first digit does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@`` outwards (linear in the text)."""
    free = 0
    at = t.find("@")
    while at >= 0:
        lo = at
        while lo > free and t[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(t, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = t.find("@", max(at + 1, free))


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns, sorted."""
    out = [(s, 0, e) for s, e in _emails(t)]
    if _DIGIT.search(t):
        for m in _IP.finditer(t):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(t):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in t:
            for m in _PHONE.finditer(t):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def spell(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the tagger -----------------------------------------------------------------------

HIDDEN = 8
SYMBOLS = 129  # ASCII, and one for all else
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WIDTH, MARGIN = 384, 16
GROUP = 3072  # windows decoded together
_NEVER = -1e4


#: All digits are one symbol: shapes are learned, not values.
_SYMBOL = np.arange(SYMBOLS, dtype=np.uint8)
_SYMBOL[48:58] = 48


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _SYMBOL[np.minimum(codes, SYMBOLS - 1)]


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), dtype=bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place: the sigmoid of -x."""
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Tagger:
    """Two LSTMs (rows: gates f, o, g; the input gate is 1 - f), tag scores and transitions."""

    def __init__(self, params: list[np.ndarray]):
        self.params = [np.ascontiguousarray(p, dtype=np.float32) for p in params]

    @staticmethod
    def fresh(seed: int = 11) -> Tagger:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        out = []
        for _ in range(2):
            x = rng.normal(0, 0.3, (3 * h, SYMBOLS))
            x[:h] += 1  # remember at first
            out += [x, rng.normal(0, 0.3, (3 * h, h))]
        out += [rng.normal(0, 0.3, (TAGS, h)), rng.normal(0, 0.3, (TAGS, h)), np.zeros((TAGS, 1)), np.zeros((TAGS, TAGS))]
        return Tagger(out)

    def _run(self, which: int, sym: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, H, B); ``active[t]`` windows, the longest first, reach step t."""
        x, u = self.params[2 * which], self.params[2 * which + 1]
        # tanh(z) = 2 sigmoid(2 z) - 1: one pass of exp for all gates, of negated sums
        x, u = -x, -u
        x[2 * HIDDEN :] *= 2
        u[2 * HIDDEN :] *= 2
        steps, b = sym.shape
        out = np.zeros((steps, HIDDEN, b), dtype=np.float32)
        h, c = np.zeros((HIDDEN, b), dtype=np.float32), np.zeros((HIDDEN, b), dtype=np.float32)
        room, product, squash = np.empty((3 * HIDDEN, b), np.float32), np.empty((3 * HIDDEN, b), np.float32), np.empty((HIDDEN, b), np.float32)
        for t in range(steps) if which == 0 else range(steps - 1, -1, -1):
            n = active[t]
            if n == b and keep is None:
                gates, add, squashed = room, product, squash
            else:
                gates, add, squashed = (np.empty((r, n), np.float32) for r in (3 * HIDDEN, 3 * HIDDEN, HIDDEN))
            np.take(x, sym[t, :n].astype(np.intp), axis=1, out=gates, mode="clip")
            np.matmul(u, h[:, :n], out=add)
            gates += add
            _sigmoid(gates)
            f, o, g = gates[:HIDDEN], gates[HIDDEN : 2 * HIDDEN], gates[2 * HIDDEN :]
            g *= 2
            g -= 1
            now = c[:, :n]
            before = now.copy() if keep is not None else None
            # c = f c + (1 - f) g
            now -= g
            now *= f
            now += g
            np.multiply(now, -2, out=squashed)
            _sigmoid(squashed)
            squashed *= 2
            squashed -= 1
            np.multiply(o, squashed, out=h[:, :n])
            out[t, :, :n] = h[:, :n]
            if keep is not None:
                keep.append((t, gates, before, squashed))
        return out

    def emissions(self, sym: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Scores (T, TAGS, B)."""
        wf, wb, bias = self.params[4:7]
        return np.matmul(wf, self._run(0, sym, active)) + np.matmul(wb, self._run(1, sym, active)) + bias

    def loss_and_gradients(self, sym: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood over windows of one length, and its gradients."""
        steps, b = sym.shape
        active = np.full(steps, b)
        kept: list[list] = [[], []]
        hidden = [self._run(k, sym, active, kept[k]) for k in (0, 1)]
        wf, wb, bias, trans = self.params[4:]
        em = np.matmul(wf, hidden[0]) + np.matmul(wb, hidden[1]) + bias
        top = em.max(axis=1, keepdims=True)
        e = np.exp(em - top)
        move = np.where(_allowed(), np.exp(trans), 0).astype(np.float32)
        fwd, norm = np.empty_like(e), np.empty((steps, 1, b), dtype=np.float32)
        for t in range(steps):
            a = e[t] * (move.T @ fwd[t - 1]) if t else e[0].copy()
            norm[t] = a.sum(axis=0, keepdims=True)
            fwd[t] = a / norm[t]
        bwd = np.ones_like(e)
        pairs = np.zeros((TAGS, TAGS), dtype=np.float64)
        for t in range(steps - 1, 0, -1):
            ahead = e[t] * bwd[t] / norm[t]
            pairs += move * (fwd[t - 1] @ ahead.T)
            bwd[t - 1] = move @ ahead
        gold = np.zeros_like(em)
        at, col = np.arange(steps)[:, None], np.arange(b)[None, :]
        gold[at, tags, col] = 1
        d_em = (fwd * bwd - gold) / b
        counts = np.zeros((TAGS, TAGS))
        np.add.at(counts, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        path = em[at, tags, col].sum() + trans[tags[:-1], tags[1:]].sum()
        loss = (np.log(norm).sum() + top.sum() - path) / b
        grads: list[np.ndarray] = [np.zeros(0)] * 8
        grads[7] = np.where(_allowed(), (pairs - counts) / b, 0)
        grads[6] = d_em.sum(axis=(0, 2))[:, None]
        for k, w in ((0, wf), (1, wb)):
            grads[4 + k] = np.einsum("tkb,thb->kh", d_em, hidden[k], optimize=True)
            x, u = self.params[2 * k], self.params[2 * k + 1]
            d_out = np.matmul(w.T, d_em)
            d_gates = np.zeros((steps, 3 * HIDDEN, b), dtype=np.float32)
            d_u = np.zeros_like(u)
            dh = dc = np.zeros((HIDDEN, b), dtype=np.float32)
            for t, gates, before, squashed in reversed(kept[k]):
                f, o, g = (gates[j * HIDDEN : (j + 1) * HIDDEN] for j in range(3))
                dh = dh + d_out[t]
                dc = dc + dh * o * (1 - squashed * squashed)
                d = d_gates[t]
                d[:HIDDEN] = dc * (before - g) * f * (1 - f)
                d[HIDDEN : 2 * HIDDEN] = dh * squashed * o * (1 - o)
                d[2 * HIDDEN :] = dc * (1 - f) * (1 - g * g)
                prior = t - 1 if k == 0 else t + 1
                if 0 <= prior < steps:
                    d_u += d @ hidden[k][prior].T
                dh, dc = u.T @ d, dc * f
            flat = sym.ravel()
            rows = d_gates.transpose(1, 0, 2).reshape(3 * HIDDEN, -1)
            grads[2 * k] = np.stack([np.bincount(flat, r, SYMBOLS) for r in rows])
            grads[2 * k + 1] = d_u
        return float(loss), grads

    def decode(self, em: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags (T, B) by Viterbi; windows that surely are all O skip it."""
        steps, _, b = em.shape
        trans = np.where(_allowed(), self.params[7], _NEVER).astype(np.float32)
        gain = 2 * max(0.0, float(trans.max() - trans[0, 0]))
        lead = em[:, 0] - em[:, 1:].max(axis=1)
        lead[np.arange(steps)[:, None] >= length[None, :]] = np.inf
        tags = np.zeros((steps, b), dtype=np.uint8)
        todo = np.flatnonzero(lead.min(axis=0) <= gain)
        if not len(todo):
            return tags
        em, length = em[:, :, todo], length[todo]
        best = em[0]
        back = np.zeros((steps, TAGS, len(todo)), dtype=np.uint8)
        for t in range(1, steps):
            paths = best[:, None, :] + trans[:, :, None]
            back[t] = paths.argmax(axis=0)
            best = np.where(t < length, paths.max(axis=0) + em[t], best)
        col = np.arange(len(todo))
        now = best.argmax(axis=0).astype(np.uint8)
        for t in range(steps - 1, -1, -1):
            live = t < length
            tags[t, todo] = np.where(live, now, 0)
            now = np.where(live & (t > 0), back[t, now, col], now)
        return tags

    def tag(self, texts: list[np.ndarray], every: bool = False) -> list[np.ndarray]:
        """A tag for each character of each text, windows reconciled.

        Spans without a digit or ``@`` are never added (see ``merge``), so windows without
        either are left at O, unless a span of a neighbouring window runs up to their
        edge: all spans that can be added are the same as with ``every`` window run.
        """
        stride = WIDTH - 2 * MARGIN
        size = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.concatenate([*texts, np.zeros(WIDTH, np.uint8)])
        base = np.cumsum([0, *size])
        n_windows = np.where(size == 0, 0, 1 + np.maximum(0, -(-(size - WIDTH) // stride)))
        doc = np.repeat(np.arange(len(texts)), n_windows)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start = number * stride
        length = np.minimum(WIDTH, size[doc] - start)
        first, last = number == 0, number == n_windows[doc] - 1
        at = base[doc] + start
        # each window owns its middle; cut edges belong to the neighbours
        lo, hi = at + np.where(first, 0, MARGIN), at + np.where(last, length, WIDTH - MARGIN)
        out = np.zeros(int(base[-1]), dtype=np.uint8)
        marked = np.zeros(len(flat) + 1, dtype=np.int64)
        np.cumsum((flat == 48) | (flat == 64), out=marked[1:])
        todo = np.ones(len(doc), dtype=bool) if every else marked[at + length] > marked[at]
        done = np.zeros(len(doc), dtype=bool)
        while todo.any():
            w = np.flatnonzero(todo)
            self._tag_windows(flat, at[w], length[w], lo[w], hi[w], out)
            done |= todo
            # spans that reach the edge of a window may go on in the next
            left, right = w[~first[w] & (out[lo[w]] > 0)] - 1, w[~last[w] & (out[hi[w] - 1] > 0)] + 1
            todo[:] = False
            todo[left] = todo[right] = True
            todo &= ~done
        return [out[base[r] : base[r + 1]] for r in range(len(texts))]

    def _tag_windows(self, flat: np.ndarray, at: np.ndarray, length: np.ndarray, lo: np.ndarray, hi: np.ndarray, out: np.ndarray) -> None:
        """Decode the windows at ``at`` and write the tags of the places they own."""
        order = np.argsort(-length, kind="stable")
        for k in range(0, len(order), GROUP):
            w = order[k : k + GROUP]
            steps = int(length[w[0]])
            active = np.searchsorted(-length[w], -np.arange(steps), side="left")
            sym = flat[at[w][None, :] + np.arange(steps)[:, None]]
            tags = self.decode(self.emissions(sym, active), length[w])
            t, col = np.nonzero(tags)
            place = at[w[col]] + t
            own = (place >= lo[w[col]]) & (place < hi[w[col]])
            out[place[own]] = tags[t[own], col[own]]


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs of tags; a new B or another kind starts a new run."""
    at = np.flatnonzero(tags)
    if not len(at):
        return []
    kind, begins = (tags[at] - 1) // 2, tags[at] % 2 == 1
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1]) | begins[1:]
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    return [(int(at[a]), int(kind[a]), int(at[b]) + 1) for a, b in zip(lo, hi, strict=True)]


#: Digits that an added span of each kind has at least.
_LEAST_DIGITS = (0, 4, 12, 7)


def merge(text: str, base: list, found: list) -> list:
    """Base spans and those found ones that overlap none of them and look like data."""
    reach, ends = [], 0
    for _, _, e in base:
        ends = max(ends, e)
        reach.append(ends)
    starts = [s for s, _, _ in base]
    out = list(base)
    for s, k, e in found:
        near = bisect_left(starts, e)
        if near and reach[near - 1] > s:
            continue
        part = text[s:e]
        if (k or "@" in part) and (k != 1 or part.count(".") == 3) and len(_DIGIT.findall(part)) >= _LEAST_DIGITS[k]:
            out.append((s, k, e))
    return sorted(out)


# --- training -------------------------------------------------------------------------


def train(examples: list[tuple[str, list]], steps: int = 500, batch: int = 48, width: int = 80, seed: int = 5) -> Tagger | None:
    """Fit on (text, labelled spans); None if there is no span to learn from."""
    rng = np.random.default_rng(seed)
    examples = [(t, s) for t, s in examples if len(t) >= width]
    marked = [(k, s) for k, (_, spans) in enumerate(examples) for s in spans]
    if not marked:
        return None
    by_kind = [[m for m in marked if m[1][1] == k] for k in range(len(KINDS))]
    by_kind = [m for m in by_kind if m]
    model = Tagger.fresh()
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.params]
    for step in range(1, steps + 1):
        sym, tags = np.empty((width, batch), np.uint8), np.zeros((width, batch), np.uint8)
        for col in range(batch):
            if rng.random() < 0.6:
                pool = by_kind[rng.integers(len(by_kind))]
                k, (s, _, e) = pool[rng.integers(len(pool))]
                lo = int(rng.integers(max(0, e - width - 8), max(1, s + 9)))
            else:
                k = int(rng.integers(len(examples)))
                lo = int(rng.integers(len(examples[k][0])))
            text, spans = examples[k]
            lo = max(0, min(lo, len(text) - width))
            inside = [(max(s, lo) - lo, c, min(e, lo + width) - lo, s >= lo) for s, c, e in spans if s < lo + width and e > lo]
            sym[:, col] = symbols(text[lo : lo + width])
            for s, c, e, whole in inside:
                tags[s:e, col] = 2 + 2 * c
                if whole:
                    tags[s, col] = 1 + 2 * c
        # overlapping labels can leave an I without its B: make the sequence well-formed
        kind = (tags.astype(int) - 1) // 2
        loose = np.zeros_like(tags, dtype=bool)
        loose[1:] = (tags[1:] > 0) & (tags[1:] % 2 == 0) & ((kind[1:] != kind[:-1]) | (tags[:-1] == 0))
        tags[loose] -= 1
        _, grads = model.loss_and_gradients(sym, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1.0, 1.1 - step / steps)
        for p, g, (m, v) in zip(model.params, grads, moments, strict=True):
            g = (g * min(1.0, 20 / (norm + 1e-9))).astype(np.float32)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def fit(docs: DataFrame, sample: int = 3000, excerpts: int = 20) -> Tagger | None:
    """Train on the ``sample`` documents with the smallest hashed ids, on ``excerpts`` places
    of each at most (documented bounds). Repeated rows count once."""
    C.ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text")).where("doc_id is not null").withColumn("hash", F.xxhash64("text"))
    picked = base.select("doc_id", "hash").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(sample)
    rows = (
        base.join(F.broadcast(picked), ["doc_id", "hash"])  # at most ``sample`` pairs
        .dropDuplicates(["doc_id", "hash"])
        .mapInArrow(_example_rows(excerpts), "doc_id long, hash long, lo long, text string, spans string")
    )
    return C.on_one_worker(rows, _learn)


def _learn(rows: pa.Table) -> Tagger | None:
    rows = rows.sort_by([("doc_id", "ascending"), ("hash", "ascending"), ("lo", "ascending")])
    examples = []
    for text, spans in zip(rows["text"].to_pylist(), rows["spans"].to_pylist(), strict=True):
        parsed = [s.split(":") for s in spans.split(",") if s]
        examples.append((text, [(int(s), KINDS.index(k), int(e)) for k, s, e in parsed]))
    return train(examples)


def _example_rows(excerpts: int):
    """Excerpts of 400 characters around labelled spans, and the first of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("lo", pa.int64()), ("text", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {name: [] for name in schema.names}
            for d, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash", "text")), strict=True):
                spans = base_spans(t)
                for part in sorted({0, *(s // 320 for s, _, _ in spans)})[:excerpts]:
                    lo, hi = max(0, part * 320 - 40), part * 320 + 360
                    inside = [(s - lo, k, e - lo) for s, k, e in spans if s >= lo and e <= hi]
                    for name, value in zip(schema.names, (d, h, lo, t[lo:hi], spell(inside)), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def find_spans(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    tags = model.tag([symbols(t) for t in texts])
    return [(b, merge(t, b, tag_spans(g))) for t, b, g in zip(texts, base, tags, strict=True)]


def _each_text(batch: pa.RecordBatch, model: Tagger | None) -> Iterator[tuple[str, list, list]]:
    column = batch.column("text")
    offsets, _ = C.string_buffers(column)
    for i, j in C.slices(offsets):
        texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
        for t, (base, every) in zip(texts, find_spans(texts, model), strict=True):
            yield t, base, every


def find(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans. No shuffle of texts."""
    spark = docs.sparkSession
    C.ship(spark)
    fitted = fit(docs, sample)
    model = spark.sparkContext.broadcast(fitted.params if fitted else None)  # some 10,000 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value) if model.value else None
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for _, base, every in _each_text(batch, tagger):
                for k in range(len(KINDS)):
                    counts[k].append(sum(c == k for _, c, _ in base))
                digest.append(hashlib.sha256(spell(base).encode()).hexdigest())
                spans.append(spell(every))
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_column().alias("text"))
    return base.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _marked(t: str, spans: list) -> str:
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [t[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(parts) + t[at:]


def redact(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows.

    Overlapping spans become one mark, of the first span's kind. Other columns and null
    texts are left as they are.
    """
    spark = docs.sparkSession
    C.ship(spark)
    fitted = fit(docs, sample)
    model = spark.sparkContext.broadcast(fitted.params if fitted else None)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value) if model.value else None
        for batch in batches:
            was = batch.column("text").to_pylist()
            texts, lengths = [], batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for r, (t, _, every) in enumerate(_each_text(batch, tagger)):
                found = every
                while found:
                    t = _marked(t, found)
                    # a mark can part digits that hid a match between them
                    found = base_spans(t)
                texts.append(t if every else was[r])
                if every and lengths is not None:
                    lengths[r] = len(texts[-1])
            for name, values in (("text", texts), ("n_chars", lengths)):
                if values is not None:
                    k = batch.schema.get_field_index(name)
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(values, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, schema)
