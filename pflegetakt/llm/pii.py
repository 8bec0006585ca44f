"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds to them.

The network is trained in numpy from labelled spans: those the patterns find in a bounded
sample, and other layouts of the same kinds put into sample texts. It reads every character of
every text in overlapping windows; windows are decoded by Viterbi and put together by taking
each character's tag from the window in whose middle it lies deeper. Spans that the tags give,
pass their kind's exact check and touch no pattern's span are added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Once, bounded_sample, sent_once

KINDS = ("email", "ip", "card", "phone")
HIDDEN = 8
WINDOW = 512
OVERLAP = 48
SNIPPET = 96
BATCH = 512
PADDING = 64
"""Windows that a text's end cuts short are padded to a multiple of this."""

Span = tuple[int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from each at-sign outwards, so long words cost no more than their length."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[Span]:
    """Each run of dotted numbers is cut into fours from its left."""
    for run in _DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, at + size
            at += size + 1


def base_spans(text: str | None) -> dict[str, list[Span]]:
    """The patterns' spans per kind, in order; null is empty."""
    text = text or ""
    return {
        "email": list(_emails(text)),
        "ip": list(_addresses(text)),
        "card": [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15],
    }


def joined_spans(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


# exact checks of what the network adds
_EMAIL_TEXT = re.compile(
    r"[A-Za-z0-9._%+-]+(?: ?@ ?|\x20?[\[(] ?at ?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]+(?:(?:\.|\x20dot\x20|\x20?[\[(] ?dot ?[\])]\x20?)[A-Za-z0-9-]+)+"
)
_PHONE_TEXT = re.compile(r"[+(]?[0-9][0-9\x20()./-]*[0-9]")
_CARD_TEXT = re.compile(r"[0-9](?:[\x20./_-]{0,2}[0-9])+")
_IP_TEXT = re.compile(r"([0-9]+)[\x20.,:-]([0-9]+)[\x20.,:-]([0-9]+)[\x20.,:-]([0-9]+)")


def _valid(kind: str, text: str, a: int, b: int) -> bool:
    part = text[a:b]
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind == "email":
        return bool(_EMAIL_TEXT.fullmatch(part))
    if kind == "ip":
        found = _IP_TEXT.fullmatch(part)
        return bool(found) and all(map(_small, found.groups()))
    digits = _digits(part)
    if kind == "card":
        return bool(_CARD_TEXT.fullmatch(part)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(_PHONE_TEXT.fullmatch(part)) and 9 <= len(digits) <= 12 and len(digits) < len(part)


# ---- characters

_SIGNS = "@.-+_%() :/#$&*|,\"'=[]\n\t"
N_CLASSES = len(_SIGNS) + 6  # padding, digit, lower, upper, other letter, anything else


@Once
def _classes() -> np.ndarray:
    """Class of each code point: signs that matter have their own, others share one by type."""
    table = np.full(0x110000, N_CLASSES - 1, np.uint8)
    other = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
    table[:0x10000][other] = 4
    table[ord("0") : ord("9") + 1], table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1] = 1, 2, 3
    for i, sign in enumerate(_SIGNS):
        table[ord(sign)] = 5 + i
    return table


def encode(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


# ---- network


@dataclass
class Tagger:
    """Parameters of both directions' cells (class table, recurrent weights), output layer and transitions."""

    table: list[np.ndarray]
    recur: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, self.out, self.bias, self.trans]


def new_tagger(seed: int = 0) -> Tagger:
    rng = np.random.default_rng(seed)
    tags = len(KINDS) + 1

    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) * 0.2).astype(np.float32)

    table = [normal(N_CLASSES, 4 * HIDDEN) for _ in range(2)]
    for t in table:
        t[:, HIDDEN : 2 * HIDDEN] += 1  # forget gates start open
    return Tagger(table, [normal(HIDDEN, 4 * HIDDEN) for _ in range(2)], normal(2 * HIDDEN, tags), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32))


def _cells(codes: np.ndarray, table: np.ndarray, recur: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (time, batch, hidden) over class codes (time, batch); gates: input, forget, output, new.

    Sigmoids are taken as halves of one tanh over all gates.
    """
    steps, batch = codes.shape
    h3 = 3 * HIDDEN
    scale = np.ones(4 * HIDDEN, np.float32)
    scale[:h3] = 0.5
    table, recur = table * scale, recur * scale
    h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    states = np.empty((steps, batch, HIDDEN), np.float32)
    for t in range(steps):
        z = table[codes[t]]
        z += h @ recur
        np.tanh(z, out=z)
        gates = z[:, :h3]
        gates *= 0.5
        gates += 0.5
        before = c
        c = z[:, HIDDEN : 2 * HIDDEN] * c
        c += z[:, :HIDDEN] * z[:, h3:]
        squashed = np.tanh(c)
        if keep is not None:
            keep.append((z, before, squashed, h))
        h = z[:, 2 * HIDDEN : h3] * squashed
        states[t] = h
    return states


def emissions(tagger: Tagger, codes: np.ndarray) -> np.ndarray:
    """Tag scores (time, batch, tags) of class codes (time, batch)."""
    ahead = _cells(codes, tagger.table[0], tagger.recur[0])
    back = _cells(codes[::-1], tagger.table[1], tagger.recur[1])[::-1]
    return ahead @ tagger.out[:HIDDEN] + back @ tagger.out[HIDDEN:] + tagger.bias


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (time, batch). Windows where tag 0 provably wins throughout are not searched.

    If no tag gains on tag 0 at any step even with the best transition, all zeros is the optimum.
    """
    steps, batch, tags = scores.shape
    best = np.zeros((steps, batch), np.int8)
    slack = float((trans - trans[0, 0]).max())
    hard = np.flatnonzero((scores[:, :, 1:].max(axis=2) - scores[:, :, 0]).max(axis=0) + slack >= 0)
    if not len(hard):
        return best
    own = scores[:, hard]
    total, back = own[0], np.empty((steps, len(hard), tags), np.int8)
    for t in range(1, steps):
        options = total[:, :, None] + trans
        back[t] = options.argmax(axis=1)
        total = options.max(axis=1) + own[t]
    tag = total.argmax(axis=1)
    rows = np.arange(len(hard))
    for t in range(steps - 1, -1, -1):
        best[t, hard] = tag
        if t:
            tag = back[t, rows, tag]
    return best


def _cell_gradients(codes, keep, recur, dstates) -> tuple[np.ndarray, np.ndarray]:
    steps, batch = codes.shape
    h3 = 3 * HIDDEN
    dtable, drecur = np.zeros((N_CLASSES, 4 * HIDDEN), np.float32), np.zeros_like(recur)
    dh, dc = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        z, c_before, squashed, h_before = keep[t]
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dh = dh + dstates[t]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.empty_like(z)
        dz[:, :HIDDEN] = dc * g * i * (1 - i)
        dz[:, HIDDEN : 2 * HIDDEN] = dc * c_before * f * (1 - f)
        dz[:, 2 * HIDDEN : h3] = dh * squashed * o * (1 - o)
        dz[:, h3:] = dc * i * (1 - g**2)
        np.add.at(dtable, codes[t], dz)
        drecur += h_before.T @ dz
        dh, dc = dz @ recur.T, dc * f
    return dtable, drecur


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def crf_gradients(scores: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, by scores, by transitions) of the negative log-likelihood of tag paths, a mean over windows."""
    steps, batch, n = scores.shape
    ahead, back = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        ahead[t] = _logsumexp(ahead[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in range(steps - 2, -1, -1):
        back[t] = _logsumexp(trans + (back[t + 1] + scores[t + 1])[:, None, :], 2)
    total = _logsumexp(ahead[-1], 1)
    dscores = np.exp(ahead + back - total[None, :, None])
    dtrans = np.zeros_like(trans)
    rows = np.arange(batch)
    gold = np.zeros(batch)
    for t in range(steps):
        gold += scores[t, rows, tags[t]]
        dscores[t, rows, tags[t]] -= 1
        if t:
            pair = ahead[t - 1][:, :, None] + trans + (scores[t] + back[t])[:, None, :] - total[:, None, None]
            dtrans += np.exp(pair).sum(axis=0)
            np.add.at(dtrans, (tags[t - 1], tags[t]), -1)
            gold += trans[tags[t - 1], tags[t]]
    return float((total - gold).mean()), dscores / batch, dtrans / batch


def train_tagger(codes: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 128, seed: int = 0) -> Tagger:
    """Adam on windows (window, time) of class codes and tags; no windows give the untrained network's zeros."""
    tagger = new_tagger(seed)
    if not len(codes):
        tagger.out[:], tagger.bias[1:] = 0, -9
        return tagger
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in tagger.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(codes))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = codes[rows].T, tags[rows].T
            keeps: list[list] = [[], []]
            ahead = _cells(x, tagger.table[0], tagger.recur[0], keeps[0])
            back = _cells(x[::-1], tagger.table[1], tagger.recur[1], keeps[1])[::-1]
            both = np.concatenate([ahead, back], axis=2)
            _, ds, dt = crf_gradients(both @ tagger.out + tagger.bias, y, tagger.trans)
            ds = ds.astype(np.float32)
            dboth = ds @ tagger.out.T
            g0 = _cell_gradients(x, keeps[0], tagger.recur[0], dboth[:, :, :HIDDEN])
            g1 = _cell_gradients(x[::-1], keeps[1], tagger.recur[1], dboth[::-1, :, HIDDEN:])
            flat = both.reshape(-1, 2 * HIDDEN)
            grads = [g0[0], g1[0], g0[1], g1[1], flat.T @ ds.reshape(-1, ds.shape[2]), ds.sum(axis=(0, 1)), dt]
            step += 1
            for p, g, (m, v) in zip(tagger.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tagger


# ---- windows


def _windows(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text number, offset, class codes) of overlapping windows over every text."""
    for i, text in enumerate(texts):
        codes = encode(text) if text else np.empty(0, np.uint8)
        for at in range(0, max(len(codes) - OVERLAP, min(len(codes), 1)), WINDOW - OVERLAP):
            yield i, at, codes[at : at + WINDOW]


def tag_spans(tagger: Tagger, texts: list[str | None]) -> list[dict[str, list[Span]]]:
    """Spans per kind that the reconciled tags of each text give, unchecked."""
    found: list[dict[str, list[Span]]] = [{k: [] for k in KINDS} for _ in texts]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}

    def work(steps: int) -> None:
        group = waiting.pop(steps)
        codes = np.zeros((len(group), steps), np.uint8)
        for row, (_, _, own) in enumerate(group):
            codes[row, : len(own)] = own
        scores = emissions(tagger, np.ascontiguousarray(codes.T))
        tags = viterbi(scores, tagger.trans)
        for row in np.flatnonzero(tags.any(axis=0)):
            i, at, own = group[row]
            # the first window keeps its start, the last its end; else the middle of the overlap cuts
            lo = OVERLAP // 2 if at else 0
            hi = len(own) if at + len(own) >= len(texts[i]) else WINDOW - OVERLAP // 2
            line = tags[lo:hi, row]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], line, [0]))))
            marks = np.concatenate(([0], line, [0]))
            for a, b in zip(edges, edges[1:], strict=False):
                if marks[a + 1]:
                    runs[i].append((at + lo + int(a), at + lo + int(b), int(marks[a + 1])))

    for window in _windows([t or "" for t in texts]):
        steps = -(-len(window[2]) // PADDING) * PADDING
        waiting.setdefault(steps, []).append(window)
        if len(waiting[steps]) == BATCH:
            work(steps)
    for steps in sorted(waiting):
        work(steps)
    for i, own in enumerate(runs):
        last: list[int] | None = None
        for a, b, kind in [*sorted(own), (-1, -1, 0)]:
            if last and a == last[1] and kind == last[2]:
                last[1] = b
                continue
            if last:
                found[i][KINDS[last[2] - 1]].append((last[0], last[1]))
            last = [a, b, kind]
    return found


def added_spans(text: str, base: dict[str, list[Span]], tagged: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The tagged spans, less blanks and stops at their ends, that pass their check and touch no base span."""
    taken = [s for k in KINDS for s in base[k]]
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    for kind in KINDS:
        for a, b in tagged[kind]:
            while a < b and text[a] in " .,;:-\n\t":
                a += 1
            while a < b and text[b - 1] in " .,;:-\n\t(":
                b -= 1
            if a < b and _valid(kind, text, a, b) and not any(a < y and x < b for x, y in taken):
                out[kind].append((a, b))
                taken.append((a, b))
    return out


# ---- training


def _layouts(rng: np.random.Generator) -> tuple[int, str]:
    """A kind's tag and a text of it in a layout that the patterns do not list."""

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        return "".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 9))))

    kind = int(rng.integers(0, 3))
    if kind == 0:
        sign = [" at ", " (at) ", "[at]", " [at] ", "(at)", " @ "][int(rng.integers(6))]
        dot = [".", " dot "][int(rng.integers(2))]
        return 1, f"{word()}.{digits(2)}{sign}{word()}{dot}{word()[:3]}" if rng.random() < 0.5 else f"{word()}{sign}{word()}{dot}example{dot}com"
    if kind == 1:
        body = digits(15)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        number = body + last
        return 3, [".", "  ", "/", " - "][int(rng.integers(3))].join(number[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return 4, [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b} {c}"][int(rng.integers(6))]


def _snippets(texts: list[str | None], every: int) -> Iterator[tuple[str, list[int]]]:
    """(snippet, tags) around each of the first spans of a text, and one plain snippet a text."""
    for n, text in enumerate(texts):
        if not text:
            continue
        spans = base_spans(text)
        tags = np.zeros(len(text), np.int8)
        for k, kind in enumerate(KINDS):
            for a, b in spans[kind]:
                tags[a:b] = k + 1
        starts = sorted(a for k in KINDS for a, _ in spans[k])[:4]
        places = [max(0, a - (17 * n + 31 * i) % 60) for i, a in enumerate(starts)]
        if n % every == 0:
            places.append((len(text) * 7919 // 10007) % max(1, len(text) - SNIPPET))
        for at in places:
            yield text[at : at + SNIPPET], tags[at : at + SNIPPET].tolist()


def fit_tagger(df: DataFrame, id_col: str, text_col: str, sample: int = 20_000, windows: int = 2400) -> Tagger:
    """Trains the network from labelled spans of about `sample` texts (a documented bound, by hash).

    At most `windows` snippets with spans and as many without are used; to half of the latter a
    span in another layout is added. Null and empty texts give nothing.
    """
    rows = bounded_sample(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), sample, "id", "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_snippets(batch.column(0).to_pylist(), 4))
            arrays = [pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(arrays, ["text", "tags"])

    cut = rows.select("text").mapInArrow(emit, "text string, tags array<tinyint>").distinct()
    spoken = F.exists("tags", lambda t: t > 0)
    parts = [cut.where(c).orderBy(F.xxhash64("text"), "text").limit(windows).collect() for c in (spoken, ~spoken)]
    rng = np.random.default_rng(1)
    codes, tags = [], []

    def add(text: str, own: list[int]) -> None:
        x, y = np.zeros(SNIPPET, np.uint8), np.zeros(SNIPPET, np.int64)
        part = encode(text[:SNIPPET])
        x[: len(part)], y[: len(part)] = part, own[: len(part)]
        codes.append(x)
        tags.append(y)

    for r in parts[0]:
        add(r["text"], list(r["tags"]))
    for i, r in enumerate(parts[1]):
        text = r["text"]
        blanks = [m.start() for m in re.finditer(" ", text[:56])]
        if i % 2 or not blanks:
            add(text, [0] * len(text))
        else:
            at = blanks[int(rng.integers(len(blanks)))] + 1
            tag, own = _layouts(rng)
            add(text[:at] + own + " " + text[at:], [0] * at + [tag] * len(own) + [0] * (1 + len(text) - at))
    shape = (0, SNIPPET)
    return train_tagger(np.stack(codes) if codes else np.zeros(shape, np.uint8), np.stack(tags) if tags else np.zeros(shape, np.int64))


def find_personal_data(df: DataFrame, tagger: Tagger, keep: list[str], text_col: str) -> DataFrame:
    """(kept columns, n_email, n_ip, n_card, n_phone, base_sha256, spans, added) of every whole text.

    Counts and digest are of the patterns' spans; `spans` has those and the network's (kind:start:end
    in code points, end exclusive, by kind then start); `added` counts the network's. Null and
    empty texts have none, repeated rows get equal answers, further columns are not read.
    """
    shared = sent_once(df.sparkSession, tagger)  # a few thousand numbers
    own = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kept = [f for f in own.schema.fields if f.name != "_text"]
    added = [*(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("added", LongType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_tagger = shared()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                base = [base_spans(t) for t in texts]
                more = [added_spans(t or "", b, g) for t, b, g in zip(texts, base, tag_spans(own_tagger, texts), strict=True)]
                every = [{k: b[k] + m[k] for k in KINDS} for b, m in zip(base, more, strict=True)]
                arrays = [
                    *batch.columns[:-1],
                    *(pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(joined_spans(b).encode()).hexdigest() for b in base], pa.string()),
                    pa.array([joined_spans(e) for e in every], pa.string()),
                    pa.array([sum(map(len, m.values())) for m in more], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *(f.name for f in added)])

    return own.mapInArrow(work, StructType([*kept, *added]))
