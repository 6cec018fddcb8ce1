"""PII by patterns and a character-level bidirectional LSTM with a CRF.

Base spans come from four patterns with checks (parts of an address, Luhn, numbers of digits). The tagger adds
others: a BiLSTM over characters gives a score for each tag (outside, begin or inside of a kind), a CRF's transitions
join them, and Viterbi decodes. It is trained in numpy from labelled spans: windows of a bounded sample of texts, with
their base spans, and made-up spans in many written forms, put into words of those texts. (A made-up number may lack
the plus, a check digit or a plain separator: these are the forms that the patterns miss.) The cells' gates and squashing
are piecewise linear, which costs a fraction of tanh.

Every character of every text goes through the BiLSTM, in overlapping windows; a character takes its tag from the window
in which it is farther from an end, and spans are read from the joined tags, so no window's edge cuts one. Viterbi runs
over the stretches in which the scores can outweigh what leaving the outside costs (an exact bound). A tagged span is kept if its kind's check holds (digits, parts, one @) and no base span
overlaps it.

Defined cases: a null text is an empty text, without spans; offsets count code points, ends are exclusive; rows that
repeat a doc_id are tagged each; without training texts the made-up spans alone are learned from; other columns are
left out; an empty table gives an empty result. Matching is linear in the text's length, also for very long runs of one
kind of character. Tags don't depend on which other texts are tagged along.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._labels import TRAIN_BYTES
from ._spark import tune

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that a failed match isn't tried again within the same run.
EMAIL_AFTER = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Windows of training, windows of tagging and how much two of them share, and windows that are computed together.
TRAIN_WINDOW, WINDOW, SHARED, ROWS = 96, 384, 48, 2048
EMBED, HIDDEN, TAGS = 12, 12, 1 + 2 * len(KINDS)
TRAIN_TEXTS, MADE, EPOCHS, BATCH, RATE, SEED = 300, 600, 14, 16, 0.016, 5


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in EMAIL_BEFORE:
            begin -= 1
        found = EMAIL_AFTER.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            done = found.end()
        at = found.end() if found else at + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        number = digits(m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


# --- characters and windows


def symbols(text: str) -> np.ndarray:
    """Character classes: 0 beyond the text, 1 a digit, 2 not ASCII, then the printable ASCII characters (A-Z apart as one)."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOL[np.minimum(code, 128)]


_SYMBOL = np.zeros(129, np.uint8)
_SYMBOL[:] = 2
_SYMBOL[32:127] = np.arange(95) + 3
_SYMBOL[65:91] = 98
_SYMBOL[48:58] = 1
_SYMBOL[:32] = 99
SYMBOLS = 100


def windows(length: int) -> list[int]:
    """Starts of the windows over a text."""
    return [*range(0, max(length - SHARED, 1), WINDOW - SHARED)] if length else []


# --- the tagger


@dataclass
class Model:
    embed: np.ndarray
    cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # forward, backward: input, recurrent, bias
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray  # from, to
    first: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.cells[0], *self.cells[1], self.out, self.bias, self.moves, self.first]


def new_model(rng: np.random.Generator) -> Model:
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    cell = lambda: (normal(EMBED, 4 * HIDDEN), normal(HIDDEN, 4 * HIDDEN), np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]))
    return Model(rng.normal(0, 0.5, (SYMBOLS, EMBED)), [cell(), cell()], normal(2 * HIDDEN, TAGS), np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS))


def _lstm(x: np.ndarray, cell: tuple) -> tuple[np.ndarray, list]:
    """x: (steps, rows, EMBED); the gates are forget, input, output, candidate."""
    wx, wh, b = cell
    put, h, c = x @ wx + b, np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
    out, kept = np.empty((len(x), x.shape[1], HIDDEN)), []
    for t in range(len(x)):
        z = put[t] + h @ wh
        gates, new = np.clip(0.25 * z[:, : 3 * HIDDEN] + 0.5, 0, 1), np.clip(z[:, 3 * HIDDEN :], -1, 1)
        before, c = c, gates[:, :HIDDEN] * c + gates[:, HIDDEN : 2 * HIDDEN] * new
        squashed = np.clip(c, -1, 1)
        kept.append((h, before, gates, new, squashed))
        h = out[t] = gates[:, 2 * HIDDEN :] * squashed
    return out, kept


def _lstm_back(x: np.ndarray, cell: tuple, kept: list, grad: np.ndarray) -> tuple[np.ndarray, tuple]:
    wx, wh, _ = cell
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    dz, dwh = np.empty((len(x), x.shape[1], 4 * HIDDEN)), np.zeros_like(wh)
    for t in reversed(range(len(x))):
        h, before, gates, new, squashed = kept[t]
        forget, enter, leave = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        slope = 0.25 * ((gates > 0) & (gates < 1))
        d = grad[t] + dh
        dc = dc + d * leave * (np.abs(squashed) < 1)
        dz[t] = np.concatenate([dc * before, dc * new, d * squashed, dc * enter * (np.abs(new) < 1)], 1)
        dz[t][:, : 3 * HIDDEN] *= slope
        dwh += h.T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * forget
    flat = dz.reshape(-1, dz.shape[2])
    return dz @ wx.T, (x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0))


def emissions(model: Model, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """codes: (rows, steps) -> (steps, rows, TAGS)."""
    x = model.embed[codes.T]
    ahead, kept_a = _lstm(x, model.cells[0])
    back, kept_b = _lstm(x[::-1], model.cells[1])
    both = np.concatenate([ahead, back[::-1]], 2)
    return both @ model.out + model.bias, (x, both, kept_a, kept_b)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradients(model: Model, codes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood a window under the CRF, and its gradients in the order of parameters()."""
    scores, (x, both, kept_a, kept_b) = emissions(model, codes)
    steps, rows, _ = scores.shape
    y = tags.T
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0] + model.first
    for t in range(1, steps):
        alpha[t] = scores[t] + _lse(alpha[t - 1][:, :, None] + model.moves, 1)
    for t in reversed(range(steps - 1)):
        beta[t] = _lse(model.moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    every = np.arange(rows)
    gold = model.first[y[0]] + sum(scores[t][every, y[t]] for t in range(steps)) + sum(model.moves[y[t - 1], y[t]] for t in range(1, steps))
    grad = np.exp(alpha + beta - total[None, :, None])
    dfirst, dmoves = grad[0].sum(0), np.zeros_like(model.moves)
    for t in range(1, steps):
        dmoves += np.exp(alpha[t - 1][:, :, None] + model.moves + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(dmoves, (y[t - 1], y[t]), -1)
    np.add.at(dfirst, y[0], -1)
    grad[np.arange(steps)[:, None], every[None, :], y] -= 1
    flat = grad.reshape(-1, TAGS)
    dboth = grad @ model.out.T
    dx_a, cell_a = _lstm_back(x, model.cells[0], kept_a, dboth[:, :, :HIDDEN])
    dx_b, cell_b = _lstm_back(x[::-1], model.cells[1], kept_b, dboth[::-1, :, HIDDEN:])
    dembed = np.zeros_like(model.embed)
    np.add.at(dembed, codes.T, dx_a + dx_b[::-1])
    out = [dembed, *cell_a, *cell_b, both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0), dmoves, dfirst]
    return float((total - gold).mean()), [g / rows for g in out]


class Tagger:
    """A model laid out for tagging: single precision, one row a feature. A step's input is one matrix product over the
    state, the characters' embeddings and a row of ones (for the bias)."""

    def __init__(self, model: Model):
        single = lambda x: np.ascontiguousarray(x, np.float32)
        self.embed = single(model.embed.T)
        self.cells, scale = [], np.concatenate([np.full(3 * HIDDEN, 0.25), np.ones(HIDDEN)])
        for k, (wx, wh, b) in enumerate(model.cells):
            bias = b * scale + np.concatenate([np.full(3 * HIDDEN, 0.5), np.zeros(HIDDEN)])
            self.cells.append((single(np.vstack([wh * scale, wx * scale, bias]).T), single(model.out[k * HIDDEN : (k + 1) * HIDDEN].T)))
        self.bias, self.moves, self.first = single(model.bias), single(model.moves), single(model.first)
        # the most that a tag other than outside can gain by its transitions, over staying outside
        stay, into, out = self.moves[0, 0], self.moves.max(0), self.moves[:, 0]
        leaving = np.maximum(0, out - stay)
        self.gain, self.first_gain = into - stay + leaving, self.first - self.first[0] + leaving

    def _direction(self, codes: np.ndarray, k: int) -> np.ndarray:
        """codes (steps, rows) -> (steps, TAGS, rows), of one direction."""
        weights, out = self.cells[k]
        steps, rows = codes.shape
        scores = np.empty((steps, TAGS, rows), np.float32)
        put = np.zeros((HIDDEN + EMBED + 1, rows), np.float32)
        put[-1] = 1
        h, own = put[:HIDDEN], put[HIDDEN:-1]
        c, s, z = np.zeros((HIDDEN, rows), np.float32), np.empty((HIDDEN, rows), np.float32), np.empty((4 * HIDDEN, rows), np.float32)
        gates, new = z[: 3 * HIDDEN], z[3 * HIDDEN :]
        for t in range(steps):
            np.take(self.embed, codes[t], 1, out=own, mode="clip")
            np.matmul(weights, put, out=z)
            np.clip(gates, 0, 1, out=gates)  # a third of the time of minimum() and maximum()
            np.clip(new, -1, 1, out=new)
            c *= z[:HIDDEN]
            np.multiply(z[HIDDEN : 2 * HIDDEN], new, out=s)
            c += s
            np.clip(c, -1, 1, out=s)
            np.multiply(s, z[2 * HIDDEN : 3 * HIDDEN], out=h)
            np.matmul(out, h, out=scores[t])
        return scores

    def scores(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """codes (rows, steps), each row's characters first -> (steps, TAGS, rows). Both directions begin at a row's own end."""
        rows, steps = codes.shape
        ahead = self._direction(np.ascontiguousarray(codes.T, np.intp), 0)
        place = lengths[:, None] - 1 - np.arange(steps)
        turned = np.where(place >= 0, np.take_along_axis(codes, np.maximum(place, 0), 1), 0)
        back = self._direction(np.ascontiguousarray(turned.T, np.intp), 1)
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), rows]
        for a, b in zip(cuts, cuts[1:]):  # rows of one length
            n = lengths[a]
            ahead[:n, :, a:b] += back[:n, :, a:b][::-1]
        ahead += self.bias[:, None]
        return ahead

    def decode(self, codes: np.ndarray, lengths: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """The best tags of the rows that aren't outside throughout."""
        lengths = np.full(len(codes), codes.shape[1]) if lengths is None else lengths
        scores = self.scores(codes, lengths)
        row, begin, end = self._stretches(scores, lengths)
        out: dict[int, np.ndarray] = {}
        for r, a, tags in zip(row.tolist(), begin.tolist(), self._best(scores, row, begin, end, lengths), strict=True):
            if tags.any():
                own = out.setdefault(r, np.zeros(lengths[r], np.int8))
                own[a : a + len(tags)] = tags
        return out

    def _stretches(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, begin, end) of the stretches in which a best path may leave the outside.

        over[t] is the most that tagging place t can gain over leaving it outside. A path that leaves the outside over
        a run of places gains at most the run's sum; a place of which no run has a positive sum stays outside."""
        over = (scores[:, 1:] + self.gain[1:, None]).max(1) - scores[:, 0]
        over[0] = np.maximum(over[0], (scores[0, 1:] + self.first_gain[1:, None]).max(0) - scores[0, 0])
        over += 1e-3
        over[np.arange(len(over))[:, None] >= lengths] = -1e9
        upto, after = over.copy(), over.copy()  # the best sums of runs that end, and begin, at each place
        for t in range(1, len(over)):
            upto[t] += np.maximum(upto[t - 1], 0)
            after[-1 - t] += np.maximum(after[-t], 0)
        held = np.zeros((over.shape[1], len(over) + 2), np.int8)
        held[:, 1:-1] = (upto + after - over > 0).T
        edge = np.diff(held, axis=1)
        (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        return row, begin, end

    def _best(self, scores: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The tags of the best path in each stretch, between places that are outside (or the ends of a row)."""
        size = end - begin
        if not len(size):
            return []
        by = np.argsort(-size, kind="stable")
        row, begin, end, size = row[by], begin[by], end[by], size[by]
        steps = int(size[0])
        many = np.searchsorted(-size, -np.arange(steps), side="left")  # the stretches that are longer than t
        moves = self.moves[:, :, None]
        best = np.empty((steps, TAGS, len(size)), np.float32)
        best[0] = scores[begin, :, row].T + np.where(begin == 0, self.first[:, None], self.moves[0][:, None])
        for t in range(1, steps):
            m = many[t]
            best[t, :, :m] = (best[t - 1, :, None, :m] + moves).max(0) + scores[begin[:m] + t, :, row[:m]].T
        last = best[size - 1, :, np.arange(len(size))].T + np.where(end == lengths[row], 0, self.moves[:, 0][:, None])
        tags = np.empty((steps, len(size)), np.int8)
        tags[size - 1, np.arange(len(size))] = last.argmax(0)
        for t in reversed(range(steps - 1)):
            m = many[t + 1]
            tags[t, :m] = (best[t, :, :m] + self.moves[:, tags[t + 1, :m]]).argmax(0)
        out: list[np.ndarray] = [tags[:0, 0]] * len(size)
        for k, place in enumerate(by.tolist()):
            out[place] = tags[: size[k], k]
        return out


def decode(model: Model, codes: np.ndarray) -> np.ndarray:
    """The best tags of each window, (rows, steps)."""
    out = np.zeros(codes.shape, np.int64)
    for row, tags in Tagger(model).decode(codes).items():
        out[row] = tags
    return out


def fit(examples: list[tuple[np.ndarray, np.ndarray]], seed: int = SEED) -> Model:
    """Adam over windows (codes, tags)."""
    rng = np.random.default_rng(seed)
    model = new_model(rng)
    codes, tags = (np.stack([e[k] for e in examples]) for k in (0, 1))
    held = model.parameters()
    first, second, k = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            own, k = order[at : at + BATCH], k + 1
            _, grads = gradients(model, codes[own], tags[own])
            norm = np.sqrt(sum((g * g).sum() for g in grads))
            for p, g, m, v in zip(held, grads, first, second, strict=True):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (1 - 0.8 * epoch / EPOCHS) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model


# --- labelled spans


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for start, kind, end in spans:
        out[start:end] = 2 + 2 * kind
        out[start] = 1 + 2 * kind
    return out


def _window(text: str, spans: list, begin: int) -> tuple[np.ndarray, np.ndarray]:
    codes, tags = np.zeros(TRAIN_WINDOW, np.int64), np.zeros(TRAIN_WINDOW, np.int64)
    own = symbols(text[begin : begin + TRAIN_WINDOW])
    codes[: len(own)] = own
    tags[: len(own)] = tags_of(len(text), spans)[begin : begin + TRAIN_WINDOW]
    return codes, tags


def made_up(rng: random.Random) -> tuple[str, int]:
    """A span in one of many forms, and its kind."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    kind = rng.randrange(len(KINDS))
    if kind == 0:
        who = rng.choice([name(), f"{name()}.{name()}", f"{name()}.{number(2)}", f"{name()}_{name()}", f"{name()}+{name()}", name().title()])
        return f"{who}@{rng.choice([name(), name() + number(1) + '.' + name(), name() + '-' + name()])}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk'])}", kind
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == 2:
        body = rng.choice("3456") + number(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        cut = rng.choice(["", "", " ", "-", ".", "  "])
        return cut.join(body[i : i + 4] for i in range(0, 16, 4)), kind
    area, mid, last = number(3), number(3), number(4)
    plain = rng.choice([f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"({area}){mid}-{last}"])
    return rng.choice([f"+1 ({area}) {mid}-{last}", f"+{number(2)} {area} {mid} {last}", f"+1-{area}-{mid}-{last}", f"001 {area} {mid} {last}", plain, plain]), kind


_SIGNS = re.compile("[0-9@][^0-9@]{0,40}")


def examples(texts: list[str], made: int = MADE, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows with their tags: those of the texts' base spans and other digits and of any place, then made-up spans
    among their words."""
    rng = random.Random(seed)
    out = []
    words = [w for t in texts[:50] for w in t.split()[:200] if w.isalpha()] or ["the", "of", "and", "in"]
    for text in texts:
        spans = base_spans(text)
        places = [s[0] for s in spans] + [m.start() for m in _SIGNS.finditer(text)]
        for at in [*rng.sample(places, min(3, len(places))), rng.randrange(len(text) + 1)]:
            begin = max(0, at - rng.randint(0, TRAIN_WINDOW // 2))
            out.append(_window(text, spans, begin))
    others = (lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 9)}.", lambda: str(rng.randint(0, 10 ** rng.randint(1, 9))), lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"@{rng.choice(words)}", lambda: f"{rng.randint(1, 9)},{rng.randint(100, 999)}.{rng.randint(10, 99)}", lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"')
    for _ in range(made):
        text, spans = "", []
        while len(text) < TRAIN_WINDOW:
            text += " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice([" ", ", ", ": ", " - ", "\n", " | "])
            if rng.random() < 0.6:
                span, kind = made_up(rng)
                spans.append((len(text), kind, len(text) + len(span)))
                text += span + rng.choice([" ", ". ", ", ", "\n", "!! "])
            elif rng.random() < 0.5:
                text += rng.choice(others)() + " "
        out.append(_window(text, spans, rng.randint(0, max(0, len(text) - TRAIN_WINDOW))))
    return out


def train(docs: DataFrame, texts: int = TRAIN_TEXTS) -> Model:
    """Fitted on at most `texts` texts that hold a digit or @, picked by a hash of doc_id."""
    usable = docs.where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= TRAIN_BYTES))
    ids = usable.select(F.col("doc_id").cast("long").alias("__id")).orderBy(F.xxhash64(F.col("__id"), F.lit(23)), "__id").limit(texts)
    own = usable.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(ids.distinct()), "__id")
    got = own.orderBy(F.xxhash64("__id", F.lit(23)), "__id", "__text").limit(texts).collect()
    return fit(examples([t for _, t in sorted(tuple(r) for r in got)]))


# --- tagging


def tagged_spans(model: Tagger | Model, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger finds in each text, before the checks."""
    tagger = model if isinstance(model, Tagger) else Tagger(model)
    coded = [symbols(t) for t in texts]
    # windows of like length are computed together
    jobs = sorted(((min(WINDOW, len(c) - w), i, w) for i, c in enumerate(coded) for w in windows(len(c))), reverse=True)
    tags: dict[int, np.ndarray] = {}
    for at in range(0, len(jobs), ROWS):
        some = jobs[at : at + ROWS]
        codes = np.zeros((len(some), some[0][0]), np.uint8)
        for row, (n, i, w) in zip(codes, some, strict=True):
            row[:n] = coded[i][w : w + n]
        for k, own in tagger.decode(codes, np.array([n for n, _, _ in some])).items():
            n, i, w = some[k]
            first = SHARED // 2 if w else 0  # of what two windows share, each gives the half that is farther from its end
            last = n if w + n == len(coded[i]) else n - SHARED // 2
            tags.setdefault(i, np.zeros(len(coded[i]), np.int8))[w + first : w + last] = own[first:last]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, own in tags.items():
        kind = np.where(own > 0, (own - 1) // 2, -1)
        start = (own > 0) & ((own % 2 == 1) | (np.concatenate([[-1], kind[:-1]]) != kind))
        after = np.append(np.flatnonzero(start | (own == 0)), len(own))
        for a in np.flatnonzero(start).tolist():
            out[i].append((a, int(kind[a]), int(after[np.searchsorted(after, a, side="right")])))
    return out


def plausible(text: str, kind: int) -> bool:
    """A tagged span's check."""
    number = digits(text)
    if kind == 0:
        name, at, host = text.partition("@")
        return bool(name and at and "." in host.strip(".") and "@" not in host and not any(c.isspace() for c in text))
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(number) <= 19 and luhn(number) and not any(c.isalpha() for c in text)
    return 10 <= len(number) <= 15 and any(c in "+()-. " for c in text) and not any(c.isalpha() for c in text)


def all_spans(base: list, tagged: list, text: str) -> list[tuple[int, int, int]]:
    out = list(base)
    for start, kind, end in tagged:
        while end > start and not (text[end - 1].isalnum() or text[end - 1] in ")"):
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        if end > start and plausible(text[start:end], kind) and all(b <= start or end <= a for a, _, b in out):
            out.append((start, kind, end))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, base string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and all spans as kind:start:end lists, and the number of base spans of each kind."""
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        for block in X.blocks(batches, 1, 4 << 20):
            texts = [t.as_py() or "" for t in block.column(1)]
            base, spans, counts = [], [], np.zeros((len(KINDS), block.num_rows), np.int64)
            for i, (text, tagged) in enumerate(zip(texts, tagged_spans(tagger, texts), strict=True)):
                own = base_spans(text)
                base.append(listed(own))
                spans.append(listed(all_spans(own, tagged, text)))
                for _, kind, _ in own:
                    counts[kind, i] += 1
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(base, pa.string()), pa.array(spans, pa.string()), *map(pa.array, counts)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op8(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
