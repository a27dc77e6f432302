"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans come from fixed patterns with exact checks (`base_spans`). The model adds spans of the same kinds that the
patterns miss (telephone numbers without a plus sign, addresses with blanks or [@], cards and network addresses with
other separators); addresses with (at) come from a pattern of their own (`at_spans`) and not from the model. It is trained here in numpy from labelled spans: `training_windows` writes texts of invented words
in which the spans' places are known, along with look-alikes that are no personal data (keys, hashes, versions, dates,
prices, serial numbers). Training depends on the seed alone, so every task and every run has the same model.

A text is read in windows of `WINDOW` characters that overlap by half, so that a span of up to half a window stands
whole in some window. Each window is decoded by Viterbi search. The pieces of a span that windows' edges cut are joined
where they meet, so spans of any length are found. All windows' spans are reconciled over the whole text: equal ones
add up their margins, and of those that overlap the set with the greatest sum is kept (weighted interval scheduling).
A kept span must also hold `MUST_HOLD` and pass its kind's check, and may not touch a base span. Windows without a digit
or @ can hold no such span by themselves and are decoded only where a neighbouring window cuts one. Spans of `at_spans`
go before those of the model.

Cases: null and empty texts have no spans; texts are read whole; null and repeated doc_ids stay as rows; no rows give
no rows; other columns are left alone. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import exists, in_small_batches, shared_dir

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MUST_HOLD = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[Span]:
    """Matches of the address pattern, found from each @, which takes time in proportion to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            yield "email", start, domain.end()
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    parts = re.findall(r"[0-9]+", text)
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def _is_card(text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 8 <= len(re.sub(r"[^0-9]", "", text)) <= 15


_CHECKS = {"ip": _is_ip, "card": _is_card, "phone": _is_phone}


def base_spans(text: str) -> list[Span]:
    """The pattern's spans by kind as listed, then start."""
    if not MUST_HOLD.search(text):
        return []
    spans = list(_emails(text))
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _CHECKS[kind](m[0])]
    return spans


# The model. Tags: 0 outside, then for each kind one that begins and one that continues a span.

TAGS = 1 + 2 * len(KINDS)
WINDOW = 96
EMBED, HIDDEN = 16, 32
_ALLOWED = np.full((TAGS, TAGS), -1e4, np.float32)
_ALLOWED[:, 0] = 0
for _k in range(len(KINDS)):
    _ALLOWED[:, 1 + 2 * _k] = 0
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
_STARTS = np.array([0 if t == 0 or t % 2 else -1e4 for t in range(TAGS)], np.float32)
SYMBOLS = 101


@cache
def _symbol_table() -> np.ndarray:
    """Input symbols by code point: ASCII as it is, other letters, digits, white space and the rest by kind."""
    table = np.full(0x110000, 99, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = 95 if ch.isalpha() else 96 if ch.isdigit() else 97 if ch.isspace() else 98
    table[0x3000:] = 95
    table[32:127] = np.arange(95)
    return table


PAD = 100


def symbols(text: str) -> np.ndarray:
    return _symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


class Tagger:
    """Parameters and passes of the network, on batches of windows of symbols."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"embed": rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32), "out": draw(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1  # cells keep what they hold at first
            self.p |= {f"{way}_in": draw(EMBED, 4 * HIDDEN), f"{way}_rec": draw(HIDDEN, 4 * HIDDEN), f"{way}_b": bias}

    def _pass(self, x: np.ndarray, keep: bool = False):
        """Hidden states of both directions over (time, batch) symbols, (time, 2, batch, HIDDEN), the second one from the
        end; with `keep` also the gates and cells that the gradient needs. Sigmoids are taken as tanh of half."""
        p, steps, n = self.p, *x.shape
        drive = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
        for d, (way, row) in enumerate((("f", x), ("b", x[::-1]))):
            drive[:, d] = (p["embed"] @ p[f"{way}_in"] + p[f"{way}_b"])[row]
        rec = np.stack((p["f_rec"], p["b_rec"]))
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        hidden, cells = np.empty((steps, 2, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = drive[t]
            z += h @ rec
            z[..., : 3 * HIDDEN] *= 0.5
            np.tanh(z, out=z)
            s = z[..., : 3 * HIDDEN]
            s += 1
            s *= 0.5
            i, f, o, g = (z[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = np.multiply(o, tc, out=hidden[t])
            if keep:
                cells.append((before, tc))
        return hidden, drive, cells  # the gates have taken the place of what drives them

    def _emissions(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate((hidden[:, 0], hidden[::-1, 1]), axis=2)
        return states, states @ self.p["out"] + self.p["out_b"]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._emissions(self._pass(x)[0])[1]

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tags, and its gradient."""
        p, (steps, n) = self.p, x.shape
        hidden, gates, cells = self._pass(x, keep=True)
        states, e = self._emissions(hidden)
        loss, de, d_trans = crf_gradients(e, tags, p["trans"] + _ALLOWED)
        flat = de.reshape(-1, TAGS)
        g = {"trans": d_trans, "out": states.reshape(-1, 2 * HIDDEN).T @ flat, "out_b": flat.sum(0)}
        d_states = de @ p["out"].T
        d_out = np.stack((d_states[:, :, :HIDDEN], d_states[::-1, :, HIDDEN:]), axis=1)
        back = np.ascontiguousarray(np.stack((p["f_rec"].T, p["b_rec"].T)))
        dh = dc = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            before, tc = cells[t]
            i, f, o, g_ = (gates[t, ..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            slopes = (dc * g_ * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g_ * g_))
            dc = dc * f
            dz = gates[t] = np.concatenate(slopes, axis=2)  # a step's gates are not needed any more
            dh = dz @ back
        onehot = np.zeros((x.size, SYMBOLS), np.float32)
        onehot[np.arange(x.size), x.ravel()] = 1
        embedded, g["embed"] = p["embed"][x].reshape(-1, EMBED), np.zeros_like(p["embed"])
        for d, way in enumerate("fb"):
            before = np.concatenate((np.zeros((1, n, HIDDEN), np.float32), hidden[:-1, d])).reshape(-1, HIDDEN)
            own = gates[:, d].reshape(-1, 4 * HIDDEN)
            in_order = own if way == "f" else gates[::-1, d].reshape(-1, 4 * HIDDEN)
            g |= {f"{way}_rec": before.T @ own, f"{way}_in": embedded.T @ in_order, f"{way}_b": own.sum(0)}
            g["embed"] += onehot.T @ (in_order @ p[f"{way}_in"].T)
        return loss, g

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window, (time, batch), and the margin of each tag over `outside` by its emission."""
        e, trans = self.emissions(x), self.p["trans"] + _ALLOWED
        best, back = e[0] + _STARTS, np.zeros((*x.shape, TAGS), np.int8)
        for t in range(1, len(x)):
            sums = best[:, :, None] + trans
            back[t] = sums.argmax(1)
            best = sums.max(1) + e[t]
        tags = np.empty(x.shape, np.int8)
        tags[-1] = best.argmax(1)
        every = np.arange(x.shape[1])
        for t in range(len(x) - 1, 0, -1):
            tags[t - 1] = back[t, every, tags[t]]
        margin = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]
        return tags, margin


def crf_gradients(e: np.ndarray, tags: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of (time, batch) tags under a linear chain, and gradients by emissions and transitions.

    Forward and backward sums are kept as shares that add up to one at each step, with the steps' factors apart."""
    steps, n = tags.shape
    every, moves = np.arange(n), np.exp(trans.astype(np.float64))
    top = e.max(axis=2, keepdims=True)
    own = np.exp((e - top).astype(np.float64))
    forward, backward, factor = np.empty_like(own), np.ones_like(own), np.empty((steps, n, 1))
    for t in range(steps):
        now = own[t] * (np.exp(_STARTS) if t == 0 else forward[t - 1] @ moves)
        factor[t] = now.sum(axis=1, keepdims=True)
        forward[t] = now / factor[t]
    ahead = np.empty_like(own)
    for t in range(steps - 1, -1, -1):
        ahead[t] = own[t] * backward[t] / factor[t]
        if t:
            backward[t - 1] = ahead[t] @ moves.T
    total = np.log(factor).sum(axis=(0, 2)) + top.sum(axis=(0, 2))
    de = forward * backward
    gold = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0].sum(axis=0) + _STARTS[tags[0]] + trans[tags[:-1], tags[1:]].sum(axis=0)
    de[np.arange(steps)[:, None], every, tags] -= 1
    d_trans = moves * (forward[:-1].reshape(-1, TAGS).T @ ahead[1:].reshape(-1, TAGS))
    np.add.at(d_trans, (tags[:-1], tags[1:]), -1)
    return float((total - gold).mean()), (de / n).astype(np.float32), (d_trans / n).astype(np.float32)


# Labelled spans to learn from.

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que eau ment ción ado sch ung keit über ä ö é".split()


class _Writer:
    """Writes one text with the places of its spans."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.parts, self.spans, self.size = rng, [], [], 0

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def add(self, text: str, kind: int | None = None) -> None:
        if kind is not None:
            self.spans.append((kind, self.size, self.size + len(text)))
        self.parts.append(text)
        self.size += len(text)

    def word(self) -> str:
        w = "".join(self.pick(_SYLLABLES) for _ in range(1 + int(self.rng.integers(4))))
        return self.pick([w, w, w, w.capitalize(), w + ",", w + ".", w.upper() + "!!", w + "***", "| " + w])

    def digits(self, n: int) -> str:
        return "".join(str(d) for d in self.rng.integers(0, 10, n))

    def ip(self) -> str:
        sep = self.pick([".", "[.]", " . ", "(.)"])
        return sep.join(str(n) for n in self.rng.integers(0, 256, 4))

    def email(self) -> str:
        name = self.pick(_SYLLABLES[:30]) + self.pick(_SYLLABLES[:30]) + self.pick(["", ".", "_"]) + self.digits(self.rng.integers(0, 4))
        host = self.pick(["mail", "post", "web", "inbox"]) + self.pick(["", self.digits(1)])
        at, dot = self.pick([("@", "."), (" @ ", "."), ("@", " . "), ("@", "[.]"), ("[@]", "."), ("@", ".")])
        return f"{name or 'ab'}{at}{host}{dot}{self.pick(['example', 'site', 'corp'])}{dot}{self.pick(['com', 'org', 'net', 'de'])}"

    def card(self, good: bool = True) -> str:
        body = self.pick(["4", "51", "37", "60"])
        body += self.digits(15 - len(body))
        check = next(d for d in range(10) if luhn(body + str(d)) == good)
        number = body + str(check)
        sep = self.pick(["", " ", "-", ".", "/", "_"])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"0{a}/{b}{c}", f"{a}.{b}.{c}", f"00{self.digits(2)} {a} {b} {c}", f"+{self.digits(2)} {a} {b}{c}"])

    def decoy(self) -> str:
        """Holds digits or @ and is no personal data."""
        n, letters, part = self.digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", lambda: self.pick(_SYLLABLES)
        hexes = lambda: "".join("0123456789abcdef"[d] for d in self.rng.integers(0, 16, int(self.pick([12, 18, 32, 40]))))
        return self.pick([
            lambda: f'token = "{hexes()}"', lambda: f"password={hexes()}", lambda: "AKIA" + "".join(letters[d] for d in self.rng.integers(0, 32, 16)), lambda: f"v{n(1)}.{n(1)}", lambda: f"{n(1)}.{n(1)}.{n(1)}",
            lambda: "Version 2.0.", lambda: "CC BY-NC 4.0.", lambda: "version 3.", lambda: f"20{n(2)}-0{n(1)}-1{n(1)}", lambda: f"1{n(1)}:{n(2)}", lambda: f"{n(2)}.{n(2)} EUR", lambda: n(5), lambda: n(3), lambda: n(16), lambda: n(20),
            lambda: f"#{n(6)}", lambda: f"{n(3)}.{n(3)}", lambda: f"p. {n(3)}", lambda: f"@{part()}", lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"(19{n(2)})", lambda: f"{n(2)}%", lambda: f"{part()}{n(2)}",
            lambda: f"3{n(2)}.{n(3)}.7{n(2)}.{n(3)}", lambda: f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}",
        ])()


def training_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) symbols and tags."""
    rng = np.random.default_rng(seed)
    x, y = np.full((WINDOW, n), PAD, np.uint8), np.zeros((WINDOW, n), np.int64)
    for w in range(n):
        text = _Writer(rng)
        while text.size < 2 * WINDOW:
            # personal data often stands next to more of it
            roll = rng.random() * (0.3 if text.spans and text.size == text.spans[-1][2] + 1 else 1)
            if roll < 0.1:
                kind = int(rng.integers(4))
                text.add((text.email, text.ip, text.card, text.phone)[kind](), kind)
            elif roll < 0.2:
                text.add(text.decoy() if rng.random() < 0.9 else text.card(False))
            else:
                text.add(text.word())
            text.add(text.pick([" ", " ", " ", " ", "\n"]))
        shift = int(rng.integers(WINDOW))
        held = symbols("".join(text.parts))[shift : shift + WINDOW]
        x[: len(held), w] = held
        for kind, a, b in text.spans:
            a, b = max(a - shift, 0), min(b - shift, WINDOW)
            if a < b:
                y[a:b, w] = 2 + 2 * kind
                y[a, w] = 1 + 2 * kind
    return x, y


@cache
def trained(windows: int = 4000, rounds: int = 8, batch: int = 64, rate: float = 0.008, seed: int = 5) -> Tagger:
    """The tagger after Adam over the training windows; the same for the same arguments."""
    x, y = training_windows(windows, seed)
    model, rng = Tagger(), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(p) for k, p in model.p.items()} for _ in range(2))
    step, steps = 0, rounds * -(-windows // batch)
    for _ in range(rounds):
        order = rng.permutation(windows)
        for start in range(0, windows, batch):
            rows = order[start : start + batch]
            _, g = model.gradients(x[:, rows], y[:, rows])
            step += 1
            clip = min(1.0, 5 / (np.sqrt(sum(float((a * a).sum()) for a in g.values())) + 1e-9))
            now = rate * (1 - step / (steps + 1)) / (1 - 0.9**step)
            for k, p in model.p.items():
                m[k] = 0.9 * m[k] + 0.1 * clip * g[k]
                v[k] = 0.99 * v[k] + 0.01 * (clip * g[k]) ** 2
                p -= now * m[k] / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return model


@cache
def _digest() -> str:
    """Names this module's code, which decides the weights."""
    return hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:32]


def stored(spark: SparkSession) -> Tagger:
    """The trained tagger from the cluster's shared folder; trained and written there where this code's is not there yet."""
    path = f"{shared_dir(spark)}/tagger-{_digest()}"
    if not exists(spark, f"{path}/_SUCCESS"):
        rows = [(k, list(p.shape), bytearray(p.tobytes())) for k, p in trained().p.items()]
        try:
            spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.parquet(path)
        except AnalysisException:
            return trained()  # another session is writing the same weights
    model = Tagger()
    for r in spark.read.parquet(path).collect():  # a row per parameter
        model.p[r.name] = np.frombuffer(bytes(r.data), np.float32).reshape(r["shape"]).copy()
    return model


def reconcile(found: dict[Span, float]) -> list[Span]:
    """The set of spans without overlap that has the greatest sum of margins, by start."""
    spans = sorted(found, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for i, s in enumerate(spans):
        j = int(np.searchsorted(ends[:i], s[1], side="right"))
        take.append(best[j] + found[s] > best[-1])
        best.append(max(best[-1], best[j] + found[s]))
    kept, i = [], len(spans)
    while i:
        if take[i - 1]:
            kept.append(spans[i - 1])
            i = int(np.searchsorted(ends[: i - 1], spans[i - 1][1], side="right"))
        else:
            i -= 1
    return kept[::-1]


_TRIM = " \t\n\r.,;:!?'\"*&%$#|"


def _fits(kind: str, text: str) -> bool:
    """Whether a span of the model is one of its kind."""
    if kind == "email":
        return re.fullmatch(r"[^\s@]+\s?\[?@\]?\s?[^\s@]+(?:\s?\[?\.\]?\s?[^\s@.]+)+", text) is not None and text.count("@") == 1
    if kind == "phone":
        return 10 <= len(re.sub(r"[^0-9]", "", text)) <= 15 and re.fullmatch(r"[+0-9(][0-9 ()./-]+[0-9]", text) is not None and re.search(r"[ ()./-]", text) is not None
    return _CHECKS[kind](text) and re.search(r"[A-Za-z]", text) is None


def _pieces(own: np.ndarray, margin: np.ndarray, size: int) -> Iterator[tuple[int, int, int, float]]:
    """(kind, start, end, margin) of the spans of a window's tags."""
    t = 0
    while t < size:
        if own[t] == 0:
            t += 1
            continue
        kind, b = (own[t] - 1) // 2, t + 1
        while b < size and own[b] == 2 + 2 * kind:
            b += 1
        yield kind, t, b, float(margin[t:b].sum())
        t = b


def joined(cut: list[tuple[int, int, int, float, bool, bool]]) -> Iterator[tuple[Span, float]]:
    """Whole spans from pieces (kind, start, end, margin, cut at its start, cut at its end) that windows' edges cut."""
    for kind in range(len(KINDS)):
        run = None
        for _, a, b, w, left, right in sorted(c for c in cut if c[0] == kind):
            if run and left and run[4] and a <= run[1]:
                run = (run[0], max(run[1], b), run[2] + w, run[3], right if b >= run[1] else run[4])
            else:
                if run and not (run[3] or run[4]):
                    yield (KINDS[kind], run[0], run[1]), run[2]
                run = (a, b, w, left, right)
        if run and not (run[3] or run[4]):
            yield (KINDS[kind], run[0], run[1]), run[2]


def model_spans(texts: list[str], model: Tagger, batch: int = 512, every: bool = False) -> list[list[Span]]:
    """The spans that the tagger finds in each text, reconciled over its windows.

    Windows with a digit or @ are decoded (with `every`, all of them), and those next to one that cuts a span."""
    half = WINDOW // 2
    last = [max(0, -(-len(t) // half) - 2) for t in texts]  # each text's last window; it reaches the end
    if every:
        wanted = [(i, k) for i, n in enumerate(last) for k in range(n + 1)]
    else:
        wanted = sorted({(i, min(k, last[i])) for i, t in enumerate(texts) for m in MUST_HOLD.finditer(t) for k in (max(m.start() // half - 1, 0), m.start() // half)})
    done = set(wanted)
    found: list[dict[Span, float]] = [{} for _ in texts]
    cut: list[list] = [[] for _ in texts]
    while wanted:
        more = set()
        for start in range(0, len(wanted), batch):
            part = wanted[start : start + batch]
            x = np.full((WINDOW, len(part)), PAD, np.uint8)
            for n, (i, k) in enumerate(part):
                rows = symbols(texts[i][k * half : k * half + WINDOW])
                x[: len(rows), n] = rows
            tags, margin = model.decode(x)
            for n in np.flatnonzero((tags != 0).any(axis=0)):
                i, k = part[n]
                a, size = k * half, min(WINDOW, len(texts[i]) - k * half)
                for kind, s, e, w in _pieces(tags[:, n], margin[:, n], size):
                    left, right = s == 0 and k > 0, e == WINDOW and a + WINDOW < len(texts[i])
                    if left or right:
                        cut[i].append((kind, a + s, a + e, w, left, right))
                        more |= ({(i, k - 1)} if left else set()) | ({(i, k + 1)} if right else set())
                    else:
                        span = (KINDS[kind], a + s, a + e)
                        found[i][span] = found[i].get(span, 0.0) + w
        wanted = sorted(more - done)
        done |= more
    for own, pieces in zip(found, cut, strict=True):
        for span, w in joined(pieces):
            own[span] = own.get(span, 0.0) + w
    return [reconcile({s: w for s, w in f.items() if w > 0}) for f in found]


_AT = re.compile(r"[ \t]?(?:\([ \t]?at[ \t]?\)|\[[ \t]?at[ \t]?\]|\{[ \t]?at[ \t]?\})[ \t]?", re.IGNORECASE)
_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ \t]?[(\[{][ \t]?(?:dot|\.)[ \t]?[)\]}][ \t]?)[A-Za-z0-9-]+)+", re.IGNORECASE)


def at_spans(text: str) -> list[Span]:
    """Addresses with (at), [at] or {at}, and with dots written out alike, found from each such mark."""
    found, done = [], 0
    for mark in _AT.finditer(text):
        start = mark.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        while start < mark.start() and text[start] in _TRIM:
            start += 1
        domain = _AT_DOMAIN.match(text, mark.end())
        if start < mark.start() and domain and (start == 0 or not text[start - 1].isalnum()) and not text[domain.end() : domain.end() + 1].isalnum():
            found.append(("email", start, domain.end()))
            done = domain.end()
    return found


def all_spans(texts: list[str], model: Tagger) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans: these, those of `at_spans` and those that the model adds."""
    for text, more in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        added = [s for s in at_spans(text) if all(s[2] <= x or y <= s[1] for _, x, y in base)]
        taken = [*base, *added]
        for kind, a, b in more:
            while a < b and text[a] in _TRIM:
                a += 1
            while a < b and text[b - 1] in _TRIM:
                b -= 1
            inner = a == 0 or not text[a - 1].isalnum()
            outer = b == len(text) or not text[b].isalnum()
            if a < b and inner and outer and MUST_HOLD.search(text, a, b) and _fits(kind, text[a:b]) and all(b <= x or y <= a for _, x, y in taken):
                added.append((kind, a, b))
        yield base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


FOUND = "struct<n_email:long,n_ip:long,n_card:long,n_phone:long,base_sha256:string,spans:string,masked:string>"


def found_in(text: str = "text", model: Tagger | None = None) -> Column:
    """Counts and digest of the base spans, all spans, and the masked text of each text."""
    model = model or stored(SparkSession.active())

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch.fillna("").tolist(), []
            for text, (base, spans) in zip(texts, all_spans(texts, model), strict=True):
                kinds = [s[0] for s in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), masked(text, spans)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"]).astype({"base_sha256": object, "spans": object, "masked": object})

    return find(text)


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts of base spans, their digest, all spans and the masked text."""
    return in_small_batches(docs).select("doc_id", found_in(**options).alias("f")).select("doc_id", "f.*")


def without_personal_data(docs: DataFrame, **options) -> DataFrame:
    """The documents with spans masked, columns as given; a null text stays null and n_chars, if there, is that of the new text."""
    out = in_small_batches(docs).withColumn("text", F.when(F.col("text").isNotNull(), found_in(**options)["masked"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
