"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. The network, written and
trained in numpy, finds the same four kinds in writings that the patterns don't allow: blanks around at signs
and dots, ``(at)`` and ``dot`` in words, bracketed dots, digits grouped by other marks, phone numbers without a
plus or in national form. Its labelled spans are put into texts of the sample: all kinds equally often, each in
plain and in varied writing, and as many numbers of other meaning (dates, versions, amounts, references) that
stay outside. It reads overlapping windows; each window is decoded by Viterbi, a character takes its tag from
the window in whose middle it is most, and the tags of a whole text make its spans. Added spans need a mean
posterior of ``sure``, numbers that can be of their kind (:func:`valid`, which looks at digits only, not at how
they are written), and be clear of base spans.

Every kind contains a digit, an at sign or a written ``at`` before a dot, so windows lie around those; the rest
of a text is read by the patterns only. Fitting takes at most ``most_windows`` windows, ``most_of_text`` of a
text and ``sample_docs`` documents on average. Null and empty texts have no spans, repeated rows get equal
results, empty tables give empty tables, long texts take linear time. Offsets count code points, the end is
exclusive.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from wellspan.llm.common import map_batches, spread_key, table, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = "".join(c for c in map(chr, range(128)) if c.isalnum() or c in "._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")  # a match can't start inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    low = 0  # no local part reaches back over an at sign
    while at >= 0:
        low = max(low, done)
        start = low + len(text[low:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        low, at = at + 1, text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in IP.finditer(text)
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


# --- the network -------------------------------------------------------------------------

# characters with a symbol of their own, among them the letters of "at" and "dot"; digits, letters and the rest share theirs
MARKS = "@.+-_%() \n:=/\",;'[]{}#*|<>&!?~$atdo"
N_SYMBOLS = 6 + len(MARKS)
_SYMBOL = np.full(128, 5, np.int8)
for _c in range(128):
    _ch = chr(_c)
    if _ch in MARKS:
        _SYMBOL[_c] = 6 + MARKS.index(_ch)
    elif _ch.isdigit():
        _SYMBOL[_c] = 1
    elif _ch.islower():
        _SYMBOL[_c] = 2
    elif _ch.isupper():
        _SYMBOL[_c] = 3
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k: kind k begins; 2 + 2k: goes on


def symbols(text: str) -> np.ndarray:
    """0 is kept for padding, 4 for characters beyond ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _SYMBOL[np.minimum(points, 127)], 4).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def lstm(x: np.ndarray, wh: np.ndarray):
    """x: [time, row, 4 * hidden], the inputs' part of the gates. Returns states and what backpropagation needs."""
    steps, n, h4 = x.shape
    size = h4 // 4
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    hs, kept = np.empty((steps, n, size), x.dtype), []
    for t in range(steps):
        z = x[t] + h @ wh
        gates = _sigmoid(z[:, :3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        before_h, before_c = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        kept.append((i, f, o, g, tc, before_c, before_h))
    return hs, kept


def lstm_back(dhs: np.ndarray, kept, wh: np.ndarray):
    """Gradients by x and wh."""
    steps, n, size = dhs.shape
    dx, dwh = np.empty((steps, n, 4 * size), dhs.dtype), np.zeros_like(wh)
    dh, dc = np.zeros((n, size), dhs.dtype), np.zeros((n, size), dhs.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, tc, before_c, before_h = kept[t]
        dh = dh + dhs[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dwh += before_h.T @ dz
        dx[t], dh, dc = dz, dz @ wh.T, dc * f
    return dx, dwh


def forward_backward(e: np.ndarray, a: np.ndarray):
    """Log sums over all tag sequences up to and from each place [time, row, tag], and over all [row]."""
    steps, n, _ = e.shape
    top = e.max(axis=2, keepdims=True).astype(np.float64)
    here, between = np.exp(e - top), np.exp(a.astype(np.float64))
    alpha, beta = np.empty(here.shape), np.ones(here.shape)  # each place sums to one, its size is kept apart
    up, down = np.empty((steps, n, 1)), np.zeros((steps, n, 1))
    for t in range(steps):
        x = (alpha[t - 1] @ between) * here[t] if t else here[0]
        up[t] = x.sum(axis=1, keepdims=True)
        alpha[t] = x / up[t]
    for t in range(steps - 2, -1, -1):
        x = (here[t + 1] * beta[t + 1]) @ between.T
        size = x.sum(axis=1, keepdims=True)
        beta[t] = x / size
        down[t] = down[t + 1] + np.log(size) + top[t + 1]
    up = np.cumsum(np.log(up) + top, axis=0)
    return np.log(np.maximum(alpha, 1e-300)) + up, np.log(np.maximum(beta, 1e-300)) + down, up[-1, :, 0]


def crf(e: np.ndarray, a: np.ndarray, gold: np.ndarray):
    """Mean negative log-likelihood of the gold tags, and gradients by emissions [time, row, tag] and transitions."""
    steps, n, _ = e.shape
    alpha, beta, z = forward_backward(e, a)
    de = np.exp(alpha + beta - z[None, :, None])
    rows, times = np.arange(n), np.arange(steps)[:, None]
    score = e[times, rows, gold].sum(axis=0) + a[gold[:-1], gold[1:]].sum(axis=0)
    de[times, rows, gold] -= 1
    before, after = alpha[:-1], e[1:] + beta[1:]
    x, y = before.max(axis=2, keepdims=True), after.max(axis=2, keepdims=True)
    da = np.exp(a) * np.einsum("tni,tnj->ij", np.exp(before - x) * np.exp(x + y - z[None, :, None]), np.exp(after - y), optimize=True)
    np.add.at(da, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), -1.0)
    return float((z - score).mean()), (de / n).astype(e.dtype), (da / n).astype(a.dtype)


def viterbi(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Best tags [time, row]."""
    steps, n, _ = e.shape
    best, back = e[0], np.empty(e.shape, np.int8)
    for t in range(1, steps):
        s = best[:, :, None] + a
        back[t] = s.argmax(axis=1)
        best = s.max(axis=1) + e[t]
    out = np.empty((steps, n), np.int64)
    out[-1] = best.argmax(axis=1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t][rows, out[t]]
    return out


class Tagger:
    def __init__(self, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)

        def start(*shape):
            return (r.standard_normal(shape) * 0.3).astype(np.float32)

        self.w = {"xf": start(N_SYMBOLS, 4 * hidden), "hf": start(hidden, 4 * hidden), "xb": start(N_SYMBOLS, 4 * hidden),
                  "hb": start(hidden, 4 * hidden), "out": start(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "a": start(TAGS, TAGS)}
        for x in ("xf", "xb"):
            self.w[x][:, hidden:2 * hidden] += 1.0  # remember, at first

    def states(self, ids: np.ndarray):
        w = self.w
        f, kf = lstm(w["xf"][ids], w["hf"])
        b, kb = lstm(w["xb"][ids[::-1]], w["hb"])
        return np.concatenate([f, b[::-1]], axis=2), kf, kb

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.states(ids)[0] @ self.w["out"] + self.w["bias"]

    def gradients(self, ids: np.ndarray, gold: np.ndarray):
        w = self.w
        hs, kf, kb = self.states(ids)
        loss, de, da = crf(hs @ w["out"] + w["bias"], w["a"], gold)
        size = w["hf"].shape[0]
        dhs = de @ w["out"].T
        dxf, dhf = lstm_back(dhs[:, :, :size], kf, w["hf"])
        dxb, dhb = lstm_back(dhs[::-1, :, size:], kb, w["hb"])
        g = {"hf": dhf, "hb": dhb, "out": np.einsum("tnh,tnk->hk", hs, de), "bias": de.sum(axis=(0, 1)), "a": da}
        for name, d, i in (("xf", dxf, ids), ("xb", dxb, ids[::-1])):
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], i.reshape(-1), d.reshape(-1, d.shape[2]))
        return loss, g

    def fit(self, ids: np.ndarray, gold: np.ndarray, steps: int = 640, rows: int = 64, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over random batches. ids, gold: [row, time]."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses = []
        for t in range(1, steps + 1):
            pick = r.integers(0, len(ids), min(rows, len(ids)))
            loss, g = self.gradients(ids[pick].T, gold[pick].T)
            losses.append(loss)
            pace = rate * min(1.0, 2.0 * (1 - t / (steps + 1)))
            for k, d in g.items():
                d = np.clip(d, -1.0, 1.0)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                self.w[k] = (self.w[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return losses


# --- windows -----------------------------------------------------------------------------

WIDE, STRIDE, MARGIN = 64, 32, 40
ANCHOR = re.compile(r"[0-9@]++|(?<=[\[(\x20])at(?=[\])\x20]{1,2}[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9]|\x20?[\[(.\x20](?:dot|[.\x20])))")


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, at signs and written ones."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(a: int, b: int) -> list[int]:
    """Starts of windows that cover a stretch, overlapping by half."""
    return list(range(a, max(a + 1, b - WIDE + STRIDE), STRIDE))


def tags(text_length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(text_length, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        out[s] = 1 + 2 * k
        out[s + 1:e] = 2 + 2 * k
    return out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _letters(r: random.Random, least: int, most: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(least, most)))


def made_email(r: random.Random, varied: bool) -> str:
    local = r.choice(("", _letters(r, 1, 8) + r.choice("._-+"))) + _letters(r, 2, 9) + r.choice(("", "", _digits(r, r.randint(1, 3))))
    host = [_letters(r, 2, 10) for _ in range(r.choice((1, 1, 2)))] + [r.choice(("com", "org", "net", "de", "fr", "es", "edu", "io"))]
    if not varied:
        return f"{local}@{'.'.join(host)}"
    at, dot = r.choice(((" at ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."),
                        (" @ ", " . "), ("@", " . "), ("@", "[.]"), ("@", " dot "), ("[at]", "[dot]"), (" at ", " dot ")))
    return local + at + dot.join(host)


def made_ip(r: random.Random, varied: bool) -> str:
    dot = r.choice((" . ", "[.]", " .", ". ", "(.)", ":", "_", " dot ")) if varied else "."
    return dot.join(str(r.randint(0, 255)) for _ in range(4))


def made_card(r: random.Random, varied: bool) -> str:
    first = _digits(r, r.choice((15, 15, 15, 14, 13, 12)))
    digits = next(first + d for d in "0123456789" if luhn(first + d))
    by = r.choice((".", "_", "/", "  ", " - ", ":", "\n", ",")) if varied else r.choice(("", " ", "-"))
    return by.join(digits[i:i + 4] for i in range(0, len(digits), 4))


def made_phone(r: random.Random, varied: bool) -> str:
    a, b, c, land = str(r.randint(200, 999)), _digits(r, 3), _digits(r, 4), r.choice(("1", str(r.randint(2, 99))))
    if not varied:
        return r.choice((f"+{land} ({a}) {b}-{c}", f"+{land} {a} {b} {c}", f"+{land}-{a}-{b}-{c}", f"+{land}{a}{b}{c}", f"+{land}.{a}.{b}.{c}"))
    return r.choice((f"{land} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{land} {a} {b} {c}", f"0{a} {b}{c}", f"{a} {b} {c}",
                     f"({a}){b}-{c}", f"+{land}/{a}/{b}{c}", f"0{a}/{b}{c}", f"{land}-{a}-{b}-{c}", f"({a}) {b} {c}"))


def made_other(r: random.Random) -> str:
    """Numbers and words that look alike and are no personal data."""
    y, m, d = r.randint(1900, 2039), r.randint(1, 12), r.randint(1, 28)
    n = [r.randint(0, 9) for _ in range(4)]
    return r.choice((
        f"{y}-{m:02d}-{d:02d}", f"{d}.{m}.{y}", f"{m}/{d}/{y} {r.randint(0, 23)}:{r.randint(10, 59)}", f"{n[0]}.{n[1]}", f"v{n[0]}.{n[1]}.{n[2]}",
        f"version {n[0]}.{n[1]}.{n[2]}", f"{r.randint(1, 999)},{_digits(r, 3)},{_digits(r, 3)}.{_digits(r, 2)}", f"${r.randint(1, 99999)}.{_digits(r, 2)}",
        _digits(r, r.randint(1, 8)), _digits(r, r.randint(9, 22)), f"{_letters(r, 1, 3)}-{_digits(r, 6)}", f"{r.randint(1, 99)}%", f"[{r.randint(1, 99)}]",
        "".join(r.choice("0123456789abcdef") for _ in range(r.randint(12, 40))), f"{r.randint(1, 400)}-{r.randint(400, 900)}", f"0.{_digits(r, r.randint(3, 12))}",
        f"{y}-{y + 1}", f"@{_letters(r, 3, 9)}", f"{_letters(r, 3, 8)} at {_letters(r, 3, 8)}. {_letters(r, 3, 6)}", f"{n[0]} @ {n[1]}.{n[2]}",
        f"{n[0]}, {n[1]}, {n[2]}, {r.randint(10, 99)}, {n[3]}", f"at {_letters(r, 4, 9)} {_letters(r, 2, 6)} . {_letters(r, 2, 5)}", f"{_digits(r, 4)} {_digits(r, 4)}"))


MAKERS = {"email": made_email, "ip": made_ip, "card": made_card, "phone": made_phone}


def planted(text: str, r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A stretch of the text with one value at a blank: a kind in plain or varied writing, or something else."""
    kind = r.choice((*KINDS, *KINDS, None, None))
    value = made_other(r) if kind is None else MAKERS[kind](r, r.random() < 0.7)
    at = r.randint(0, len(text))
    at = max(text.find(" ", at), 0)
    before, after = text[max(0, at - WIDE):at], text[at + 1:at + 1 + 2 * WIDE]
    lead, trail = r.choice((" ", " ", " ", "\n", ": ", " (", "=")), r.choice((" ", " ", " ", ". ", ", ", "\n", ") ", ";", "!! ", "### "))
    out = before + lead + value + trail + after
    start = len(before) + len(lead)
    spans = [] if kind is None else [(kind, start, start + len(value))]
    return out, spans + [b for b in base_spans(out) if not any(x < b[2] and b[1] < y for _, x, y in spans) and kind is not None]


def examples(text: str, most_of_text: int = 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows and their gold tags: of the text as it is, and of stretches with a planted value. Depends on the text only."""
    if not text.strip():
        return []
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    ids, gold = symbols(text), tags(len(text), base_spans(text))
    starts = [s for a, b in regions(text) for s in windows(a, b)]
    out = []
    for s in r.sample(starts, min(len(starts), max(1, most_of_text // 3))):
        pad = max(0, s + WIDE - len(text))
        out.append((np.pad(ids[s:s + WIDE], (0, pad)), np.pad(gold[s:s + WIDE], (0, pad))))
    while len(out) < most_of_text:
        t, own = planted(text, r)
        ids, gold = symbols(t), tags(len(t), own)
        held = own[0] if own else (None, WIDE // 2, WIDE)
        s = max(0, min(held[1] - r.randint(0, WIDE - 12), len(t) - WIDE))
        pad = max(0, s + WIDE - len(t))
        out.append((np.pad(ids[s:s + WIDE], (0, pad)), np.pad(gold[s:s + WIDE], (0, pad))))
    return out


def valid(kind: str, value: str) -> bool:
    """Whether the numbers in it can be of the kind, however they are written."""
    digits = NO_DIGIT.sub("", value)
    if kind == "email":
        return "@" in value or re.search(r"\bat\b", value) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def added_spans(batch: list[str], base: list[list[tuple[str, int, int]]], tagger: Tagger, sure: float = 0.8) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds besides the base spans of each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in batch]
    places, ids = [], []
    for i, text in enumerate(batch):
        if not ANCHOR.search(text):
            continue
        own = symbols(text)
        for a, b in regions(text):
            for s in windows(a, b):
                part = own[s:s + WIDE]
                places.append((i, a, b, s))
                ids.append(np.pad(part, (0, WIDE - len(part))))
    if not ids:
        return out
    found, sureness = [], []
    for at in range(0, len(ids), 512):
        e = tagger.emissions(np.array(ids[at:at + 512]).T)
        found.append(viterbi(e, tagger.w["a"]).T)
        alpha, beta, z = forward_backward(e, tagger.w["a"])
        p = np.exp(alpha + beta - z[None, :, None])
        sureness.append(np.stack([p[:, :, 0], *[p[:, :, 1 + 2 * k] + p[:, :, 2 + 2 * k] for k in range(len(KINDS))]], axis=2).transpose(1, 0, 2))
    found, sureness = np.concatenate(found), np.concatenate(sureness)
    middle = np.minimum(np.arange(WIDE), np.arange(WIDE)[::-1])
    at = 0
    while at < len(places):
        i, a, b, _ = places[at]
        tag, best, p = np.zeros(b - a, np.int64), np.full(b - a, -1), np.zeros((b - a, 1 + len(KINDS)))
        while at < len(places) and places[at][:3] == (i, a, b):
            s = places[at][3]
            n = min(WIDE, b - s)
            here = slice(s - a, s - a + n)
            better = middle[:n] > best[here]
            tag[here] = np.where(better, found[at][:n], tag[here])
            p[here] = np.where(better[:, None], sureness[at][:n], p[here])
            best[here] = np.where(better, middle[:n], best[here])
            at += 1
        s = 0
        while s < len(tag):
            k = (tag[s] - 1) // 2
            if tag[s] == 0:
                s += 1
                continue
            e = s + 1
            while e < len(tag) and tag[e] == 2 + 2 * k:
                e += 1
            value = batch[i][a + s:a + e]
            start, end = a + s + len(value) - len(value.lstrip()), a + s + len(value.rstrip())
            if p[s:e, 1 + k].mean() >= sure and valid(KINDS[k], batch[i][start:end]) and not any(x < end and start < y for _, x, y in base[i]):
                out[i].append((KINDS[k], start, end))
            s = e
    return out


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = 2_000, most_windows: int = 12_000) -> Tagger:
    """Train on windows of a sample that depends on ``key`` and the texts only."""
    share = min(1 << 20, int(sample_docs / max(1, docs.count()) * (1 << 20)) + 1)
    sample = docs.select(F.col(text).alias("text"), spread_key(key).alias("at")).where(F.col("at") < share)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(at, ids.astype(np.int8).tobytes(), gold.astype(np.int8).tobytes())
                    for at, t in zip(batch.column("at").to_pylist(), texts(batch, "text")) for ids, gold in examples(t)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.binary(), pa.binary()))],
                                              ["at", "ids", "gold"])

        return step

    found = map_batches(sample, make, "at bigint, ids binary, gold binary").orderBy(F.xxhash64("at", "ids"), "at", "ids", "gold").limit(most_windows).toArrow()
    tagger = Tagger()
    if found.num_rows:
        ids, gold = (np.array([np.frombuffer(x, np.int8) for x in found.column(c).to_pylist()], np.int64) for c in ("ids", "gold"))
        if gold.any():
            tagger.fit(ids, gold)
            return tagger
    tagger.w["bias"][0] = 100.0  # nothing to learn from: everything is outside
    return tagger


SPAN = "array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(df: DataFrame, tagger: Tagger, text: str = "text", out: str = "personal") -> DataFrame:
    """``df`` plus the array ``out`` of spans, by kind as listed, then start; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept)
    schema = StructType(source.schema.fields + StructType.fromDDL(f"`{out}` {SPAN}").fields)
    sent = df.sparkSession.sparkContext.broadcast(tagger)

    def make():
        own = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ts = texts(batch, text)
            base = [base_spans(t) for t in ts]
            rows = []
            for b, a in zip(base, added_spans(ts, base, own)):
                spans = [(k, s, e, True) for k, s, e in b] + [(k, s, e, False) for k, s, e in a]
                spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                rows.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
            return pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(rows, _SPAN)], [*kept, out])

        return step

    return map_batches(source, make, schema)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    base = F.filter("personal", lambda s: s["base"])

    def joined(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *[F.size(F.filter(base, _is(k))).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("personal")).alias("spans"),
        F.size(F.filter("personal", lambda s: ~s["base"])).cast("bigint").alias("n_added"))


def _is(kind: str):
    return lambda s: s["kind"] == kind
