"""Secret scans: fixed patterns, and the guess cost of values in credential contexts.

The base patterns find assignments, access keys and hex strings. Besides, every value that follows a
credential word is split, by dynamic programming, into the cheapest sequence of dictionary words, dates,
repeats, keyboard walks and brute-force characters; words count also with some letters swapped for
digits or symbols (``p@ssw0rd``). The cost is the logarithm (base 2) of the guesses an
attacker needs. ``password is required`` costs little and is left alone; a value of ``least_bits`` or
more that base values don't cover wholly is added with the kind ``guess``. The dictionary is a public vocabulary,
a word's cost its rank. References (``${NAME}``, ``<your-password>``, ``os.environ[...]``) and mail addresses
are no values, of a web address the dearest part counts. A quoted value with blanks in it is not read.

Every text is scanned whole, in time linear in its length. Null and empty texts have no spans; repeated
rows get equal results. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from wellspan.llm.common import map_batches, table, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs: a shorter run can't hold a match
BLANKS = r"\x00-\x20\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # and control characters
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|login|bearer)"""
    r"""["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+(?:is|was)\x20+|(?<=bearer)\x20+)["'`]?"""
    rf"""([^{BLANKS}]{{6,}})""", re.I | re.A)
# the value that a quote opens ends at the same quote, unless letters or digits go on behind it
CLOSED = {q: re.compile(rf"((?:[^\\{q}]|\\.)*+){q}(?![^\W_])", re.S) for q in "\"'`"}
# references to a value kept elsewhere: variables, calls that look one up, fields to fill in
ELSEWHERE = re.compile(
    r"""\$\{[A-Za-z_][\w.:-]*\}?|\$\(\S*|\{\{\S*|<[A-Za-z]+(?:[_.-][A-Za-z]+)*>?|(?:os\.environ|os\.getenv|process\.env|getenv|env)\b[\w.\[\]()"']*""", re.A)
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")
PART = re.compile(r"[^\W_]+")
# lower-case words one of which stands in every match of ASSIGN or CONTEXT
HINTS = ("passw", "secret", "token", "key", "pass", "pwd", "credential", "login", "bearer")
KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 6, "access": 20}

# fixed values: rows of a keyboard
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LONGEST_WORD = 16
# fixed values: characters written for letters; words of at least LEAST_SWAPPED letters are looked up through them
SWAPPED = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
LEAST_SWAPPED = 5
YEAR, MONTH, DAY = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
DATES = tuple(re.compile(p) for p in (f"{YEAR}[-/.]?{MONTH}[-/.]?{DAY}", f"{DAY}[-/.]?{MONTH}[-/.]?{YEAR}", YEAR))


def _near() -> set[tuple[str, str]]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


NEAR = _near()


def brute_bits(value: str) -> float:
    """Cost of one character of ``value``: an attacker tries the whole alphabet that the value draws from."""
    size, blocks = 0, set()
    for c in set(value):
        if c >= "\x80":
            blocks.add(ord(c) >> 6)  # other scripts count by blocks of 64 code points
        else:
            blocks.add("digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "symbol")
    for b in blocks:
        size += {"digit": 10, "lower": 26, "upper": 26, "symbol": 33}.get(b, 64)
    return math.log2(size) if size else 0.0


def read_dictionary(path: str, shortest: int = 3) -> dict[str, float]:
    """Words of a rank file and the logarithm of their place."""
    import base64

    words: dict[str, float] = {}
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace").strip().lower()
            if shortest <= len(token) <= LONGEST_WORD and token.isascii() and token.isalpha() and token not in words:
                words[token] = math.log2(len(words) + 2)
    return words


def _run_lengths(s: str, step: int, same) -> list[int]:
    """At i: how many times in a row ``same(s[k], s[k + step])`` holds from k = i on."""
    out = [0] * (len(s) + 1)
    for i in range(len(s) - step - 1, -1, -1):
        out[i] = out[i + 1] + 1 if same(s[i], s[i + step]) else 0
    return out


def guess_bits(value: str, words: dict[str, float]) -> float:
    """Cost in bits of the cheapest segmentation of ``value``.

    Repeats and walks go as far to the right as they can; all else may start and end anywhere.
    """
    s, n = value.lower(), len(value)
    if len(s) != n:
        s = value
    best = [math.inf] * (n + 1)
    best[0] = 0.0
    repeats = {u: _run_lengths(s, u, lambda a, b: a == b) for u in (1, 2, 3, 4)}
    walks = _run_lengths(s, 1, lambda a, b: (a, b) in NEAR or ord(b) - ord(a) in (1, -1) and a.isalnum() and b.isalnum())
    brute = brute_bits(value)
    swapped = s.translate(SWAPPED)
    swaps = list(itertools.accumulate((a != b for a, b in zip(s, swapped)), initial=0))
    for i in range(n):
        here = best[i]
        if here + brute < best[i + 1]:
            best[i + 1] = here + brute
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            w = words.get(s[i:j])
            if w is not None:
                cost = here + 1 + w + (value[i:j] != s[i:j])
                if cost < best[j]:
                    best[j] = cost
            elif j - i >= LEAST_SWAPPED and swaps[j] > swaps[i] and (w := words.get(swapped[i:j])) is not None:
                cost = here + 1 + w + (value[i:j] != s[i:j]) + 1 + swaps[j] - swaps[i]
                if cost < best[j]:
                    best[j] = cost
        for u, runs in repeats.items():
            times = runs[i] // u + 1
            if runs[i] and times >= (3 if u == 1 else 2):
                j = i + times * u
                cost = here + 1 + u * brute + math.log2(times)
                if cost < best[j]:
                    best[j] = cost
        if walks[i] >= 2:
            j = i + walks[i] + 1
            cost = here + 1 + math.log2(47) + 0.5 * walks[i]
            if cost < best[j]:
                best[j] = cost
        if value[i] in "0123":
            for pattern in DATES:
                if m := pattern.match(value, i):
                    j = m.end()
                    cost = here + 1 + math.log2(200 * (366 if j - i > 4 else 1))
                    if cost < best[j]:
                        best[j] = cost
    return best[n]


def value_bits(value: str, words: dict[str, float]) -> float:
    """Cost of a context value: nothing for mail addresses and for references to a value kept elsewhere;
    of a web address the dearest run of letters and digits, since a token may be part of it."""
    if ELSEWHERE.fullmatch(value) or MAIL.fullmatch(value):
        return 0.0
    if ADDRESS.match(value):
        return max((guess_bits(p, words) for p in PART.findall(value)), default=0.0)
    return guess_bits(value, words)


def scan(text: str, words: dict[str, float], least_bits: float) -> list[tuple[str, int, int, int, float]]:
    """(kind, start, end, start of the value, bits or -1) of all spans, by start, then kind."""
    out = []
    hinted = any(h in low for h in HINTS) if (low := text.lower()) else False
    if hinted:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                out.append(("assign", m.start(), m.end(), m.start(2), guess_bits(m[2], words)))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start(), -1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", m.start(), m.end(), m.start(), -1.0) for m in HEX.finditer(text)]
    if hinted:
        taken = {k: [(v, e) for kind, _, e, v, _ in out if kind == k] for k in KINDS}
        for m in CONTEXT.finditer(text):
            start, value = m.start(1), _unquoted(text[m.start(1) - 1], m[1]).rstrip("\"'`.,;:!?)]}>")
            end = start + len(value)
            if len(value) >= LEAST["assign"] and not _covered(taken, start, end):
                bits = value_bits(value, words)
                if bits >= least_bits:
                    out.append(("guess", start, end, start, bits))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return out


def _unquoted(before: str, value: str) -> str:
    """A value that a quote opens goes up to the same quote, unless letters or digits follow that; else it is whole."""
    closed = CLOSED[before].match(value) if before in CLOSED else None
    return closed[1] if closed else value


def _covered(taken: dict[str, list[tuple[int, int]]], start: int, end: int) -> bool:
    """Whether the values of spans cover it wholly; those of one kind are in order and don't overlap each other."""
    at = -1
    while at < start < end:
        at = start
        for spans in taken.values():
            i = bisect.bisect_right(spans, (start, 1 << 62))
            if i and spans[i - 1][1] > start:
                start = spans[i - 1][1]
    return start >= end


SPAN = "array<struct<kind: string, start: bigint, end: bigint, value_start: bigint, bits: double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("bits", pa.float64())]))
_NAMES = ("kind", "start", "end", "value_start", "bits")


def find(df: DataFrame, dictionary: dict[str, float], text: str = "text", out: str = "secrets",
         least_bits: float = 30.0, redacted: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """``df`` plus the array ``out`` of spans; with ``redacted`` also the text whose values are masked."""
    added = [out, *([redacted] if redacted else [])]
    kept = [c for c in df.columns if c not in added or c == text]
    source = df.select(*kept)
    fields = StructType.fromDDL(f"`{out}` {SPAN}" + (f", `{redacted}` string" if redacted and redacted != text else "")).fields
    schema = StructType(source.schema.fields + fields)
    sent = df.sparkSession.sparkContext.broadcast(dictionary)  # the vocabulary's words

    def make():
        words = sent.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scan(t, words, least_bits) for t in texts(batch, text)]
            columns = {c: batch.column(c) for c in kept}
            columns[out] = pa.array([[dict(zip(_NAMES, s)) for s in spans] for spans in found], _SPAN)
            if redacted:
                columns[redacted] = pa.array([t if t is None else redact(t, spans, mask) for t, spans in
                                              zip(batch.column(text).to_pylist(), found)], pa.string())
            return pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema.names)

        return step

    return map_batches(source, make, schema)


def redact(text: str, spans: list[tuple], mask: str) -> str:
    """The text with all secret values replaced; overlapping values become one mask."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, end in sorted((s[3], s[2]) for s in spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = read_dictionary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), words)

    def n(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[n(k) for k in KINDS],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "guess")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"))
