"""Secret scanning: fixed patterns, and a battery of randomness tests on other strings.

The battery looks at strings of 20 and more characters of the base64 alphabets that no
pattern has taken. The smallest known alphabet with all their characters is inferred;
over its symbol numbers run a chi-squared test of uniformity (by its exact distribution up
to ``EXACT`` characters), a runs test about the middle and a lag-1 serial correlation test.
A string is a candidate secret if none of the three, Bonferroni-combined, speaks against
randomness. Since short strings pass such tests easily, each also gets a p-value against
the hypothesis that it is ordinary structured text: the ratio of its likelihoods as text
and as uniform symbols, which needs no approximation at any length, and for decimal and hex
strings the exact tail of the number of coincidences (pairs of equal symbols) as well.

Benjamini-Hochberg then bounds the rate of false discoveries over the whole table, apart
for each length stratum: candidates are counted by stratum and p-value, and those up to the
stratum's threshold are reported. ``scan_table`` reads texts once and writes the candidates
in between; ``redact`` reads them twice, as it would have to write the texts. Detection by length and encoding is in the
README.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import keyed_text, map_batches, pieces, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
WORDS = ("passw", "secret", "token", "api")

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
#: Encodings from the smallest alphabet up.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": DIGITS + LOWER + UPPER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
NUMBERS = {name: {c: i for i, c in enumerate(chars)} for name, chars in ENCODINGS.items()}
STRATA = (20, 32, 48, 64, 128)
#: p-values are counted on a grid of this many steps for each factor of e, down to e to the minus ``FLOOR``.
STEPS_PER_E, FLOOR = 16, 100
EXACT = 96
#: Share of false ones among the strings that the battery reports.
RATE = 0.005
#: Arrow forms of what a scan of a text finds.
BASE_SPANS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "kind", "stop")]))
TRIED = pa.list_(pa.struct([(name, pa.int64()) for name in ("stratum", "step", "start", "stop")]))

#: Share of each letter in text, in per mille: the mean of English, German, French and Spanish.
LETTERS = dict(zip(LOWER, (87, 14, 33, 45, 142, 14, 19, 31, 71, 4, 6, 45, 28, 76, 61, 19, 6, 66, 74, 68, 40, 12, 11, 2, 8, 5), strict=True))
SYMBOLS = {c: math.log(LETTERS[c.lower()] / sum(LETTERS.values())) for c in LOWER + UPPER} | dict.fromkeys(DIGITS, math.log(0.1)) | dict.fromkeys("+/-_", math.log(0.25))
#: Log-share of the kind of the next character in words, names and numbers, by that of the last.
STEPS = {
    last: dict(zip(("lower", "upper", "digit", "mark"), map(math.log, shares), strict=True))
    for last, shares in {
        "start": (0.50, 0.30, 0.15, 0.05),
        "lower": (0.84, 0.06, 0.04, 0.06),
        "upper": (0.44, 0.44, 0.05, 0.07),
        "digit": (0.08, 0.07, 0.75, 0.10),
        "mark": (0.45, 0.30, 0.20, 0.05),
    }.items()
}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, leftmost and without overlaps within a kind.

    Matches are taken first and dropped afterwards when too short, so a short one still
    uses up its characters. For hex and access a minimal length in the pattern is the
    same thing, as their matches run to the end of a run of one character class.
    """
    found = []
    folded = text.lower()
    if any(w in folded for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def infer_encoding(token: str) -> str:
    used = set(token)
    return next(name for name, chars in ENCODINGS.items() if used <= set(chars))


def upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(counts: list[int], size: int) -> float:
    """P(uniform symbols are at least this uneven): exact up to ``EXACT`` symbols, above by the cube-root normal approximation.

    With the number of symbols given, chi-squared is the number of coincidences on another scale.
    """
    n, df = sum(counts), size - 1
    if n <= EXACT:
        tails, pairs = uniform_tails(n, size), sum(c * (c - 1) for c in counts) // 2
        return float(1 - tails[pairs - 1]) if 0 < pairs <= len(tails) else 1.0 if not pairs else 0.0
    x = sum(c * c for c in counts) * size / n - n
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return upper_tail(z)


def runs_p(values: list[int], size: int) -> float:
    """Two-sided: too few or too many runs above and below the middle of the alphabet."""
    high = [2 * v >= size for v in values]
    a = sum(high)
    b = len(high) - a
    n = a + b
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 2 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return min(1.0, 2 * upper_tail(abs(runs - mean) / math.sqrt(variance))) if variance > 0 else 1.0


def serial_p(values: list[int]) -> float:
    """Two-sided: lag-1 correlation of the symbol numbers."""
    n = len(values)
    mean = sum(values) / n
    centred = [v - mean for v in values]
    spread = sum(c * c for c in centred)
    if not spread:
        return 0.0
    r = sum(x * y for x, y in zip(centred, centred[1:], strict=False)) / spread
    return min(1.0, 2 * upper_tail(abs(r + 1 / n) * math.sqrt(n)))


def kind_of(c: str) -> str:
    return "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "mark"


def text_log(token: str) -> float:
    """Log-probability of the string as words, names, numbers and the marks between them, in either case."""
    best = -math.inf
    for form in (token, token.swapcase()):
        total, last = 0.0, "start"
        for c in form:
            kind = kind_of(c)
            total += STEPS[last][kind] + SYMBOLS[c]
            last = kind
        best = max(best, total)
    return best


def skewed_log(counts: list[int], size: int, prior: float = 0.3) -> float:
    """Log-probability under symbol rates that are unknown and uneven (a Dirichlet prior)."""
    n, whole = sum(counts), prior * size
    return math.lgamma(whole) - math.lgamma(whole + n) + sum(math.lgamma(prior + c) - math.lgamma(prior) for c in counts)


def pair_ways(n: int, size: int, top: int, weight: list[float]) -> np.ndarray:
    """Weighted ways to give ``n`` symbols to ``size`` values, by the number of pairs of equal symbols up to ``top``."""
    ways = np.zeros((n + 1, top + 1))
    ways[0, 0] = 1
    for _ in range(size):
        more = ways.copy()
        for c in range(1, n + 1):
            pairs = c * (c - 1) // 2
            if pairs > top:
                break
            more[c:, pairs:] += weight[c] * ways[: n + 1 - c, : top + 1 - pairs]
        ways = more
    return ways[n]


@lru_cache(maxsize=4096)
def coincidence_tails(n: int, size: int, prior: float = 0.3) -> np.ndarray:
    """P(at most k pairs of equal symbols among n) under the same uneven rates, exact.

    Up to 1.5 times the pairs and n / 2 more than uniform symbols have on average; strings
    with more never pass the chi-squared test.
    """
    weight = [1.0]
    for c in range(1, n + 1):
        weight.append(weight[-1] * (prior + c - 1) / c)
    whole = prior * size
    log_all = math.lgamma(whole + n) - math.lgamma(whole) - math.lgamma(n + 1)
    return np.cumsum(pair_ways(n, size, int(0.75 * n * (n - 1) / size + n / 2) + 1, weight)) * math.exp(-log_all)


@lru_cache(maxsize=4096)
def uniform_tails(n: int, size: int) -> np.ndarray:
    """P(at most k pairs of equal symbols among n uniform ones), exact, as far up as ``coincidence_tails``."""
    weight = [math.exp(-math.lgamma(c + 1)) for c in range(n + 1)]
    log_all = n * math.log(size) - math.lgamma(n + 1)
    return np.cumsum(pair_ways(n, size, int(0.75 * n * (n - 1) / size + n / 2) + 1, weight)) * math.exp(-log_all)


def structured_p(token: str, name: str, counts: list[int]) -> float:
    """p-value of the string as structured text of its encoding.

    Every string may be text: its likelihood as text over that as uniform symbols, shared
    among the encodings, as the encoding is inferred from the string. Text has a ratio
    below p with a probability of at most p, at any length. Of the alphabets that spell no
    words (decimal and hex) it may also be uneven symbols: up to 128 characters by the
    exact tail of the number of coincidences, above by the ratio. The larger p counts.
    """
    n, size = sum(counts), len(ENCODINGS[name])
    uniform = -n * math.log(size) - math.log(len(ENCODINGS))
    p = math.exp(min(0.0, text_log(token) - uniform))
    if size > 16:
        return p
    if n > 128:
        return max(p, math.exp(min(0.0, skewed_log(counts, size) - uniform)))
    tails, pairs = coincidence_tails(n, size), sum(c * (c - 1) for c in counts) // 2
    return max(p, float(tails[pairs]) if pairs < len(tails) else 1.0)


def battery(token: str) -> tuple[float, float]:
    """(p under randomness, Bonferroni-combined; p under structure) of a string."""
    name = infer_encoding(token)
    number, size = NUMBERS[name], len(ENCODINGS[name])
    values = [number[c] for c in token]
    counts = list(Counter(values).values())
    random = min(1.0, 3 * min(chi_squared_p(counts, size), runs_p(values, size), serial_p(values)))
    return random, structured_p(token, name, counts)


def step_of(p: float) -> int:
    """The place of a p-value on the grid, rounded up to the next larger one."""
    return min(int(-math.log(p) * STEPS_PER_E), FLOOR * STEPS_PER_E) if p > 0 else FLOOR * STEPS_PER_E


def discoveries(counts: dict[int, int], rate: float) -> int:
    """The Benjamini-Hochberg threshold of p-values counted by step: the least step that is a discovery.

    A step stands for its largest p-value, so the rate is kept.
    """
    total, held, least = sum(counts.values()), 0, FLOOR * STEPS_PER_E + 1
    for step in sorted(counts, reverse=True):
        held += counts[step]
        if math.exp(-step / STEPS_PER_E) <= rate * held / total:
            least = step
    return least


def candidates(text: str, taken: list[tuple[int, int, str]], alpha: float = 0.01) -> list[tuple[int, int, int, int]]:
    """(length stratum, step, start, end) of the strings outside ``taken`` spans that pass for random."""
    merged: list[list[int]] = []
    for start, end, _ in sorted(taken):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    begins, found = [m[0] for m in merged], []
    for m in LONG.finditer(text):
        start, end = m.span()
        before = bisect_left(begins, end) - 1
        if before >= 0 and merged[before][1] > start:
            continue
        random, structured = battery(m.group())
        if random >= alpha:
            found.append((sum(end - start >= x for x in STRATA), step_of(structured), start, end))
    return found


def thresholds(counted: Iterable[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """The threshold of each length stratum, from (stratum, step, number of candidates)."""
    strata: dict[int, dict[int, int]] = {}
    for stratum, step, n in counted:
        strata.setdefault(stratum, {})[step] = n
    return {stratum: discoveries(counts, rate) for stratum, counts in strata.items()}


def scan(text: str, limits: dict[int, int] | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start, then kind as listed; without limits the text is its own table."""
    order = lambda span: (span[0], KINDS.index(span[2]))
    base = sorted(base_spans(text), key=order)
    tried = candidates(text, base)
    if limits is None:
        limits = thresholds(((s, k, n) for (s, k), n in Counter((s, k) for s, k, _, _ in tried).items()), RATE)
    found = [(start, end, "random") for stratum, step, start, end in tried if step >= limits[stratum]]
    return base, sorted(base + found, key=order)


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each maximal run of spans replaced by ``[SECRET]``."""

    def merge(merged: list[list[int]], span: tuple[int, int, str]) -> list[list[int]]:
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span[1])
        else:
            merged.append([span[0], span[1]])
        return merged

    out, at = [], 0
    for start, end in reduce(merge, sorted(spans), []):
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


def limits_of(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[int, int]:
    """The thresholds over all texts of a table; the driver gets a count for each stratum and step at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in pieces(batch):
                for text in part.column(0).to_pylist():
                    if text:
                        counts.update((s, k) for s, k, _, _ in candidates(text, base_spans(text)))
        rows = [(s, k, n) for (s, k), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["stratum", "step", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "stratum long, step long, n long")
    return thresholds(((r[0], r[1], r[2]) for r in counted.groupBy("stratum", "step").agg(F.sum("n")).collect()), rate)


def scan_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row.

    A null or empty text has no spans. Offsets count code points, ends are exclusive.
    Repeated rows and null ids stay; other columns are left out. Texts are scanned whole
    and once: base spans and the battery's candidates of each row are written to the shared
    folder, the thresholds counted there and the candidates held against them.
    """

    def build():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, tried = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) if text else []
                base.append([(start, KINDS.index(kind), stop) for start, stop, kind in spans])
                tried.append(candidates(text, spans) if text else [])
            arrays = [pa.array(base, BASE_SPANS), pa.array(tried, TRIED)]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "base", "tried"])

        return convert

    kind = docs.schema[id_col].dataType.simpleString()
    found = written(
        map_batches(keyed_text(docs, id_col, text_col), build, f"doc_id {kind}, base array<struct<start: long, kind: long, stop: long>>, tried array<struct<stratum: long, step: long, start: long, stop: long>>"),
        "secrets",
    )
    each = found.select(F.explode("tried").alias("c")).groupBy("c.stratum", "c.step").count()
    limits = thresholds(((r[0], r[1], r[2]) for r in each.collect()), RATE)
    passing = F.create_map(*[F.lit(x).cast("long") for pair in limits.items() for x in pair]) if limits else None
    random = F.filter("tried", lambda c: c.step >= passing[c.stratum]) if limits else F.filter("tried", lambda c: F.lit(False))
    spans = F.transform(random, lambda c: F.struct(c.start.alias("start"), F.lit(KINDS.index("random")).cast("long").alias("kind"), c.stop.alias("stop")))
    names = F.array(*map(F.lit, KINDS))

    def count_of(kind: int):
        # a lambda of two parameters would be given the place in the array as the second
        return F.size(F.filter("base", lambda x: x.kind == kind)).cast("long")

    def text_of(some):
        return F.array_join(F.transform(F.array_sort(some), lambda x: F.concat_ws(":", names[x.kind.cast("int")], x.start, x.stop)), ",")

    return found.select(
        "doc_id",
        *[count_of(i).alias(f"n_{name}") for i, name in enumerate(KINDS[:3])],
        F.size(random).cast("long").alias("n_random"),
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.concat("base", spans)).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows and columns with secrets replaced in the text, and its length brought up to date.

    Null and empty texts stay as they are. ``length_col`` is left alone if the table has no
    such column or the text has no secret. Texts are scanned twice: for the thresholds, and for
    the spans.
    """
    names = docs.columns
    has_length = length_col in names
    limits = limits_of(docs, text_col)

    def build():
        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(names.index(text_col)).to_pylist()
            lengths = batch.column(names.index(length_col)).to_pylist() if has_length else []
            for i, text in enumerate(texts):
                spans = scan(text, limits)[1] if text else []
                if spans:
                    texts[i] = redacted(text, spans)
                    if has_length:
                        lengths[i] = len(texts[i])
            columns = list(batch.columns)
            columns[names.index(text_col)] = pa.array(texts, pa.string())
            if has_length:
                at = names.index(length_col)
                columns[at] = pa.array(lengths, batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(columns, names)

        return convert

    return map_batches(docs, build, docs.schema)
