"""Secret scans: fixed patterns, and a password guess-cost estimate for credential values.

The estimate is the cheapest way to write a value as words, dates, repeats, keyboard walks
and brute-force stretches, by dynamic programming over its positions, in log10 guesses.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the three base kinds.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "guess")
#: Any name that speaks of a credential, then a value without blanks: what the estimate is asked about.
CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|auth(?:orization)?|credentials?|private[_-]?key|bearer)["']?\x20*[:=]\x20*(?:["']([^"'\s]{4,}+)["']|([^"'\s]{4,}+))""", re.A)
HINT = re.compile(r"pass|pwd|pin|secret|token|api|auth|credential|private|bearer")
#: A value that takes 10**8 guesses or more is reported.
LEAST_LOG10 = 8.0

# Frequent passwords and the words they are made of, most used first.
WORDS = """password qwerty admin welcome login letmein monkey dragon master sunshine princess football shadow secret
test user guest root default change love hello summer winter spring autumn michael jordan hunter killer pepper ginger
cookie cheese coffee orange banana flower purple silver golden diamond tiger eagle falcon soccer baseball hockey
computer internet server system access private public account money bank credit key token pass example sample demo
temp temporary foo bar baz one two three four five six seven eight nine ten the and for you your this that my new old
none null true false todo changeme redacted your_password""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("4301$5@7", "aeoissat")
# Rows of a keyboard; a key's neighbours are those beside it and, half a key over, in the next rows.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
OFFSET = (0.0, 1.5, 1.8, 2.3)
KEYS = {c: (x + OFFSET[y], y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_MONTH, _DAY, _YEAR = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:19|20)\d\d"
#: Each form of a date, looked for at every place: dates may overlap, or begin alike.
DATES = [re.compile(f"(?=({x}))") for x in (rf"{_YEAR}([-/._]?){_MONTH}\2{_DAY}", rf"{_DAY}([-/._]?){_MONTH}\2{_YEAR}", rf"{_DAY}([-/._]?){_MONTH}\2\d\d", _YEAR)]
LONGEST_DATE = 10


def _beside(a: str, b: str) -> bool:
    p, q = KEYS.get(a), KEYS.get(b)
    return p is not None and q is not None and a != b and abs(p[1] - q[1]) <= 1 and abs(p[0] - q[0]) <= 1.1


def _class_size(s: str) -> int:
    return max(1, 26 * any(c.islower() for c in s) + 26 * any(c.isupper() for c in s) + 10 * any(c.isdigit() for c in s) + 33 * any(not c.isalnum() for c in s))


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses the cheapest segmentation takes; 0 for an empty value.

    Where that is ``enough`` or more, the scan may stop early and give any number from ``enough`` up to it.

    ``cost[j]`` is the least over all segments ending at j. Of the walks that end there, of three keys and
    more, the best start is carried along, since each grows by the same cost a key. So are the starts of repeats,
    except those that an earlier one undercuts: its lead only grows. Brute force extends one character at a time.
    """
    n, low = len(value), value.lower()
    leet = low.translate(LEET)
    per_char = math.log10(_class_size(value))
    segment = math.log10(2)  # the choice of a further segment
    starts: dict[int, list[tuple[int, float]]] = {}
    for m in (m for date in DATES for m in date.finditer(low)):
        starts.setdefault(m.end(1), []).append((m.start(), math.log10(365 * 120 if m.end(1) - m.start() > 4 else 120)))
    cost, walk, same = [0.0] * (n + 1), 0, 0
    step, walked, repeats = 0.5 * math.log10(4), math.inf, []
    for j in range(1, n + 1):
        best = cost[j - 1] + per_char  # one brute-force character more
        for size in range(3, min(LONGEST_WORD, j) + 1):
            for form, extra in ((low, 0.0), (leet, 0.6)):
                rank = RANK.get(form[j - size : j])
                if rank:
                    upper = math.log10(2) if value[j - size : j] != low[j - size : j] else 0.0
                    best = min(best, cost[j - size] + segment + math.log10(rank + 1) + extra + upper)
        for start, c in starts.get(j, ()):
            best = min(best, cost[start] + segment + c)
        same = same + 1 if j > 1 and low[j - 1] == low[j - 2] else 1
        walk = walk + 1 if j > 1 and (_beside(low[j - 2], low[j - 1]) or ord(low[j - 1]) - ord(low[j - 2]) in (1, -1)) else 1
        if same >= 3:
            tried, repeats, least = [*repeats, j - 3] if same > 3 else [j - 3], [], math.inf
            for i in tried:
                c = cost[i] + math.log10(j - i)
                if c < least:
                    least = c
                    repeats.append(i)
            best = min(best, least + segment + per_char)
        if walk >= 3:
            walked = min(walked + step if walk > 3 else math.inf, cost[j - 3] + 2 * step)
            best = min(best, walked + segment + math.log10(47))
        cost[j] = best
        if j % 32 == 0 and best >= enough:
            # a segment over j begins in the walk or repeat that ends here, or not further back than a word or date is long
            least = min(cost[max(0, j - max(LONGEST_WORD, LONGEST_DATE, walk, same)) : j + 1])
            if least >= enough:
                return least
    return cost[n]


@lru_cache(maxsize=20_000)
def _cached(value: str, least: float) -> bool:
    return guess_cost(value, least) >= least


def _costly(value: str, least: float) -> bool:
    """Whether a value takes ``least`` or more; only short ones are remembered."""
    return _cached(value, least) if len(value) <= 128 else guess_cost(value, least) >= least


def find(text: str | None, least: float = LEAST_LOG10) -> list[tuple[int, int, int]]:
    """All spans as (start, end, kind), code points, end exclusive, by start and then kind; base kinds stay whatever the estimate says."""
    if not text:
        return []
    out = [(*m.span(), 1) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    low = text.lower()
    if HINT.search(low):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
        taken = {(a, b) for a, b, _ in out}
        ends = {b for _, b in taken}
        for m in CONTEXT.finditer(text):
            at = 1 if m[1] is not None else 2
            a, b = m.span(at)
            if b not in ends and (a, b) not in taken and _costly(m[at], least):
                out.append((a, b, 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST_LOG10) -> DataFrame:
    """``doc_id, found``: an array of (start, end, kind) of each whole text, one row a document.

    Null and empty texts find nothing; repeated rows each give a row; an empty table gives none.
    The text itself is read only. Values of any length are estimated, and their spans are whole.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for b in batches:
            found = [[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in find(t.as_py(), least)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, found array<struct<start:long,end:long,kind:string>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the base spans and all spans of ``scan``'s rows, in JVM expressions."""

    def listed(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    base = listed(F.filter("found", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count("guess").alias("n_guess"))
