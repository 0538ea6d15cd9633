"""Secret scans in DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. Beside them, every run of 20 or
more key characters is a candidate: its encoding is inferred from its characters, and tests ask
whether it could be uniform random text of that encoding: the chi-squared test of symbol counts, the
runs test above and below the middle of the alphabet, the lag-1 serial correlation, in alphabets
with all letters the share of letters that are common in prose, and in runs of letters alone the
change of vowels and consonants. The smallest of the p-values, corrected for taking the smallest, is
the candidate's p. Random keys have uniform p; ordinary text has p near 0.

False discoveries are controlled by length: candidates are grouped by encoding and length class, and
in each group the keys are counted from the upper half of the p-values, where ordinary text does not
reach. A group's threshold is the lowest at which the estimated share of ordinary text among the
accepted is at most `rate`, or at which no pile of low p-values stands out from uniform ones (so
chance alone never raises it). A group of fewer than `THIN` candidates is judged with its
neighbouring lengths, and its threshold never exceeds the fixed one of its length (`fixed_bin`); that
one holds if the encoding has too few candidates altogether. No group is left out. Only histograms
of the groups (encodings x lengths x bins) are gathered.

Per row, only candidates and spans leave the scan; texts are never shuffled.

Defined results: a null or empty text has no spans; a text of any length is scanned whole; repeated
rows each count. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import row_key, text_or_empty

# The base rules.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: A run of 20 or more key characters is a candidate.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from narrow to wide: (name, pattern, alphabet).
ENCODINGS = (
    ("digits", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", LOWER),
    ("UPPER", r"^[A-Z]+$", LOWER.upper()),
    ("base32", r"^[A-Z2-7]+$", LOWER.upper() + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + LOWER.upper()),
    ("letters", r"^[A-Za-z]+$", LOWER.upper() + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + LOWER.upper() + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", LOWER.upper() + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", LOWER.upper() + LOWER + DIGITS + "-_"),
    ("mixed", r"", LOWER.upper() + LOWER + DIGITS + "+/-_"),
)
#: Letters by how common they are in European prose, with the logarithm of how much more than evenly.
PROSE = (("eainsrt", 0.79), ("olud", 0.26), ("cmphg", -0.36), ("bfvkwzqyjx", -1.56))
VOWELS = "aeiouy"
#: Lower ends of the bins of p: fine near 0, then hundredths.
EDGES = (0.0, 1e-6, 1e-5, 1e-4, 1e-3, *[n / 100 for n in range(1, 100)])
BINS = len(EDGES)
RATE = 0.05
#: A pile of low p-values that uniform ones make with less than this probability is ordinary text.
CHANCE = 1e-3
#: A group of fewer candidates is judged with its neighbours.
THIN = 200


def _placed(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, match>>: the text between matches
    tells where each begins."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    at = F.aggregate(
        F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"),
                     found.alias("match")),
        F.expr("named_struct('end', 0, "
               "'out', cast(array() as array<struct<start:int,match:string>>))"),
        lambda done, x: F.struct(
            (done["end"] + x["gap"] + F.length(x["match"])).alias("end"),
            F.concat(done["out"], F.array(F.struct(
                (done["end"] + x["gap"]).alias("start"), x["match"].alias("match")))).alias("out")))
    none = F.expr("cast(array() as array<struct<start:int,match:string>>)")
    return F.when(text.rlike(pattern), at["out"]).otherwise(none)


def _spans(placed: Column, kind: int) -> Column:
    return F.transform(placed, lambda x: F.struct(
        x["start"].alias("start"), F.lit(kind).alias("kind"),
        (x["start"] + F.length(x["match"])).alias("stop")))


def _once(value: Column, of) -> Column:
    """`of(value)`, with `value` computed once: inside lambdas Spark repeats what is repeated."""
    return F.transform(F.array(value), of)[0]


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution, to about 1e-7 (a rational fit of the tail)."""
    def tail(x: Column) -> Column:
        return _once(F.lit(1.0) / (F.lit(1.0) + x * 0.2316419), lambda t: (
            t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (
                F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * 1.330274429))))
            * F.exp(-x * x / 2.0) * 0.3989422804014327))

    return _once(z, lambda v: F.when(v >= 0, tail(v)).otherwise(F.lit(1.0) - tail(-v)))


def _randomness(run: Column, alphabet: str) -> Column:
    """The battery's p-value of a run of symbols of `alphabet`."""
    k, n = len(alphabet), F.length(run).cast("double")
    # Chi-squared against equal counts; Wilson and Hilferty turn it into a normal deviate.
    squares = F.aggregate(
        F.split(F.lit(alphabet), ""), F.lit(0.0), lambda total, symbol: total + F.pow(
            (F.length(run) - F.length(F.replace(run, symbol, F.lit("")))).cast("double"),
            F.lit(2.0)))
    chi = squares * float(k) / n - n
    v = 2.0 / (9.0 * (k - 1))
    p_counts = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / float(k - 1), F.lit(1 / 3))
                            - (1 - v)) / v ** 0.5)
    # Runs above and below the middle of the alphabet.
    half = k // 2
    low_high = F.translate(run, alphabet, "0" * half + "1" * (k - half))
    ones = F.length(F.replace(low_high, F.lit("0"), F.lit(""))).cast("double")
    zeros = n - ones
    turns = sum((F.length(low_high) - F.length(F.replace(low_high, F.lit(x), F.lit("")))) / 2.0
                for x in ("01", "10"))
    mean = 2.0 * ones * zeros / n + 1.0
    spread = F.sqrt(F.greatest((mean - 1.0) * (mean - 2.0) / (n - 1.0), F.lit(1e-9)))
    p_runs = 2.0 * _upper_tail(F.abs(turns + 1.0 - mean) / spread)
    # Correlation of each symbol with the next one.
    values = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    centre = (k + 1) / 2.0
    products = F.aggregate(
        values, F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum")),
        lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.coalesce(
            (a["last"] - centre) * (x - centre), F.lit(0.0))).alias("sum")))["sum"]
    variance = (k * k - 1) / 12.0
    p_serial = 2.0 * _upper_tail(F.abs(products) / (F.sqrt(n - 1.0) * variance))
    tests = [p_counts, p_runs, p_serial]
    plain = F.lower(run)
    if set(LOWER) <= set(alphabet.lower()):
        weights = [next((w for of, w in PROSE if c in of), 0.0) for c in alphabet.lower()]
        even, wide = np.mean(weights), np.std(weights)
        classes = F.translate(plain, "".join(of for of, _ in PROSE), "".join(
            "~!#$"[i] * len(of) for i, (of, _) in enumerate(PROSE)))
        total = sum((n - F.length(F.replace(classes, F.lit(mark), F.lit("")))) * w
                    for mark, (_, w) in zip("~!#$", PROSE))
        tests.append(_upper_tail((total - n * float(even)) / (F.sqrt(n) * float(wide))))
    if alphabet.isalpha():
        p = len(VOWELS) / len(LOWER)
        pq = p * (1 - p)
        sounds = F.translate(plain, LOWER, "".join("1" if c in VOWELS else "0" for c in LOWER))
        changes = sum((F.length(sounds) - F.length(F.replace(sounds, F.lit(x), F.lit("")))) / 2.0
                      for x in ("01", "10"))
        variance = (n - 1.0) * (2 * pq * (1 - 2 * pq)) + (n - 2.0) * (2 * (pq - 4 * pq * pq))
        tests.append(_upper_tail((changes - (n - 1.0) * (2 * pq)) / F.sqrt(variance)))
    least = F.greatest(F.least(*tests), F.lit(0.0))
    return F.least(F.lit(1.0), F.lit(1.0) - F.pow(F.lit(1.0) - least, F.lit(float(len(tests)))))


def _bin(p: Column) -> Column:
    """The number of the bin of `EDGES` that holds p."""
    low = F.greatest(F.lit(0), (F.floor(F.log10(p)) + 7).cast("int"))
    return F.when(p >= 0.01, F.least(F.floor(p * 100).cast("int") + 4, F.lit(BINS - 1))).otherwise(
        F.least(low, F.lit(4)))


def _judged(placed: Column) -> Column:
    """Candidates as array<struct<start, stop, stratum, bin>>; stratum is encoding:length class."""
    def one(x: Column) -> Column:
        body = F.regexp_replace(x["match"], "=+$", "")
        name, p = F.lit(ENCODINGS[-1][0]), _randomness(body, ENCODINGS[-1][2])
        for encoding, pattern, alphabet in reversed(ENCODINGS[:-1]):
            fits = body.rlike(pattern)
            name = F.when(fits, F.lit(encoding)).otherwise(name)
            p = F.when(fits, _randomness(body, alphabet)).otherwise(p)
        size = F.floor(F.log2(F.length(body).cast("double")) * 2).cast("string")
        return F.struct(x["start"].alias("start"),
                        (x["start"] + F.length(x["match"])).alias("stop"),
                        F.concat_ws(":", name, size).alias("stratum"),
                        _once(p, _bin).alias("bin"))

    return F.transform(placed, one)


def fixed_bin(size: int) -> int:
    """The threshold of a length class without evidence: p of 0.01 below 32 characters, 0.001 below
    64, then 0.0001. Ordinary text of that length seldom reaches it; keys below it are lost."""
    return 5 if size < 10 else 4 if size < 12 else 3


def lowest_bin(counts: Sequence[int], rate: float = RATE) -> int:
    """The lowest acceptable bin of a histogram over `EDGES`."""
    c, edges = np.asarray(counts, float), np.asarray(EDGES)
    tails = c[::-1].cumsum()[::-1]
    # Keys have uniform p: the upper half shows how many there are.
    keys = 2.0 * tails[edges >= 0.5][0]
    for b in range(BINS):
        n = tails[b]
        if n - keys * (1 - edges[b]) <= rate * n:
            return b
        # Chernoff's bound of the chance that as many of n uniform values lie below the next edges.
        share = (n - tails[b + 1:]) / n
        even = (edges[b + 1:] - edges[b]) / (1 - edges[b])
        with np.errstate(divide="ignore", invalid="ignore"):
            apart = share * np.log(share / even) + np.where(
                share < 1, (1 - share) * np.log((1 - share) / (1 - even)), 0.0)
        if not np.any((share > even) & (n * apart > -math.log(CHANCE))):
            return b
    return BINS - 1


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[str, int]:
    """Lowest accepted bin of each stratum, from (stratum, bin) rows: every stratum has one."""
    found: dict[str, dict[int, np.ndarray]] = {}
    for r in candidates.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        name, size = r["stratum"].split(":")
        found.setdefault(name, {}).setdefault(int(size), np.zeros(BINS))[r["bin"]] += r["n"]
    out = {}
    for name, sizes in found.items():
        for size, own in sizes.items():
            pool, reach = own, 0
            while pool.sum() < THIN and reach < max(sizes) - min(sizes):
                reach += 1
                pool = sum(c for at, c in sizes.items() if abs(at - size) <= reach)
            if own.sum() >= THIN:
                lowest = lowest_bin(own, rate)
            elif pool.sum() >= THIN:
                lowest = min(lowest_bin(pool, rate), fixed_bin(size))
            else:
                lowest = fixed_bin(size)
            out[f"{name}:{size}"] = lowest
    return out


def scan(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> DataFrame:
    """`docs` without its text, with `secrets`: array<struct<start, kind, stop>> in order of start
    and kind; kind indexes `KINDS`. A random span that a base span covers is not repeated."""
    keep = [c for c in docs.columns if c not in (text_col, "secrets")]
    text = F.col("__text")
    assign = F.filter(_placed(text, ASSIGN), lambda x: F.length(
        F.regexp_extract(x["match"], ASSIGN, 1)) >= 8)
    # Runs are maximal, so asking for their least length in the pattern finds the same ones.
    access = _placed(text, ACCESS.replace("+", "{12,}"))
    hexes = _placed(text, HEX.replace("+", "{32,}"))
    placed = docs.select(*keep, text_or_empty(F.col(text_col)).alias("__text")).select(
        *keep, F.concat(_spans(assign, 0), _spans(access, 1), _spans(hexes, 2)).alias("__base"),
        _placed(text, CANDIDATE).alias("__runs"))
    found = row_key(placed.select(*keep, F.array_sort("__base").alias("__base"),
                                  _judged(F.col("__runs")).alias("__tested")), "__row")
    lowest = thresholds(found.select(F.explode("__tested").alias("x"))
                        .select("x.stratum", "x.bin"), rate)
    accepted = F.lit(False)
    if lowest:
        table = F.create_map(*[F.lit(v) for pair in sorted(lowest.items()) for v in pair])
        chosen = F.filter("__tested", lambda x: F.coalesce(
            x["bin"] >= table[x["stratum"]], accepted))
    else:
        chosen = F.filter("__tested", lambda x: accepted)
    added = F.transform(
        F.filter(chosen, lambda x: ~F.exists(
            F.col("__base"), lambda b: (b["start"] <= x["start"]) & (b["stop"] >= x["stop"]))),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"),
                           x["stop"].alias("stop")))
    return found.select(*keep, F.array_sort(F.concat("__base", added)).alias("secrets"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
        x["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(
        "secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret of its texts replaced by `mark`, overlapping ones by one mark. The
    text travels with its row, so nothing is joined; a null text stays null."""
    # Rows travel whole, as one column, so their columns may have any names.
    found = scan(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")), "text")
    whole = F.col("row").getField(text_col)
    # Each step keeps what was cut so far and where the last secret ended.
    done = F.aggregate(
        "secrets", F.struct(F.lit("").alias("out"), F.lit(0).alias("end")),
        lambda a, x: F.when(x["start"] < a["end"], F.struct(
            a["out"].alias("out"), F.greatest(a["end"], x["stop"]).alias("end"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(
                whole, a["end"] + 1, x["start"] - a["end"]), F.lit(mark)).alias("out"),
                x["stop"].alias("end"))))
    cut = F.concat(done["out"], F.substring(whole, done["end"] + 1, F.length(whole)))
    text = F.when(F.size("secrets") > 0, cut).otherwise(whole).alias(text_col)
    return found.select(*[text if c == text_col else F.col("row").getField(c).alias(c)
                          for c in docs.columns])
