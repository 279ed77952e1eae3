"""Secrets in text, with DataFrame functions only.

Patterned secrets are found by their forms. Beyond them, long tokens are put through a battery of
randomness tests over the alphabet of their inferred encoding: a chi-squared test of uniform
letters, a runs test about the middle of the alphabet and a lag-1 serial correlation, their
p-values combined by Fisher's rule. A random token's p is uniform; one below `ALPHA` (repeats, rules,
runs of the alphabet) is not random. The others are held against ordinary tokens: `evidence` is
the log-likelihood ratio in bits of uniform letters to a model of words, identifiers, paths and numbers, which
all encodings share and which is fixed, so it is there for a table of any size; a longer token carries more
bits. An ordinary token of any length and encoding reaches b bits with a chance of at most
2**-b (Markov's inequality), so 2**-b is a p-value under the ordinary null, and the
Benjamini-Hochberg rule over all tokens outside patterned secrets holds the share of ordinary ones among
those found at `fdr`, as far as the model fits. A token alone in its table needs 4.5 bits, one among a million about 24.

Positions come from the pieces between matches and the matches themselves, which
interleave; they are code points, end exclusive.

Defined results: a null text counts as empty and has no spans; repeated rows have equal results; spans that start
alike are listed by kind; tokens of equal evidence are found or left together; an empty table gives an empty result; texts of any
length are scanned whole, in time that grows with the length (and with the 1.5th power of the number of matches, by a small constant);
extra columns are ignored unless `keep` names them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

# The patterned kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # whole runs: a shorter run fails at each of its starts
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"  # may follow '=': name=TOKEN, ?param=TOKEN
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings, narrowest first: the first whose alphabet holds the whole token is inferred.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("^[a-z]+$", LOWER),
    ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", DIGITS + UPPER + LOWER + "+/"),
    ("", DIGITS + UPPER + LOWER + "-_+/"),
)
ALPHA = 1e-4
#: Ordinary tokens: letters by case, digits and separators (in the order of LETTERS) follow one another by STEP; within
#: a kind, letters have about their share in European languages. Without lower case, upper case counts as lower.
LETTERS = LOWER + UPPER + DIGITS + "-_+/"
KIND_OF = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
START = (0.6, 0.25, 0.13, 0.02)
STEP = ((0.9, 0.04, 0.02, 0.04), (0.6, 0.3, 0.05, 0.05), (0.07, 0.04, 0.8, 0.09), (0.55, 0.2, 0.15, 0.1))
_COUNTS = (7.9, 1.7, 3.0, 4.2, 14.4, 1.6, 2.2, 4.0, 7.3, 0.3, 0.9, 4.6, 2.7, 8.1, 5.6, 2.1, 0.3, 6.6, 6.8, 7.2, 4.2, 1.3, 1.5, 0.3, 1.0, 0.6)
SHARE = [x / sum(_COUNTS) for x in _COUNTS] * 2 + [0.1] * 10 + [0.35, 0.35, 0.05, 0.25]
#: Steps of a bit in which evidence is kept, and its last step.
BIT, MOST = 4, 1023


def one(col: Column, f) -> Column:
    """f of an expression that is bound to a name, hence computed once."""
    return F.element_at(F.transform(F.array(col), f), 1)


def running(values: Column, start: Column, op) -> Column:
    """The running sums (or another `op`) of an array. Arrays grow by copying, so it goes by blocks of about the root
    of the length: that copies n**1.5 numbers, not n**2."""

    def walk(x: Column, at: Column) -> Column:
        step = lambda acc, v: one(op(acc["at"], v), lambda y: F.struct(y.alias("at"), F.concat(acc["out"], F.array(y)).alias("out")))
        return F.aggregate(x, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step)["out"]

    def by_blocks(x: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.greatest(size, F.lit(1))), lambda k: F.slice(x, k + 1, F.greatest(size, F.lit(1))))
        return one(blocks, whole)

    def whole(blocks: Column) -> Column:
        ends = walk(F.transform(blocks, lambda b: F.aggregate(b, start, op)), start)
        before = F.concat(F.array(start), ends)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.slice(before, F.lit(1), F.size(blocks)).alias("at")), lambda v: walk(v["b"], v["at"])))

    return F.when(F.size(values) > 0, one(values, by_blocks)).otherwise(F.array().cast("array<int>"))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<s, k, e>> of the matches whose `group` has at least `least` characters."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = lambda x: F.transform(x, lambda v: F.char_length(v))
    part = sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.array().cast("array<int>")
    x = F.arrays_zip(sizes(found).alias("m"), sizes(F.slice(gaps, 1, F.size(found))).alias("b"), part.alias("g"))

    def placed(x: Column) -> Column:
        ends = running(F.transform(x, lambda v: v["m"] + v["b"]), F.lit(0), lambda a, b: a + b)
        return F.transform(F.arrays_zip(x.alias("x"), ends.alias("e")), lambda v: F.struct((v["e"] - v["x"]["m"]).alias("s"), F.lit(kind).alias("k"), v["e"].alias("e"), v["x"]["g"].alias("n")))

    spans = one(x, placed)
    spans = F.filter(spans, lambda v: v["n"] >= least) if group else spans
    return F.when(text.rlike(pattern), F.transform(spans, lambda v: F.struct(v["s"], v["k"], v["e"]))).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|), by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _encoding(token: Column) -> Column:
    """The number of the first encoding whose alphabet holds the whole token."""
    out = F.lit(len(ENCODINGS) - 1)
    for i in range(len(ENCODINGS) - 2, -1, -1):
        out = F.when(token.rlike(ENCODINGS[i][0]), F.lit(i)).otherwise(out)
    return out


def randomness(token: Column, encoding: Column) -> Column:
    """The combined p-value of a token (without padding) under uniform random letters of its encoding."""
    alphabet = F.get(F.array(*[F.lit(a) for _, a in ENCODINGS]), encoding)
    x = F.struct(token.alias("t"), alphabet.alias("a"), F.char_length(token).cast("double").alias("n"), F.char_length(alphabet).cast("double").alias("k"))
    letters = lambda v: F.filter(F.split(v["t"], ""), lambda c: c != F.lit(""))
    index = lambda v: F.transform(letters(v), lambda c: (F.position(c, v["a"]) - 1).cast("double"))

    def tests(v: Column) -> Column:
        n, k, i = v["n"], v["k"], v["i"]
        squares = F.aggregate(F.array_distinct(i), F.lit(0.0), lambda acc, y: acc + F.pow(F.size(F.filter(i, lambda u: u == y)).cast("double"), F.lit(2.0)))
        chi = k / n * squares - n
        z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        ones = F.size(F.filter(i, lambda u: u >= k / 2)).cast("double")
        both = 2 * ones * (n - ones)
        pairs = F.arrays_zip(F.slice(i, F.lit(1), F.size(i) - 1).alias("p"), F.slice(i, F.lit(2), F.size(i) - 1).alias("q"))
        run_count = 1 + F.size(F.filter(pairs, lambda u: (u["p"] >= k / 2) != (u["q"] >= k / 2)))
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (run_count - (1 + both / n)) / F.sqrt(F.greatest(spread, F.lit(1e-12)))).otherwise(F.sqrt(n))
        # the mean is bound to a name, else each step of the sums below would compute it anew
        mean = F.aggregate(i, F.lit(0.0), lambda acc, u: acc + u) / n
        centred = one(mean, lambda m: F.transform(i, lambda u: u - m))

        def serial(d: Column) -> Column:
            var = F.aggregate(d, F.lit(0.0), lambda acc, u: acc + u * u)
            lagged = F.arrays_zip(F.slice(d, F.lit(1), F.size(d) - 1).alias("p"), F.slice(d, F.lit(2), F.size(d) - 1).alias("q"))
            cov = F.aggregate(lagged, F.lit(0.0), lambda acc, u: acc + u["p"] * u["q"])
            return F.when(var > 0, (cov / F.greatest(var, F.lit(1e-12)) + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))

        z_serial = one(centred, serial)
        y = -(F.log(_two_sided(z_chi)) + F.log(_two_sided(z_runs)) + F.log(_two_sided(z_serial)))
        return one(y, lambda w: F.exp(-w) * (1 + w + w * w / 2))

    return one(one(x, lambda v: F.struct(v["n"], v["k"], index(v).alias("i"))), tests)


def evidence(token: Column, encoding: Column) -> Column:
    """Bits by which uniform letters of its encoding (each encoding as likely) explain a token better than the ordinary model."""
    table = lambda values: F.array(*[F.lit(v) for v in values])
    logs = lambda values: table([math.log2(v) for v in values])
    folded = F.when(token.rlike("[a-z]"), token).otherwise(F.lower(token))
    index = F.transform(F.filter(F.split(folded, ""), lambda c: c != F.lit("")), lambda c: F.position(c, F.lit(LETTERS)) - 1)

    def ordinary(v: Column) -> Column:
        i, kinds = v["i"], v["k"]
        pairs = F.arrays_zip(F.slice(kinds, F.lit(1), F.size(kinds) - 1).alias("p"), F.slice(kinds, F.lit(2), F.size(kinds) - 1).alias("q"))
        first = F.get(logs(START), F.get(kinds, F.lit(0)))
        within = F.aggregate(i, first, lambda acc, u: acc + F.get(logs(SHARE), u))
        return F.aggregate(pairs, within, lambda acc, u: acc + F.get(logs([x for row in STEP for x in row]), 4 * u["p"] + u["q"]))

    of_kinds = one(index, lambda i: F.struct(i.alias("i"), F.transform(i, lambda u: F.get(table(KIND_OF), u)).alias("k")))
    uniform = -F.char_length(token) * F.get(logs([len(a) for _, a in ENCODINGS]), encoding) - math.log2(len(ENCODINGS))
    return uniform - one(of_kinds, ordinary)


def _candidates(text: Column) -> Column:
    """array<struct<s, e, b>> of long tokens: span and steps of evidence, 0 where the battery rejects randomness."""
    spans = _spans(text, TOKEN, KINDS.index("random"))
    zipped = F.arrays_zip(spans.alias("x"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("t"))

    def scored(v: Column) -> Column:
        body = F.rtrim(v["t"], F.lit("="))
        code = _encoding(body)
        steps = F.greatest(F.lit(0), F.least(F.lit(MOST), F.floor(BIT * evidence(body, code)).cast("int")))
        return F.struct(v["x"]["s"].alias("s"), v["x"]["e"].alias("e"), F.when(randomness(body, code) >= ALPHA, steps).otherwise(0).alias("b"))

    return F.when(text.rlike(TOKEN), F.transform(zipped, scored)).otherwise(F.array().cast("array<struct<s:int,e:int,b:int>>"))


def threshold(steps: DataFrame, fdr: float) -> int:
    """The least step of evidence `b` that counts as random, by Benjamini-Hochberg (at most MOST + 1 rows reach the driver)."""
    hist = {r["b"]: r["count"] for r in steps.groupBy("b").count().collect()}
    total, above, out = sum(hist.values()), 0, MOST + 1
    for b in sorted(hist, reverse=True):
        above += hist[b]
        if total * 2.0 ** (-b / BIT) <= fdr * above:
            out = b
    return out


def scan(spark: SparkSession, docs: DataFrame, *, fdr: float = 0.05, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_assign, n_access, n_hex, base and spans: arrays of (s, k, e) by start, then kind (see KINDS)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = docs.select(
        *keep,
        _spans(text, ASSIGN, 0, 2, 6).alias("assign"),
        _spans(text, ACCESS, 1).alias("access"),
        _spans(text, HEX, 2).alias("hex"),
        _candidates(text).alias("found"),
    )
    parts = Scratch(spark, "secrets").put(parts, "parts")
    base = F.array_sort(F.concat("assign", "access", "hex"))
    free = F.when(F.size("found") > 0, F.when(F.size("base") > 0, _free(F.col("base"), F.col("found"))).otherwise(F.col("found"))).otherwise(F.array().cast("array<struct<s:int,e:int,b:int>>"))
    least = threshold(parts.where(F.size("found") > 0).select(base.alias("base"), "found").select(F.explode(free).alias("x")).select("x.b"), fdr)
    extra = F.transform(F.filter(free, lambda v: v["b"] >= least), lambda v: F.struct(v["s"].alias("s"), F.lit(KINDS.index("random")).alias("k"), v["e"].alias("e")))
    counts = [F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")]
    return parts.select(*keep, *counts, base.alias("base"), "found").select(*keep, "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def _free(base: Column, found: Column) -> Column:
    """The ones of `found` that overlap no span of `base`: in the order of their starts, none before reaches in and none
    after starts inside."""
    events = F.array_sort(F.concat(F.transform(base, lambda v: F.struct(v["s"].alias("s"), F.lit(0).alias("k"), v["e"].alias("e"), F.lit(0).alias("b"))), F.transform(found, lambda v: F.struct(v["s"].alias("s"), F.lit(1).alias("k"), v["e"].alias("e"), v["b"].alias("b")))))

    def apart(x: Column) -> Column:
        reach = running(F.transform(x, lambda v: F.when(v["k"] == 0, v["e"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        end = F.lit(2**31 - 1)
        ahead = F.reverse(running(F.reverse(F.transform(x, lambda v: F.when(v["k"] == 0, v["s"]).otherwise(end))), end, lambda a, b: F.least(a, b)))
        alone = F.filter(F.arrays_zip(x.alias("x"), reach.alias("r"), ahead.alias("a")), lambda v: (v["x"]["k"] == 1) & (v["r"] <= v["x"]["s"]) & (v["a"] >= v["x"]["e"]))
        return F.transform(alone, lambda v: F.struct(v["x"]["s"].alias("s"), v["x"]["e"].alias("e"), v["x"]["b"].alias("b")))

    return one(events, apart)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda v: F.concat_ws(":", F.get(kind, v["k"]), v["s"].cast("string"), v["e"].cast("string"))), ",")


#: Code points of a piece in which a text is cut.
PIECE = 1024


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of overlapping spans replaced by `mark`; spans come by start."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        whole = F.slice(pieces, first + 1, F.ceil(b / PIECE).cast("int") - first)
        return F.when(b > a, F.substring(F.array_join(whole, ""), a - PIECE * first + 1, b - a)).otherwise("")

    def marked(x: Column) -> Column:
        reach = x["reach"]
        before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
        gaps = F.filter(F.arrays_zip(x["spans"].alias("v"), before.alias("at")), lambda g: g["v"]["s"] >= g["at"])
        head = F.array_join(F.transform(gaps, lambda g: F.concat(cut(x["pieces"], g["at"], g["v"]["s"]), F.lit(mark))), "")
        return F.concat(head, cut(x["pieces"], F.element_at(reach, -1), x["n"]))

    reach = running(F.transform(spans, lambda v: v["e"]), F.lit(0), lambda a, b: F.greatest(a, b))
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))  # an array is cut without passing over the text again
    x = F.struct(spans.alias("spans"), reach.alias("reach"), pieces.alias("pieces"), F.char_length(text).alias("n"))
    return F.when(F.size(spans) > 0, one(x, marked)).otherwise(text)
