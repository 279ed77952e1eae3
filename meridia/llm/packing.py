"""Best-fit packing of tokenised documents by bin completion.

Bin packing depends on the lengths alone, so the plan is made from the length histogram (at
most `capacity` rows, whatever the corpus): branch-and-bound completes the bin of the largest
length left with its undominated fillings, made one by one as the search asks for them, applies a
filling to as many bins as the counts allow (or, further on, to one), and prunes a branch whose waste can't beat the incumbent.
The first incumbent is the best-fit-decreasing packing; dives that complete each bin by its best filling, with a
price on each piece besides the waste (so that small pieces aren't spent too early), give further ones. Each piece then finds its
bin from its rank among the pieces of its length. The search ends at the lower bound, or after `effort` fillings looked at.

Defined results: a null or empty text is one piece holding only the end id; repeated rows are
packed each; equal lengths are interchangeable, so ties go by the order in which pieces are read; texts of any length, long runs
of blanks included, are encoded whole and cut into pieces; extra columns, whatever their names, are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import Scratch, ship
from .textnum import column_bytes

Filling = tuple[int, ...]  # lengths, descending


# ---- the plan ------------------------------------------------------------------------------


def _add(reach: int, size: int, left: int, full: int) -> int:
    """The sums reachable with up to `left` more pieces of a size, as bits."""
    part = 1
    while left > 0:
        k = min(part, left)
        reach |= (reach << (size * k)) & full
        left -= k
        part *= 2
    return reach


def _bits(x: int) -> Iterator[int]:
    while x:
        yield (x & -x).bit_length() - 1
        x &= x - 1


def _with_sum(sizes: list[int], counts: list[int], ahead: list[int], total: int) -> Iterator[Filling]:
    """Every filling of just this sum, those of larger pieces first; ahead[i]: the sums of sizes[i:]."""

    def go(i: int, rest: int, got: Filling) -> Iterator[Filling]:
        while rest and i < len(sizes) and sizes[i] > rest:
            i += 1
        if not rest:
            yield got
        elif i < len(sizes) and ahead[i] >> rest & 1:
            for k in range(min(counts[i], rest // sizes[i]), -1, -1):
                left = rest - k * sizes[i]
                if ahead[i + 1] >> left & 1:
                    yield from go(i + 1, left, got + (sizes[i],) * k)

    return go(0, total, ())


def _dominated(f: Filling, waste: int, spare: int) -> bool:
    """Whether a spare piece could join the filling, or take the place of some of its pieces without being smaller:
    those could fill that piece's place elsewhere. `spare`: the lengths left over, as bits."""
    if waste and spare & ((2 << waste) - 2):
        return True
    one, more = 0, 0  # the sums of single pieces, and of two or more
    for x in f:
        more |= (one | more) << x
        one |= 1 << x
    larger = more if waste == 0 else more | one << 1
    reach, done, room = larger, 0, max(waste - 1, 0)  # spread by up to `waste`, single pieces from 1 on
    while done < room:
        step = min(done + 1, room - done)
        reach |= reach << step
        done += step
    return bool((reach | more << waste) & spare)


def fillings(counts: np.ndarray, room: int, price: float = 0.0, budget: list[int] | None = None) -> Iterator[Filling]:
    """Every undominated filling of `room`, best first: least waste plus `price` for each piece, as far as sums tell.
    `budget[0]` falls by one for each filling looked at; nothing more comes once it is spent."""
    room = min(room, len(counts) - 1)
    sizes = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1]]
    have = [int(counts[x]) for x in sizes]
    full = (2 << room) - 1
    ahead = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        ahead[i] = _add(ahead[i + 1], sizes[i], min(have[i], room // sizes[i]), full)
    totals = list(_bits(ahead[0]))[::-1]
    if price:
        fewest, level, seen = {0: 0}, 1, 1
        for n in range(1, 9):  # sums of more pieces count as of nine
            nxt = 0
            for x in sizes:
                nxt |= level << x
            level = nxt & full & ~seen
            seen |= level
            fewest |= dict.fromkeys(_bits(level), n)
        totals.sort(key=lambda t: (room - t) + price * fewest.get(t, 9))
    top = (2 << max(sizes, default=0)) - 1
    for total in totals:
        for f in _with_sum(sizes, have, ahead, total):
            if budget is not None:
                budget[0] -= 1
                if budget[0] < 0:
                    return
            spare = sum(1 << x for x in sizes if counts[x] > f.count(x)) if len(sizes) < 24 else _spare(sizes, counts, f)
            if not _dominated(f, room - total, spare & top):
                yield f


def _spare(sizes: list[int], counts: np.ndarray, f: Filling) -> int:
    gone = [x for x in set(f) if counts[x] <= f.count(x)]
    bits = np.zeros((sizes[0] if sizes else 0) + 1, np.uint8)
    bits[sizes] = 1
    bits[gone] = 0
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on the histogram: (lengths of a bin, number of such bins)."""
    left = counts.copy()
    out = []
    while True:
        big = int(np.flatnonzero(left)[-1]) if left.any() else 0
        if not big:
            return out
        left[big] -= 1
        got, room = [big], capacity - big
        while room:
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit):
                break
            got.append(int(fit[-1]))
            left[fit[-1]] -= 1
            room -= got[-1]
        left[big] += 1
        for x in got[1:]:
            left[x] += 1
        times = _times(left, got)
        for x in got:
            left[x] -= times
        out.append((tuple(got), times))


def _times(counts: np.ndarray, lengths) -> int:
    sizes, need = np.unique(lengths, return_counts=True)
    return int((counts[sizes] // need).min())


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat: by volume, by pieces that can't share a bin, and by volumes in which
    lengths are rounded to shares that a bin can't hold more of."""
    size = np.arange(len(counts))
    n, volume = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * size)[::-1])[::-1]  # of this length or more
    n, volume = np.append(n, 0), np.append(volume, 0)
    best = -(-int(volume[0]) // capacity)
    half = capacity // 2 + 1
    for k in range(capacity // 2 + 1):  # those above capacity - k are alone; those up to it above the half take some from k on
        alone, pairs = int(n[capacity - k + 1]), int(n[half] - n[capacity - k + 1])
        free = pairs * capacity - int(volume[half] - volume[capacity - k + 1])
        best = max(best, alone + pairs + max(0, -(-(int(volume[k] - volume[half]) - free) // capacity)))
    for k in range(1, 40):
        share = (k + 1) * size // capacity
        exact = (k + 1) * size % capacity == 0
        best = max(best, -(-int((counts * np.where(exact, k * size, share * capacity)).sum()) // (k * capacity)))
    return best


#: Prices on a piece, in tokens of waste, that the dives try.
PRICES = (0, 2, 6, 12, 20, 32, 48, 64, 80, 112)


def plan(counts: np.ndarray, capacity: int, *, effort: int = 40_000) -> list[tuple[Filling, int]]:
    """Bins (lengths, how many alike) that hold `counts[length]` pieces of each length.

    `effort` bounds the fillings that the search looks at, not the pieces: beyond it the best packing so far stands."""
    counts = np.asarray(counts, np.int64).copy()
    counts[0] = 0
    weight = np.arange(len(counts))
    best = best_fit(counts, capacity)
    bins = sum(k for _, k in best)
    floor = lower_bound(counts, capacity)
    def options(left: np.ndarray, price: float, budget: list[int]) -> Iterator[tuple[Filling, int]]:
        big = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[big] -= 1
        many = False
        for f in fillings(rest, capacity - big, price, budget):
            times = _times(left, (big, *f))
            many |= times > 1
            yield (big, *f), times
        if many:
            for f in fillings(rest, capacity - big, price, budget):
                yield (big, *f), 1

    def search(price: float, budget: list[int], dive: bool) -> None:
        nonlocal best, bins
        path: list[tuple[Filling, int]] = []
        stack = [(counts, 0, options(counts, price, budget))]
        while stack and budget[0] > 0 and bins > floor:
            left, used, choices = stack[-1]
            step = next(choices, None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                continue
            bin_, times = step
            after = left.copy()
            for x in bin_:
                after[x] -= times
            rest = int((after * weight).sum())
            if used + times + max(-(-rest // capacity), int(after[capacity // 2 + 1 :].sum())) >= bins:
                if dive:
                    return
                continue
            if not rest:
                best, bins = [*path, step], used + times
                if dive:
                    return
                continue
            path.append(step)
            stack.append((after, used + times, options(after, price, budget)))

    first = 0
    for price in PRICES:
        before = bins
        search(price, [effort // 20], True)
        first = price if bins < before else first
    search(first, [effort // 2], False)
    return best


def intervals(bins: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of the length a bin, offset in it), by length and rank."""
    rows, seen, first = [], {}, 0
    for lengths, times in bins:
        at = 0
        for x in sorted(set(lengths), reverse=True):
            m = lengths.count(x)
            rows.append((x, seen.get(x, 0), first, m, at))
            seen[x] = seen.get(x, 0) + m * times
            at += m * x
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# ---- tokens --------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 characters stand for
    themselves, the other bytes for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + i)] = b
    return out


LONG_BLANK = 50_000
BLANKS = re.compile(r"(?<!\s)\s{%d}" % LONG_BLANK)


class ByteTokenizer:
    """Ids of a byte-level BPE file (its JSON text), encoded by tiktoken where ids follow the merges."""

    def __init__(self, text: str, pattern: str):
        import tiktoken

        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        names = {x["content"] for x in added}
        back = _byte_of()
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in names}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        flags = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) for x in added)
        if order != sorted(order) or not plain or not flags or model.get("dropout") or model.get("ignore_merges"):
            raise NotImplementedError("a byte-level BPE file without normaliser whose ids follow its merges is needed")
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = {x["content"]: x["id"] for x in added}
        self.text, self.slow = text, None

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_BLANK and BLANKS.search(text):  # the other's pattern matcher gives up on these
            if self.slow is None:
                import tokenizers

                self.slow = tokenizers.Tokenizer.from_str(self.text)
            return self.slow.encode(text, add_special_tokens=False).ids
        for name, i in self.special.items():
            if name in text:
                head, _, tail = text.partition(name)
                return [*self.encode(head), i, *self.encode(tail)] if tail.count(name) < 200 else self._many(text)
        return self.core.encode_ordinary(text)

    def _many(self, text: str) -> list[int]:
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            out += [self.special[part]] if part in self.special else self.core.encode_ordinary(part)
        return out


_TOKENIZERS: dict[int, ByteTokenizer] = {}


def tokenizer_of(text: str, pattern: str) -> ByteTokenizer:
    key = hash((text, pattern))
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = ByteTokenizer(text, pattern)
    return _TOKENIZERS[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole, or full pieces after a shorter first."""
    head = n % capacity or capacity
    return [(0, min(head, n)), *((s, capacity) for s in range(head, n, capacity))]


def pieces(spark: SparkSession, docs: DataFrame, tokenizer_path: str, pattern: str, *, capacity: int = 1024, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's rank (`part`, `nth`) among those of its length."""
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file, of fixed size
    kind = docs.select(F.col(id_col).alias("doc_id")).schema.fields
    schema = StructType([*kind, *StructType.fromDDL("piece int, start long, length long, ids_crc32 long, part int, nth long").fields])

    def run(batches):
        t = tokenizer_of(shared.value, pattern)
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            raw, off = column_bytes(batch.column(1))
            where, rows = [], []
            for d in range(len(batch)):
                ids = t.encode(raw[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace"))
                ids.append(end_id)
                flat = memoryview(array("I", ids)).cast("B")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    where.append(d)
                    rows.append((k, s, n, crc32(flat[4 * s : 4 * (s + n)]), seen[n]))
                    seen[n] += 1
            r = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(where, pa.int64())), pa.array(r[:, 0].astype(np.int32)), *(pa.array(r[:, i]) for i in (1, 2, 3)), pa.array(np.full(len(r), task, np.int32)), pa.array(r[:, 4])],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, pattern: str, *, capacity: int = 1024, end_id: int = 2, **cols) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    cutting = scratch.put(pieces(spark, docs, tokenizer_path, pattern, capacity=capacity, end_id=end_id, **cols), "pieces")
    sizes = cutting.groupBy("length", "part").count()
    total = sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in total:
        counts[r["length"]] = r["n"]
    rows = intervals(plan(counts, capacity)) if total else np.zeros((0, 5), np.int64)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = cutting.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    schema = StructType([*ranked.drop("rank").schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    shared = spark.sparkContext.broadcast(rows)  # a row per bin pattern and length; patterns are bounded by the lengths

    def place(batches):
        r = shared.value
        key = (r[:, 0] << 44) | r[:, 1]
        for batch in batches:
            size, rank = (np.asarray(batch.column(i), np.int64) for i in (3, 5))
            i = np.searchsorted(key, (size << 44) | rank, side="right") - 1
            nth = rank - r[i, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(r[i, 2] + nth // r[i, 3]), pa.array(r[i, 4] + nth % r[i, 3] * size)], names=schema.names)

    return ranked.mapInArrow(place, schema)
