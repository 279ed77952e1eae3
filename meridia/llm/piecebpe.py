"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A run of texts becomes flat symbol arrays; each distinct word is merged once: every round takes
the smallest pair rank of each word (segmented minimum), merges its leftmost non-overlapping
occurrences at once and compacts the arrays, until no pair of a vocabulary piece remains.

A piece that could form a better-ranked piece with a neighbour is merged one occurrence a round,
so the result is that of the library's priority queue. Words for which that, or their sheer length, would take many
rounds (runs of blanks, texts without any) are finished by such a queue instead, pair by pair.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows
and extra columns change nothing; of pairs of equal rank the leftmost goes first; texts of any length, and words of any length, are
encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .langid import code_points
from .store import ship
from .textnum import column_bytes, mix, runs

SPACE = 0x2581
NONE = np.iinfo(np.int32).max
#: Symbols of a word, or best pairs of it that go one by one, beyond which it is merged by a queue.
LONG_WORD, MANY = 4096, 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(field number, value) of a protocol-buffer message: ints, or bytes of fixed and delimited fields."""
    i, n = 0, len(raw)

    def varint(i):
        v = s = 0
        while True:
            b = raw[i]
            v |= (b & 127) << s
            i, s = i + 1, s + 7
            if b < 128:
                return v, i

    while i < n:
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            v, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            v, i = raw[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            v, i = raw[i : i + size], i + size
        yield tag >> 3, v


class PieceModel:
    """Vocabulary tables of a BPE model file (its bytes)."""

    def __init__(self, raw: bytes):
        pieces, scores, kinds = [], [], []
        trainer, normal = {}, {}
        for k, v in _fields(raw):
            if k == 1:
                p = dict(_fields(v))
                pieces.append(p.get(1, b"").decode())
                scores.append(float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0)
                kinds.append(p.get(3, NORMAL))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normal = dict(_fields(v))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or {USER, UNUSED} & set(kinds):
            raise NotImplementedError("only BPE models with the identity normalisation, kept white space and no user-defined or unused pieces")
        self.dummy = bool(normal.get(3, 1))
        self.fallback = bool(trainer.get(35, 0))
        self.unknown = kinds.index(UNKNOWN)
        self.size = len(pieces)
        vocab = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        order = sorted({-scores[i] for i in vocab.values()})
        place = {s: r for r, s in enumerate(order)}
        singles = {c for p in vocab for c in p} | {p for p in vocab if len(p) == 1}
        symbol = dict(vocab)
        for c in sorted(singles):
            symbol.setdefault(c, len(pieces) + len(symbol))
        names = sorted(set(symbol.values()))
        self.n_symbols = names[-1] + 2
        self.lost = self.n_symbols - 1  # any other character
        self.rank = np.full(self.n_symbols, NONE, np.int32)
        for i in vocab.values():
            self.rank[i] = place[-scores[i]]
        left, right, whole = [], [], []
        risky = set()
        for p, i in vocab.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(i)
                    risky.update(x for x in (a, b) if self.rank[x] != NONE and self.rank[x] >= self.rank[i])
        self.risky = np.zeros(self.n_symbols, bool)
        self.risky[list(risky)] = True
        self.split_words = not any(a != "▁" and b == "▁" for p in vocab for a, b in zip(p, p[1:]))
        self._pairs(np.array(left, np.int64), np.array(right, np.int64), np.array(whole, np.int32))
        chars = np.array([ord(c) for c in singles], np.uint32)
        ids = np.array([symbol[c] for c in singles], np.int32)
        self.low = np.full(0x3000, self.lost, np.int32)
        self.low[chars[chars < 0x3000]] = ids[chars < 0x3000]
        high = chars >= 0x3000
        by = np.argsort(chars[high])
        self.high, self.high_ids = chars[high][by], ids[high][by]
        byte_of = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.byte_ids = np.array([byte_of.get(b, self.unknown) for b in range(256)], np.int32)
        surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace("▁", " ").encode() for p, k in zip(pieces, kinds)
        ]
        self.surface = _table(surface)
        self.decimal = _table([b"%d," % i for i in range(len(pieces))])
        self.is_byte = np.array(kinds) == BYTE
        self.control = np.array(kinds) == CONTROL
        self.leads = np.array([k == NORMAL and p[:1] == "▁" for p, k in zip(pieces, kinds)])  # its space is the dummy prefix at the start

    def _pairs(self, left, right, whole):
        """An open-addressing table from pair to piece."""
        key = left * self.n_symbols + right
        bits = max(10, int(np.ceil(np.log2(max(len(key), 1) * 4))))
        self.bits, self.keys, self.vals = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo = np.arange(len(key))
        slot = self._slot(key)
        self.probes = 0
        self.pair: dict[int, int] | None = None
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[todo[free]]  # the last of equal slots stays
            won = self.keys[slot] == key[todo]
            self.vals[slot[won]] = whole[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << bits) - 1)

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair of symbols, -1 if none."""
        key = a.astype(np.int64) * self.n_symbols + b
        slot = self._slot(key)
        got = self.keys[slot]
        out = np.where(got == key, self.vals[slot], -1).astype(np.int32)
        todo = np.flatnonzero((got != key) & (got != -1))
        slot = slot[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            slot = (slot + 1) & (len(self.keys) - 1)
            got = self.keys[slot]
            hit = got == key[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            go = ~hit & (got != -1)
            todo, slot = todo[go], slot[go]
        return out

    def symbols(self, cp: np.ndarray) -> np.ndarray:
        out = self.low[np.where(cp < 0x3000, cp, 0)]
        big = np.flatnonzero(cp >= 0x3000)
        if len(big):
            if len(self.high):
                at = np.minimum(np.searchsorted(self.high, cp[big]), len(self.high) - 1)
                out[big] = np.where(self.high[at] == cp[big], self.high_ids[at], self.lost)
            else:
                out[big] = self.lost
        return out

    def merge_words(self, cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words given as code points and their starts (one more at the end)."""
        n_words = len(start) - 1
        sym, where = self.symbols(cp), np.arange(len(cp), dtype=np.int64)
        word = np.repeat(np.arange(n_words), np.diff(start))
        done: list[tuple] = []
        piece = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            same = word[:-1] == word[1:]
            piece[:-1][same] = self.merged(sym[:-1][same], sym[1:][same])
        size = np.diff(start)
        if (size > LONG_WORD).any():
            live = np.ones(len(sym), bool)
            for w in np.flatnonzero(size > LONG_WORD):
                part = slice(start[w], start[w + 1])
                done.append(self._queued(word[part], sym[part], where[part], piece[part]))
                live[part] = False
            sym, where, word, piece = sym[live], where[live], word[live], piece[live]
        while len(sym):
            rank = np.where(piece >= 0, self.rank[piece], NONE)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            open_ = least != NONE
            if not open_.all():
                live = np.repeat(open_, size)
                done.append((word[~live], sym[~live], where[~live]))
                sym, where, word, piece, rank = sym[live], where[live], word[live], piece[live], rank[live]
                size, least = size[open_], least[open_]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # of pairs that overlap, each second one; of risky pieces, the first of each word
            gap = np.concatenate(([True], np.diff(hit) > 1))
            head = np.flatnonzero(gap)
            hit = hit[(np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))) % 2 == 0]
            if self.risky[piece[hit]].any():
                many, at = np.unique(word[hit[self.risky[piece[hit]]]], return_counts=True)
                many = many[at > MANY]
                if len(many):
                    live = np.ones(len(sym), bool)
                    for w in many:
                        part = slice(*np.searchsorted(word, [w, w + 1]))
                        done.append(self._queued(word[part], sym[part], where[part], piece[part]))
                        live[part] = False
                    sym, where, word, piece = sym[live], where[live], word[live], piece[live]
                    continue
                lead = np.concatenate(([True], word[hit][1:] != word[hit][:-1]))
                hit = hit[lead | ~self.risky[piece[hit]]]
            sym[hit] = piece[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.cumsum(keep) - 1
            fresh = new[hit]
            sym, where, word, piece = sym[keep], where[keep], word[keep], piece[keep]
            near = np.zeros(len(sym), bool)
            near[fresh] = True
            near[fresh[fresh > 0] - 1] = True
            touch = np.flatnonzero(near)
            last = len(sym) - 1
            inner = touch[touch < last]
            inner_ok = inner[word[inner] == word[inner + 1]]
            piece[touch] = -1
            piece[inner_ok] = self.merged(sym[inner_ok], sym[inner_ok + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words + 1, np.int64)
        word, sym, where = (np.concatenate(x) for x in zip(*done))
        by = np.argsort(word, kind="stable")
        word, sym, where = word[by], sym[by], where[by]
        lost = sym >= self.size
        if lost.any():
            count = np.ones(len(sym), np.int64)
            c = cp[where]
            if self.fallback:
                count[lost] = np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))[lost]
                raw = np.frombuffer(c[lost].astype("<u4").tobytes().decode("utf-32-le", "replace").encode(), np.uint8)
                out = np.repeat(sym, count)
                out[np.repeat(lost, count)] = self.byte_ids[raw]
                word = np.repeat(word, count)
                sym = out
            else:
                sym = np.where(lost, self.unknown, sym)
                keep = ~(lost & np.concatenate(([False], lost[:-1])) & np.concatenate(([False], word[1:] == word[:-1])))
                word, sym = word[keep], sym[keep]
        return sym.astype(np.int32), np.searchsorted(word, np.arange(n_words + 1))

    def _queued(self, word: np.ndarray, sym: np.ndarray, where: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, symbols, places) of one word merged to the end, the best and leftmost pair at a time."""
        if self.pair is None:
            used = self.keys >= 0
            self.pair = dict(zip(self.keys[used].tolist(), self.vals[used].tolist()))
        n, base = len(sym), self.n_symbols
        ranks, pair = self.rank.tolist(), self.pair
        s, best = sym.tolist(), np.where(piece >= 0, self.rank[piece], NONE)
        known = np.flatnonzero(best != NONE)
        first = (best[known].astype(np.int64) * n + known)
        first = np.sort(first).tolist()  # the pairs there are, in order; those to come go to a heap
        best, made = best.tolist(), piece.tolist()
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(b"\x01") * n
        heap: list[int] = []
        at, total = 0, len(first)
        while heap or at < total:
            if heap and (at == total or heap[0] < first[at]):
                rank, i = divmod(heappop(heap), n)
            else:
                rank, i = divmod(first[at], n)
                at += 1
            if not alive[i] or best[i] != rank:
                continue
            j = right[i]
            s[i], alive[j] = made[i], 0
            k = right[i] = right[j]
            if k < n:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                if a < 0 or b > n - 1:
                    if a >= 0:
                        best[a] = NONE
                    continue
                p = pair.get(s[a] * base + s[b])
                if p is None:
                    best[a] = NONE
                else:
                    best[a], made[a] = ranks[p], p
                    heappush(heap, ranks[p] * n + a)
        keep = np.flatnonzero(np.frombuffer(alive, np.uint8))
        return word[keep], np.array(s, np.int32)[keep], where[keep]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a run of texts."""
        cp, at = code_points(raw, offsets)
        cp = np.where(cp == 0x20, np.uint32(SPACE), cp)
        full = np.diff(at) > 0
        if self.dummy:
            cp = np.insert(cp, at[:-1][full], SPACE)
            at = at + np.concatenate(([0], np.cumsum(full)))
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = np.zeros(len(cp), bool)
        begin[at[:-1][full]] = True
        if self.split_words:
            mark = cp == SPACE
            begin[1:] |= mark[1:] & ~mark[:-1]
        start = np.append(np.flatnonzero(begin), len(cp))
        first, inverse = _distinct(cp, start)
        size = np.diff(start)[first]
        ids, off = self.merge_words(cp[_ranges(start[:-1][first], size)], np.concatenate(([0], np.cumsum(size))))
        n = np.diff(off)[inverse]
        flat = ids[_ranges(off[:-1][inverse], n)]
        total = np.concatenate(([0], np.cumsum(n)))
        return flat, total[np.searchsorted(start, at)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 texts of runs of ids."""
        size = np.diff(self.surface[1])[ids]
        flat = self.surface[0][_ranges(self.surface[1][:-1][ids], size)].tobytes()
        end = np.concatenate(([0], np.cumsum(size)))[offsets].tolist()
        out = []
        has_bytes = np.concatenate(([0], np.cumsum(self.is_byte[ids])))[offsets]
        for d in range(len(offsets) - 1):
            text = flat[end[d] : end[d + 1]]
            if self.dummy and text[:1] == b" ":
                i = offsets[d]
                while self.control[ids[i]]:
                    i += 1
                text = text[1:] if self.leads[ids[i]] else text
            if has_bytes[d + 1] > has_bytes[d]:
                try:
                    text.decode()
                except UnicodeDecodeError:
                    text = self._repaired(ids[offsets[d] : offsets[d + 1]])
            out.append(text)
        return out

    def _repaired(self, ids: np.ndarray) -> bytes:
        """The text of ids whose byte pieces aren't all valid UTF-8: each stray byte becomes U+FFFD."""
        out, run, lead = [], b"", self.dummy
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                lead = False
                run += self.surface[0][self.surface[1][i] : self.surface[1][i + 1]].tobytes()
                continue
            while run:
                for k in (4, 3, 2, 1):
                    try:
                        if len(run[:k].decode()) == 1:
                            break
                    except UnicodeDecodeError:
                        continue
                else:
                    k = 0
                out.append(run[:k] if k else "�".encode())
                run = run[max(k, 1) :]
            if i is not None:
                s = self.surface[0][self.surface[1][i] : self.surface[1][i + 1]].tobytes()
                out.append(s[1:] if lead and self.leads[i] else s)
                lead = lead and bool(self.control[i])
        return b"".join(out)


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + size[i] - 1 of all i."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


def _distinct(cp: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one of each distinct word, and each word's number among them. Words are told apart by a 64-bit hash; those of
    one hash are compared, and any that differ from the first are kept apart."""
    with np.errstate(over="ignore"):
        size = np.diff(start)
        spot = (np.arange(len(cp)) - np.repeat(start[:-1], size)).astype(np.uint64)
        h = np.add.reduceat(mix(cp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + spot * np.uint64(0xD1B54A32D192ED03)), start[:-1])
        h = mix(h + size.astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    model = first[inverse]
    same = size == size[model]
    shift = np.where(same, start[:-1][model] - start[:-1], 0)
    equal = cp[np.arange(len(cp)) + np.repeat(shift, size)] == cp
    if not equal.all():
        same &= np.logical_and.reduceat(equal, start[:-1])
    odd = np.flatnonzero(~same)
    if len(odd):
        inverse = inverse.copy()
        inverse[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, inverse


_MODELS: dict[str, PieceModel] = {}


def model_of(raw: bytes) -> PieceModel:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(raw)
    return _MODELS[key]


def encode(spark: SparkSession, docs: DataFrame, model_path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and ids array<int>."""

    def run(m, batch, raw, off):
        ids, sizes = [np.zeros(0, np.int32)], []
        for a, b in runs(off):
            i, o = m.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            ids.append(i)
            sizes.append(np.diff(o))
        o = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(o), pa.array(np.concatenate(ids)))]

    return _mapped(spark, docs, model_path, text_col, keep, "ids array<int>", run)


def decode(spark: SparkSession, docs: DataFrame, model_path: str, *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and text; null ids decode to the empty text."""
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("text string").fields])

    def run(batches):
        m = model_of(shared.value)
        for batch in batches:
            col = batch.column(len(keep)).fill_null([])
            off = np.asarray(col.offsets, np.int64)
            ids = np.asarray(col.values.slice(off[0], off[-1] - off[0]), np.int32) if len(col) else np.zeros(0, np.int32)
            out = [x.decode() for x in m.decode(ids, off - off[0])] if len(col) else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=schema.names)

    return docs.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


def digests(spark: SparkSession, docs: DataFrame, model_path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, decode the ids again and digest both: n_tokens, ids_sha256, decoded_sha256.

    The same `encode` and `decode` of the model as above, run by run, so that the ids of a batch
    need not travel between two Python stages."""

    def run(m, batch, raw, off):
        n, ids_sha, text_sha = [], [], []
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for a, b in runs(off):
            ids, o = m.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            size = np.diff(m.decimal[1])[ids]
            flat = m.decimal[0][_ranges(m.decimal[1][:-1][ids], size)].tobytes()
            end = np.concatenate(([0], np.cumsum(size)))[o].tolist()
            n.append(np.diff(o))
            ids_sha += [sha(flat[x : max(x, y - 1)]) for x, y in zip(end, end[1:])]
            text_sha += [sha(t) for t in m.decode(ids, o)]
        return [pa.array(np.concatenate([[], *n]).astype(np.int64)), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

    return _mapped(spark, docs, model_path, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", run)


def _mapped(spark, docs, model_path, text_col, keep, columns, run) -> DataFrame:
    ship(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the model file, of fixed size
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(columns).fields])

    def batches_of(batches):
        m = model_of(shared.value)
        for batch in batches:
            raw, off = column_bytes(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *run(m, batch, raw, off)], names=schema.names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(batches_of, schema)
