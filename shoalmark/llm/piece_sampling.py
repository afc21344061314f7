"""SentencePiece encoding by sampling without replacement, and decoding.

The segmentations of a text are the paths of a lattice of pieces.  Every path
has a probability, the product of its pieces' probabilities, normalised over the
lattice.  Adding Gumbel noise to the logarithms and taking the k largest sums
draws k different paths without replacement.  The search is top-down: a set of
paths - a prefix, and some next pieces ruled out - has a largest perturbed value
that can be drawn from the set's total alone.  The set with the largest value is
opened: its best path is drawn piece by piece, and what else is in it falls
apart into one smaller set per piece, with values below.  Since a set's value is
the exact maximum of what it holds, paths leave the queue in their right order.

Pieces hold the mark of a space only in front, so the lattice is a chain of
units (marks, then letters) and the totals are computed once per distinct unit
of a chunk of texts, for all of them together.  All random numbers are hashes of
the row's key, the seed and the place, so a result depends on neither partitions
nor retries.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import importable

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Characters of texts that are worked on together; memory is about 200 bytes for each, or for the longest text.
CHUNK = 300_000
#: Slots, as a power of two, for what a vocabulary holds of one length.
SEEN_BITS = 18
_U = np.uint64
_STEP = _U(0x100000001B3)
_MODELS: dict[str, Pieces] = {}
ROWS = "_key {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"


class Pieces:
    """A model's pieces with log-probabilities, by length and hash."""

    def __init__(self, model: bytes, alpha: float = 1.0):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        self.bytes: list[bytes] = [b""] * size
        self.byte_id = np.full(256, -1, np.int64)
        plain, score = [], np.array([sp.get_score(i) for i in range(size)])
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError("a piece runs over the start of a word; units would not be independent")
                plain.append(i)
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces to fall back on")
        self.log_p = np.full(size, -np.inf)
        every = plain + self.byte_id.tolist()
        # Scores of merge-based models are negative ranks: pieces get the share that Zipf's law gives their rank.
        order = sorted(every, key=lambda i: (sp.is_byte(i), -score[i], i))
        rank = np.arange(1, len(order) + 1)
        self.log_p[order] = alpha * -np.log(rank * (1.0 / rank).sum())
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: By length: slots of hashes of whole pieces (True) and of longer pieces' beginnings (False).  A slot that is
        #: not set rules a string out at the cost of one look.
        self.seen: dict[tuple[int, bool], np.ndarray] = {}
        for n in sorted({len(sp.id_to_piece(i)) for i in plain}):
            ids = np.array([i for i in plain if len(sp.id_to_piece(i)) == n])
            code = np.array([np.frombuffer(sp.id_to_piece(i).encode("utf-32-le"), np.uint32) for i in ids]).astype(np.uint64)
            h = _rolled(code.T)
            by = np.argsort(h)
            self.by_length[n] = h[by], ids[by]
            for k in range(1, n + 1):
                # Hashes of beginnings are those of the first k characters.
                table = self.seen.setdefault((k, k == n), np.zeros(1 << SEEN_BITS, bool))
                table[_slot(h if k == n else _rolled(code.T[:k]))] = True
        self.longest = max(self.by_length)

    def normalised(self, text: str) -> str:
        return self.sp.Normalize(text) if text else ""


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SEEN_BITS)).astype(np.int64)


def _rolled(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c + _U(1)) * _STEP
        h ^= h >> _U(29)
    return h


def units_of(text: str) -> list[str]:
    """What ``UNIT`` finds: words with the spaces before them, and spaces at the end."""
    if SPACE * 2 in text or text.endswith(SPACE):
        return UNIT.findall(text)
    first, *words = text.split(SPACE)
    found = [SPACE + w for w in words]
    return [first, *found] if first else found


class Lattice:
    """Edges and totals of distinct units: a state per character, the edges of a state together, longest first."""

    def __init__(self, units: list[str], pieces: Pieces):
        self.pieces = pieces
        code = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        lengths = np.array([len(u) for u in units], np.int64)
        self.start = np.cumsum(lengths) - lengths
        n = len(code)
        left = np.repeat(self.start + lengths, lengths) - np.arange(n)  # characters to the end of the unit
        h, at = np.zeros(n, np.uint64), np.arange(n)
        bare = np.ones(n, bool)
        found = []
        for k in range(1, pieces.longest + 1):
            if k > 1:
                stay = left[at] >= k
                at, h = at[stay], h[stay]
            h = (h + code[at + (k - 1)] + _U(1)) * _STEP
            h ^= h >> _U(29)
            slot = _slot(h)
            if k in pieces.by_length and len(at):
                keys, ids = pieces.by_length[k]
                maybe = np.nonzero(pieces.seen[k, True][slot])[0]
                i = np.searchsorted(keys, h[maybe])
                i[i == len(keys)] = 0
                same = keys[i] == h[maybe]
                hit, i = maybe[same], i[same]
                found.append((at[hit], np.full(len(hit), k), ids[i], pieces.log_p[ids[i]]))
                if k == 1:
                    bare[at[hit]] = False
            if (k, False) not in pieces.seen:
                break
            # On from where some longer piece begins like this.
            on = pieces.seen[k, False][slot]
            at, h = at[on], h[on]
        # A character that is no piece is its UTF-8 bytes; their number stands, negative, for the piece.
        lone = np.nonzero(bare)[0]
        wide = 1 + (code[lone] >= 0x80).astype(np.int64) + (code[lone] >= 0x800) + (code[lone] >= 0x10000)
        found.insert(0, (lone, np.ones(len(lone), np.int64), -wide, wide * float(pieces.log_p[pieces.byte_id].mean())))
        # Ends first: a state's total needs those nearer to the end of its unit.
        order = np.argsort(left.astype(np.uint16) if not n or left.max() < 1 << 16 else left, kind="stable")
        self.degree = sum((np.bincount(f[0], minlength=n) for f in found), np.zeros(n, np.int64))
        ends = np.cumsum(self.degree[order])
        count = int(ends[-1]) if n else 0
        self.first = np.empty(n, np.int64)
        self.first[order] = ends - self.degree[order]
        state, self.size, self.piece = (np.empty(count, np.int64) for _ in range(3))
        value, slot = np.empty(count), self.first.copy()
        for states, size, ids, log_p in reversed(found):
            here = slot[states]
            state[here], self.size[here], self.piece[here], value[here] = states, size, ids, log_p
            slot[states] += 1
        self.state, self.code = state, code
        self.next = np.where(left[state] > self.size, state + self.size, -1)
        total = np.zeros(n + 1)
        cuts = np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            s = order[lo:hi]
            e = slice(self.first[s[0]], ends[hi - 1])
            begin = self.first[s] - e.start
            v = value[e] + total[self.next[e]]  # the last place of total, for ends, is 0
            top = np.maximum.reduceat(v, begin)
            total[s] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, self.degree[s])), begin))
        #: Log-probability of an edge among those of its state, and the share of it and those before.
        self.log_share = np.minimum(value + total[self.next] - total[state], 0.0)
        run = np.cumsum(np.exp(self.log_share))
        self.upto = run - np.concatenate(([0.0], run))[self.first[state]]
        self.upto[self.first + self.degree - 1] = 2.0

    def draw(self, state: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk every state to the end of its unit: ``(edges, edges per walk)``, walks one after the other."""
        who, steps, t = np.arange(len(state)), [], 0
        count = np.zeros(len(seed), np.int64)
        while len(who):
            u = sh.unit(sh.mix(seed[who] + sh.salt(t + 1)))
            edge = self.first[state]
            open_ = np.nonzero(self.upto[edge] <= u)[0]
            while len(open_):
                edge[open_] += 1
                open_ = open_[self.upto[edge[open_]] <= u[open_]]
            steps.append((who, edge))
            count[who] += 1
            state = self.next[edge]
            go = np.nonzero(state >= 0)[0]
            who, state = who[go], state[go]
            t += 1
        first = np.cumsum(count) - count
        edges = np.empty(count.sum(), np.int64)
        for t, (w, e) in enumerate(steps):
            edges[first[w] + t] = e
        return edges, count

    def ids(self, edges: np.ndarray) -> np.ndarray:
        out = self.piece[edges]
        bare = np.nonzero(out < 0)[0]
        if not len(bare):
            return out
        raw = [chr(int(c)).encode("utf-8", "surrogatepass") for c in self.code[self.state[edges[bare]]]]
        fill = self.pieces.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        widths = np.ones(len(out), np.int64)
        widths[bare] = [len(r) for r in raw]
        spread = np.repeat(out, widths)
        spread[spread < 0] = fill
        return spread


def _below(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values with location ``phi``, given that they are below ``top``."""
    with np.errstate(over="ignore"):
        return phi - np.log(np.exp(phi - top) - np.log(u))


class _Row:
    """One text's search: its samples so far and the queue of open sets."""

    def __init__(self, key, units: np.ndarray, seed: int):
        self.key, self.units, self.seed, self.queue, self.samples = key, units, seed, [], []

    def add(self, lattice: Lattice, value: float, edges: np.ndarray, unit: np.ndarray, fresh: int, ruled_out: tuple, k: int):
        """A new path whose edges before ``fresh`` are its parent's; ``ruled_out`` are the edges not taken there."""
        number = len(self.samples)
        share = lattice.log_share[edges]
        before = np.cumsum(share)
        log_prob = float(before[-1])
        before -= share
        self.samples.append((value, log_prob, edges, unit))
        beside = -np.expm1(share[fresh:])
        if ruled_out:
            beside[0] -= np.exp(lattice.log_share[list(ruled_out)]).sum()
        # A state with one way on leaves nothing beside it, whatever rounding says.
        open_ = np.nonzero(beside > 1e-12)[0]
        phi = before[fresh:][open_] + np.log(beside[open_])
        base = sh.mix(np.array([self.seed], np.uint64) + sh.salt(2 * number + 1))
        g = _below(phi, value, sh.unit(sh.mix(base + (open_ + fresh).astype(np.uint64) * sh.salt(3))))
        best = np.argpartition(-g, k)[: k + 1] if len(g) > k + 1 else np.arange(len(g))
        for b in best.tolist():
            place = int(open_[b])
            out = (*(ruled_out if place == 0 else ()), int(edges[fresh + place]))
            heapq.heappush(self.queue, (-float(g[b]), number, fresh + place, out))


def _search(rows: list[_Row], lattice: Lattice, k: int) -> None:
    """Up to ``k`` samples for each row, drawn for all rows together."""
    none = np.empty(0, np.int64)
    filled, jobs = [r for r in rows if len(r.units)], []
    for r in rows:
        if len(r.units):
            u = float(sh.unit(sh.mix(np.array([r.seed], np.uint64)))[0])
            jobs.append((r, -math.log(-math.log(u)), none, none, 0, None, ()))
        else:
            r.samples.append((0.0, 0.0, none, none))
    for number in range(k):
        if not jobs:
            break
        starts, seeds, owners = [], [], []
        for r, _, _, _, unit, state, _ in jobs:
            rest = np.arange(unit, len(r.units))
            at = lattice.start[r.units[rest]]
            if state is not None:  # None: from the unit's start; -1: the unit is done
                rest, at = (rest[1:], at[1:]) if state < 0 else (rest, np.concatenate(([state], at[1:])))
            starts.append(at)
            seeds.append(np.full(len(rest), r.seed, np.uint64))
            owners.append(rest)
        place = np.concatenate(owners)
        base = sh.mix(np.concatenate(seeds) + sh.salt(2 * number + 2))
        edges, count = lattice.draw(np.concatenate(starts), sh.mix(base + place.astype(np.uint64) * sh.salt(5)))
        ends, units, walk = np.concatenate(([0], np.cumsum(count))), np.repeat(place, count), 0
        for (r, value, old, old_unit, _, _, ruled_out), rest in zip(jobs, owners):
            lo, hi = ends[walk], ends[walk + len(rest)]
            walk += len(rest)
            path = (np.concatenate((old, edges[lo:hi])), np.concatenate((old_unit, units[lo:hi])))
            r.add(lattice, value, *path, max(0, len(old) - 1), ruled_out, k)
        jobs = [_opened(r, lattice, number + 1) for r in filled if r.queue] if number + 1 < k else []


def _opened(r: _Row, lattice: Lattice, number: int) -> tuple:
    """Take the set with the largest value off the queue and draw its first edge."""
    value, parent, place, out = heapq.heappop(r.queue)
    _, _, edges, unit = r.samples[parent]
    state = lattice.state[edges[place]]
    choice = np.arange(lattice.first[state], lattice.first[state] + lattice.degree[state])
    choice = choice[~np.isin(choice, out)]
    p = np.cumsum(np.exp(lattice.log_share[choice]))
    u = float(sh.unit(sh.mix(np.array([r.seed], np.uint64) + sh.salt(1_000_003 + number)))[0])
    edge = int(choice[min(int(np.searchsorted(p, u * p[-1], side="right")), len(choice) - 1)])
    return r, -value, np.append(edges[:place], edge), unit[: place + 1], int(unit[place]), int(lattice.next[edge]), out


def _log_inclusion(log_prob: float, threshold: float) -> float:
    """Logarithm of the chance that a path's perturbed value is above the threshold."""
    x = log_prob - threshold
    if x > 30:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


def sample_texts(keys: list, texts: list[str | None], pieces: Pieces, k: int, seed: int) -> Iterator[tuple]:
    """``(key, sample, ids, log_prob, perturbed, log_inclusion)`` of each text's samples, texts in turn."""
    at = 0
    while at < len(texts):
        units: dict[str, int] = {}
        rows, held = [], 0
        while at < len(texts) and held < CHUNK:
            text = pieces.normalised(texts[at] or "")
            found = units_of(text)
            for u in found:
                if u not in units:
                    units[u] = len(units)
            held += len(text)
            name = b"none" if keys[at] is None else str(keys[at]).encode()
            rows.append(_Row(keys[at], np.fromiter(map(units.__getitem__, found), np.int64, len(found)), xxhash.xxh3_64_intdigest(name, seed)))
            at += 1
        lattice = Lattice(list(units), pieces)
        _search(rows, lattice, k)
        for r in rows:
            threshold = -r.queue[0][0] if r.queue else -math.inf
            for i, (value, log_prob, edges, _) in enumerate(r.samples):
                ids = lattice.ids(edges)
                yield r.key, i + 1, ids, log_prob, value, 0.0 if threshold == -math.inf else _log_inclusion(log_prob, threshold)


def _pieces(name: str, model: bytes, alpha: float) -> Pieces:
    if name not in _MODELS:
        _MODELS[name] = Pieces(model, alpha)
    return _MODELS[name]


def _sampler(model: bytes, k: int, seed: int, alpha: float, key_type: pa.DataType, with_digest: bool):
    name = f"{xxhash.xxh3_128_hexdigest(model)} {alpha}"

    def rows_of(found: list) -> pa.RecordBatch:
        sizes = np.concatenate(([0], np.cumsum([len(f[2]) for f in found])))
        flat = np.concatenate([f[2] for f in found]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))
        key, number, _, *figures = zip(*found)
        cols = [pa.array(key, key_type), pa.array(number, pa.int32()), lists, *(pa.array(f, pa.float64()) for f in figures)]
        names = ["_key", "sample", "ids", "log_prob", "perturbed", "log_inclusion"]
        if with_digest:
            table = _pieces(name, model, alpha).bytes
            cols.append(pa.array([zlib.crc32(decoded(f[2], table)) for f in found], pa.int64()))
            names.append("decoded_crc32")
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(name, model, alpha)
        for batch in batches:
            found, held = [], 0
            for f in sample_texts(batch.column("_key").to_pylist(), batch.column("_text").to_pylist(), pieces, k, seed):
                found.append(f)
                held += len(f[2])
                if held >= CHUNK:
                    yield rows_of(found)
                    found, held = [], 0
            if found:
                yield rows_of(found)

    return run


def decoded(ids: np.ndarray, table: list[bytes]) -> bytes:
    """Text of a list of pieces, without the space the encoder puts in front."""
    return b"".join([table[i] for i in ids.tolist()]).removeprefix(b" ")


def encode(
    docs: DataFrame, model: bytes, k: int = 2, seed: int = 0, alpha: float = 1.0, key: str = "doc_id", text: str = "text", digest: bool = False
) -> DataFrame:
    """``key, sample, ids, log_prob, perturbed, log_inclusion``: up to ``k`` different segmentations of every text.

    Samples are numbered from 1 by falling perturbed value; ``log_inclusion`` is the logarithm of the chance that a
    path enters the sample given the first value left out, so ``exp(log_prob - log_inclusion)`` weighs it without bias.
    A text with fewer segmentations gives all of them, with ``log_inclusion`` 0.  Missing and empty texts have one
    segmentation, without pieces.  Rows with the same key and text, missing keys among them, get the same samples.
    ``alpha`` sharpens (above 1) or flattens the distribution.  With ``digest``, ``decoded_crc32`` is that of the
    decoded UTF-8 text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    importable(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = ROWS.format(kind=kind.simpleString()) + (", decoded_crc32 long" if digest else "")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(_sampler(model, k, seed, alpha, to_arrow_type(kind), digest), schema).withColumnRenamed("_key", key)


def decode(encoded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``text``: its pieces put together.  A missing list gives a missing text."""
    importable(encoded.sparkSession)
    name = f"{xxhash.xxh3_128_hexdigest(model)} 1.0"
    kept = [c for c in encoded.columns if c != "text"]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(name, model, 1.0).bytes
        for batch in batches:
            texts = [None if x is None else decoded(np.array(x, np.int64), table).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return rows.mapInArrow(run, rows.withColumn("text", F.lit("")).schema)
