"""Alignment of two tokenizers over whole texts by interval coalescing.

Both tokenizers spell the same bytes, a space and the text.  All tokens of both
are sorted by their first byte, the running maximum of their ends is kept, and
a group breaks where a start reaches it; the tokens of a group overlap and are
linked each with each.  ``align`` returns what a document's groups come to,
``pair_counts`` how many documents hold each linked pair of ids.

Neither tokenizer merges over a single space between two words, so a text is a
chain of units that are spelled apart.  A block of texts spells and aligns each
of its distinct units once; a document is then a list of units.  Blocks, with
their distinct id pairs, are landed.  Only a block's distinct pairs are
shuffled, to be counted over the corpus and to come back to the block; a pair
that every block holds is one row of each block, and its join is split by the
skew handling of adaptive execution.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable, land

SPACE = "▁"
#: Where texts may be cut for both tokenizers: a single space between two words.
CUT = re.compile(r"(?<=[^ ]) (?=[^\s\u180e\u200b\ufeff])")
#: A space that is none of these; a text without one, and without a space at its ends, is cut at every space.
UNCUT = re.compile(r" [\s\u180e\u200b\ufeff]")
#: Characters of texts that make a block; memory is about 60 bytes for each, or for the longest text.
BLOCK = 2_500_000
#: Characters of units that are spelled as one text, such texts in one call, and rows that are expanded at once.
RUN, CALL, ROWS = 32_000, 6, 500_000
#: Fields of the landed blocks: a row per document, and one with the units and pairs of the block.
STATS = ["n_a", "n_b", "n_groups", "n_links"]
_SPELLERS: dict[str, Speller] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself, the n-th other byte as character 256 + n."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Speller:
    """Both tokenizers, the bytes of their entries, and how to write their ids."""

    def __init__(self, a_definition: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        from .token_counts import cuttable

        a = Tokenizer.from_str(a_definition)
        a.no_truncation()
        a.no_padding()
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte = byte_of_character()
        vocabulary = a.get_vocab(with_added_tokens=True)
        entries: list[bytes] = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            entries[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
        spelled = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sides = [
            (lambda texts: [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)], entries),
            (lambda texts: b.encode(texts, num_threads=1), spelled),
        ]
        self.lengths = [np.array([len(x) for x in entries], np.int64), np.array([len(x) for x in spelled], np.int64)]
        written = lambda n, sign: np.array([f"{i}{sign}" for i in range(n)], object)
        self.inner = [written(len(entries), ","), written(len(spelled), ",")]
        self.last = [written(len(entries), "|"), written(len(spelled), ";")]
        words_apart = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.cuttable = cuttable(a_definition) and words_apart and b.Normalize(" x  y ") == f"{SPACE}{SPACE}x{SPACE}{SPACE}y{SPACE}"

    def units(self, text: str) -> list[str]:
        if not self.cuttable:
            return [text]
        if text[:1] == " " or text[-1:] == " " or UNCUT.search(text):
            return CUT.split(text)
        return text.split(" ")

    def spell(self, side: int, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of units one after another, their number by unit, and whether they spell a space and the unit."""
        encode, entries = self.sides[side]
        alone = [not u or u[0].isspace() or u[-1] == " " or not self.cuttable for u in units]
        runs, size = [], RUN
        for i, lone in enumerate(alone):
            if lone or size >= RUN or alone[i - 1]:
                runs.append([i, i])
                size = 0
            runs[-1][1] = i + 1
            size += len(units[i]) + 1
        found, counts, good = [], np.zeros(len(units), np.int64), np.ones(len(units), bool)
        for at in range(0, len(runs), CALL):
            some = runs[at : at + CALL]
            for (lo, hi), ids in zip(some, encode([" ".join(units[lo:hi]) for lo, hi in some]), strict=True):
                raw = [u.encode() for u in units[lo:hi]]
                code = np.array(ids, np.int64)
                ends = np.cumsum(self.lengths[side][code])
                wanted = np.cumsum([1 + len(r) for r in raw])
                place = np.searchsorted(ends, wanted)
                same = len(ends) and ends[-1] == wanted[-1] and (ends[place] == wanted).all()
                if same and b"".join([entries[i] for i in ids]) == b" " + b" ".join(raw):
                    counts[lo:hi] = np.diff(place, prepend=-1)
                    found.append(code)
                elif hi - lo == 1:
                    good[lo] = False
                else:  # one of them is spelled as something else: each by itself
                    for i in range(lo, hi):
                        own = encode([units[i]])[0]
                        good[i] = b"".join([entries[j] for j in own]) == b" " + raw[i - lo]
                        if good[i]:
                            counts[i] = len(own)
                            found.append(np.array(own, np.int64))
        return (np.concatenate(found) if found else np.zeros(0, np.int64)), counts, good


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group numbers, from 0 and in order, of intervals that overlap or are linked by overlaps."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    opens = np.ones(len(order), bool)
    opens[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    return group


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(value[order], first) if len(first) else value


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct whole numbers from 0 on in order, by a sort: NumPy's own hash table takes several times as long."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[i] .. first[i] + size[i] - 1`` one after another."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)


def _slices(size: np.ndarray) -> Iterator[slice]:
    """Parts of about ``ROWS`` rows, at least one element each."""
    total, lo = np.cumsum(size), 0
    while lo < len(size):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + ROWS, side="right")))
        yield slice(lo, hi)
        lo = hi


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes each that hold the largest; the first byte is that number."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class Block:
    """Texts of a block as lists of distinct units, and what the units come to."""

    def __init__(self, texts: list[str], speller: Speller):
        index: dict[str, int] = {}
        docs = [[index.setdefault(u, len(index)) for u in speller.units(t)] if t else [] for t in texts]
        self._spell(list(index), speller)
        if not self.good.all():
            # Such a text as a whole: without cuts, and without tokens if it is spelled otherwise.
            spoilt = {d for d, codes in enumerate(docs) if codes and not self.good[codes].all()}
            index = {}
            docs = [[index.setdefault(u, len(index)) for u in ([t] if d in spoilt else speller.units(t))] if t else [] for d, t in enumerate(texts)]
            self._spell(list(index), speller)
            docs = [codes if not codes or self.good[codes].all() else [] for codes in docs]
        self.docs = docs
        self._pairs()
        self._holders()

    def _spell(self, units: list[str], speller: Speller) -> None:
        n = len(units)
        spelled = [speller.spell(side, units) for side in (0, 1)]
        self.good = spelled[0][2] & spelled[1][2]
        ids, unit = [], []
        for side, (code, counts, _) in enumerate(spelled):
            owner = np.repeat(np.arange(n), counts)
            stay = self.good[owner]
            ids.append(code[stay])
            unit.append(owner[stay])
        ends = [np.cumsum(speller.lengths[s][ids[s]]) for s in (0, 1)]
        starts = [e - speller.lengths[s][ids[s]] for s, e in enumerate(ends)]
        a = len(ids[0])
        group = coalesce(np.concatenate(starts), np.concatenate(ends))
        self.side = [(ids[0], group[:a]), (ids[1], group[a:])]
        self.n_groups = groups = int(group.max()) + 1 if len(group) else 0
        per_group = [np.bincount(g, minlength=groups) for _, g in self.side]
        self.unit_of_group = np.zeros(groups, np.int64)
        self.unit_of_group[self.side[0][1]] = unit[0]
        links = per_group[0] * per_group[1]
        by_unit = np.zeros(n, np.int64)
        np.add.at(by_unit, self.unit_of_group, links)
        self.stats = [np.bincount(unit[0], minlength=n), np.bincount(unit[1], minlength=n), np.bincount(self.unit_of_group, minlength=n), by_unit]
        # Written form: a group's A ids, then its B ids, each with the sign that follows it.
        order = np.lexsort((np.repeat([0, 1], [a, len(ids[1])]), group))
        shown = []
        for s, (code, g) in enumerate(self.side):
            closing = np.diff(g, append=-1) != 0
            shown.append(np.where(closing, speller.last[s][code], speller.inner[s][code]))
        parts = np.concatenate(shown)[order].tolist()
        edge = np.concatenate([[0], np.cumsum(self.stats[0] + self.stats[1])]).tolist()
        self.written = ["".join(parts[lo:hi]) for lo, hi in zip(edge, edge[1:], strict=False)]

    def _pairs(self) -> None:
        """Distinct linked id pairs of the block (``a``, ``b``) and of each unit, with their number there."""
        groups, distinct = self.n_groups, []
        for ids, group in self.side:
            key, times = np.unique(group << 32 | ids, return_counts=True)
            distinct.append((key >> 32, key & 0xFFFFFFFF, times))
        (ga, a, na), (gb, b, nb) = distinct
        partners = np.bincount(gb, minlength=groups)
        first = np.cumsum(partners) - partners
        size = partners[ga]
        codes, owners, numbers = [], [], []
        for part in _slices(size):
            left = np.repeat(np.arange(len(ga))[part], size[part])
            right = _ranges(first[ga[part]], size[part])
            codes.append(a[left] << 32 | b[right])
            owners.append(self.unit_of_group[ga[left]])
            numbers.append(na[left] * nb[right])
        none = np.zeros(0, np.int64)
        pair, place = np.unique(np.concatenate([none, *codes]), return_inverse=True)
        self.a, self.b = pair >> 32, pair & 0xFFFFFFFF
        width = max(1, len(pair))
        key, self.number = _summed(np.concatenate([none, *owners]) * width + place, np.concatenate([none, *numbers]))
        self.pair = key % width
        self.per_unit = np.bincount(key // width, minlength=len(self.good))

    def _holders(self) -> None:
        """How many documents hold each pair, and all documents' units one after another."""
        units = max(1, len(self.good))
        lengths = np.array([len(d) for d in self.docs], np.int64)
        flat = np.array([u for d in self.docs for u in d], np.int64)
        self.flat, self.lengths = flat, lengths
        held = _distinct(np.repeat(np.arange(len(lengths)), lengths) * units + flat)
        doc, unit = held // units, held % units
        distinct = np.bincount(doc, minlength=len(lengths))
        first = np.cumsum(self.per_unit) - self.per_unit
        size = self.per_unit[unit]
        width = max(1, len(self.a))
        self.n_docs = np.zeros(len(self.a), np.int64)
        # Documents are never torn, so that each counts once.
        edge = np.concatenate([[0], np.cumsum(distinct)])
        rows = np.concatenate([[0], np.cumsum(size)])[edge]
        for part in _slices(np.diff(rows)):
            some = slice(edge[part.start], edge[part.stop])
            keys = _distinct(np.repeat(doc[some], size[some]) * width + self.pair[_ranges(first[unit[some]], size[some])])
            self.n_docs += np.bincount(keys % width, minlength=len(self.a))

    def document_sums(self) -> list[np.ndarray]:
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        return [(t := np.concatenate([[0], np.cumsum(s[self.flat])]))[ends[1:]] - t[ends[:-1]] for s in self.stats]

    def unit_lists(self) -> Iterator[bytes]:
        """Each document's units in ascending order, packed as steps from one to the next."""
        ends = np.cumsum(self.lengths)
        for lo, hi in zip((ends - self.lengths).tolist(), ends.tolist(), strict=True):
            yield packed(np.diff(np.sort(self.flat[lo:hi]), prepend=0))

    def forms(self) -> Iterator[str]:
        for codes in self.docs:
            yield "".join([self.written[c] for c in codes])[:-1]


def _list(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values, kind))


def _landed_schema(key: T.DataType) -> T.StructType:
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    fields = [("block", T.LongType()), ("is_doc", T.BooleanType()), ("_key", key), *[(s, T.LongType()) for s in STATS]]
    fields += [("groups_sha256", T.StringType()), ("groups", T.StringType()), ("units", T.BinaryType())]
    # Of the row of a block: pairs by number, and the pairs of its units.
    fields += [("a", ints), ("b", ints), ("n_docs", longs), *[(n, T.BinaryType()) for n in ("sizes", "pairs", "numbers")]]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _rows(number: int, keys: list, block: Block, schema: pa.Schema, with_groups: bool) -> Iterator[pa.RecordBatch]:
    n, i32, i64 = len(keys), pa.int32(), pa.int64()
    forms = list(block.forms())
    columns = {
        "block": pa.array(np.full(n, number), i64),
        "is_doc": pa.array(np.ones(n, bool)),
        "_key": pa.array(keys, schema.field("_key").type),
        **{name: pa.array(s, i64) for name, s in zip(STATS, block.document_sums(), strict=True)},
        "groups_sha256": pa.array([hashlib.sha256(f.encode()).hexdigest() if f else "" for f in forms]),
        "units": pa.array(list(block.unit_lists()), pa.binary()),
    }
    if with_groups:
        columns["groups"] = pa.array(forms)
    one = lambda v, kind: _list(v, np.array([len(v)]), kind)
    whole = {
        "block": pa.array([number], i64), "is_doc": pa.array([False]), "a": one(block.a, i32), "b": one(block.b, i32),
        "n_docs": one(block.n_docs, i64), **{name: pa.array([packed(v)], pa.binary()) for name, v in (("sizes", block.per_unit), ("pairs", block.pair), ("numbers", block.number))},
    }
    for size, given in ((n, columns), (1, whole)):
        yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)


def _blocks(a_definition: str, b_model: bytes, schema: pa.Schema, with_groups: bool):
    name = hashlib.sha256(a_definition.encode() + b_model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SPELLERS:
            _SPELLERS[name] = Speller(a_definition, b_model)
        number, size, keys, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK:
                    yield from _rows(number, keys, Block(texts, _SPELLERS[name]), schema, with_groups)
                    number, size, keys, texts = number + 1, 0, [], []
        if keys:
            yield from _rows(number, keys, Block(texts, _SPELLERS[name]), schema, with_groups)

    return run


def spell(docs: DataFrame, a_definition: str, b_model: bytes, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """The landed blocks of ``docs``, which ``pair_counts`` and ``documents`` read."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    importable(spark)
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    schema = _landed_schema(rows.schema["_key"].dataType)
    return land(rows.mapInArrow(_blocks(a_definition, b_model, to_arrow_schema(schema), with_groups), schema))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``a, b, count, is_best``: documents that hold the id pair linked, and whether no partner of ``a`` has more."""
    held = blocks.where("not is_doc").select(F.inline(F.arrays_zip("a", "b", "n_docs")))
    counts = land(held.groupBy("a", "b").agg(F.sum("n_docs").alias("count")))
    most = counts.groupBy(F.col("a").alias("_a")).agg(F.max("count").alias("_most"))
    return counts.join(most, F.col("a") == F.col("_a")).select("a", "b", "count", (F.col("count") == F.col("_most")).alias("is_best"))


def _sums(key_type: pa.DataType):
    schema = pa.schema([("_key", key_type), *[(s, pa.int64()) for s in [*STATS, "n_best", "count_sum"]], ("groups_sha256", pa.string()), ("groups", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        whole = left.filter(pa.compute.invert(left["is_doc"]))
        rows = left.filter(left["is_doc"])
        sizes, pairs, numbers = (unpacked(whole[c][0].as_py()) for c in ("sizes", "pairs", "numbers"))
        place = right["place"].to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        lists = [np.cumsum(unpacked(u.as_py())) for u in rows["units"]]
        units = np.concatenate([np.zeros(0, np.int64), *lists])
        ends = np.concatenate([[0], np.cumsum([len(u) for u in lists])]).astype(np.int64)
        sums = []
        for name in ("is_best", "count"):
            of_pair = np.zeros(len(place), np.int64)
            of_pair[place] = right[name].to_numpy().astype(np.int64)
            of_unit = np.zeros(len(sizes), np.int64)
            np.add.at(of_unit, owner, of_pair[pairs] * numbers)
            running = np.concatenate([[0], np.cumsum(of_unit[units])])
            sums.append(pa.array(running[ends[1:]] - running[ends[:-1]], pa.int64()))
        columns = [rows["_key"], *[rows[s] for s in STATS], *sums, rows["groups_sha256"], rows["groups"]]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def documents(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per document: ``_key``, its figures, and the sums over its links of what ``counts`` says of their pairs."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = blocks.schema["_key"].dataType
    held = blocks.where("not is_doc").select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "p"))
    held = held.select(F.col("block").alias("home"), "place", F.col("p.a").alias("_a"), F.col("p.b").alias("_b"))
    known = held.join(counts, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b"))).select("home", "place", "count", "is_best")
    rows = blocks.drop("a", "b", "n_docs")
    fields = [("_key", key), *[(s, T.LongType()) for s in [*STATS, "n_best", "count_sum"]], ("groups_sha256", T.StringType()), ("groups", T.StringType())]
    out = T.StructType([T.StructField(n, t) for n, t in fields])
    return rows.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(_sums(to_arrow_type(key)), out)


def align(docs: DataFrame, a_definition: str, b_model: bytes, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Alignment of a byte-level tokenizer ``a`` and a piece model ``b``, one row per input row.

    Returns ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, if asked for, ``groups``: ids
    as ``a1,a2|b1;a3|b2,b3``.  ``n_links`` counts the A-B token pairs of all groups; a pair of ids counts the documents
    that hold it linked; ``n_best`` are links whose count is the highest of their A id (ties too), ``count_sum`` sums
    the counts over the links.  Missing and empty texts, and texts that a tokenizer spells otherwise, have no tokens:
    zeros and ''.  Repeated rows and missing keys are documents of their own; other columns are not returned, whatever
    their names.  An empty table gives an empty one.
    """
    blocks = spell(docs, a_definition, b_model, key, text, with_groups)
    found = documents(blocks, pair_counts(blocks)).withColumnRenamed("_key", key)
    return found if with_groups else found.drop("groups")
