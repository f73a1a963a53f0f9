"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` bytes, learned from the whole
training text. A byte is coded in the longest context of the trie that it follows;
if it was not seen there, an escape is coded and the next shorter context is asked,
in which all bytes seen in the longer one are excluded. Below the empty context all
bytes left are equally likely. Escapes are estimated as in method D: each of the
different bytes of a context gives half an occurrence to the escape. A text ends with a symbol of its own, a byte that UTF-8 never has,
so probabilities of all texts sum to one.

The model is in parts, by the three bytes before the last one of a sequence, so a part
has all sequences of its contexts of three bytes and more, and Spark deals the parts to
tasks. Shorter contexts are few, whatever the text, and every part gets them. Runs of
rows ask each part for their different sequences of ``ORDER + 1`` symbols, with their
counts in texts that are learned from; a part adds them up and tells each run the code
lengths, in the order in which it was asked. A sequence crosses the network once for each
run that has it, not for each text. Every counted sequence is in the model.

The base score is that of single words with one added to every count; words are asked
for and told in the same way.

Words are told apart by 64 bits of hashes. Defined cases: a null or empty text is its
end symbol only, a null id is not held out; every row of a repeated document counts
and is scored; without training rows all symbols are equally likely and the base
score is 0.
"""

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.storage import stage
from . import words
from .quality import remainder

ORDER = 7
#: Symbols of a training text of which ``train`` keeps a model in memory.
SHARE = 1 << 21
#: Bytes of text of a run of rows, which is counted and scored at once; short sequences that
#: are counted at once; parts of the model, at least, and bytes of text for each part beyond that.
RUN_SYMBOLS = 14_000_000
RUN_PENDING = 6_000_000
PARTS = 24
PART_BYTES = 1 << 23
#: Symbols of which a task counts the sequences at once, and different sequences or
#: words that it holds before it hands on their counts.
COUNT_SYMBOLS = 1_500_000
COUNT_KEYS = 4_000_000
END = 0xFF
SYMBOLS = 256
_BITS = 8
#: Stands for the end of a text among the words.
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D0)

_GRAM, _WORD = 0, 1


def _mask(symbols: int) -> int:
    return (1 << _BITS * symbols) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sequences(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte and each end of the texts of a block: the ``order`` symbols
    before it and itself, the last one lowest. Before a text there are end symbols."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    gap = order + 1
    doc = np.repeat(np.arange(n), size)
    symbols = np.full(len(data) + n * gap, END, np.uint64)
    symbols[np.arange(len(data)) + doc * gap + order] = data
    grams = symbols[order:].copy()
    for j in range(1, order + 1):
        grams |= symbols[order - j : len(symbols) - j] << np.uint64(_BITS * j)
    # The last symbols before the next text belong to no text.
    mine = np.ones(len(grams), bool)
    starts = offsets[1:-1] + np.arange(1, n) * gap
    for j in range(1, order + 1):
        mine[starts - j] = False
    return grams[mine]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and where texts begin."""
    hashes, at = words.word_hashes(data, offsets)
    n = len(offsets) - 1
    return np.insert(hashes, at[1:], END_WORD), at + np.arange(n + 1)


class Tally:
    """Counts of 64-bit keys, added in pieces."""

    def __init__(self):
        self.new: list[np.ndarray] = []
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self) -> None:
        if self.new:
            keys, n = np.unique(np.concatenate(self.new), return_counts=True)
            self.new.clear()
            at, held = _places(self.keys, keys)
            self.n[at[held]] += n[held]
            keys, n = keys[~held], n[~held]
            at = np.searchsorted(self.keys, keys)
            self.keys, self.n = np.insert(self.keys, at, keys), np.insert(self.n, at, n)

    def batches(self, kind: int):
        self.merge()
        step = 100_000
        for k in range(0, len(self.keys), step):
            some = self.keys[k : k + step].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), kind, np.int32)),
                    pa.array(some),
                    pa.array(self.n[k : k + step]),
                ],
                names=["kind", "key", "n"],
            )
        self.__init__()


def _counted(order: int):
    def count(batches):
        tallies = {_GRAM: Tally(), _WORD: Tally()}
        held = 0
        for batch in batches:
            for _, _, data, offsets in words.blocks(batch.column(0)):
                tallies[_GRAM].new.append(sequences(data, offsets, order))
                tallies[_WORD].new.append(_tokens(data, offsets)[0])
                held += len(tallies[_GRAM].new[-1])
                if held >= COUNT_SYMBOLS:
                    held = 0
                    for kind, tally in tallies.items():
                        tally.merge()
                        if len(tally.keys) > COUNT_KEYS:
                            yield from tally.batches(kind)
        for kind, tally in tallies.items():
            yield from tally.batches(kind)

    return count


def gather(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``kind, key, n``: how often each sequence of symbols and each word occurs."""
    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _counted(order), "kind int, key long, n long"
    )
    # Tasks have combined what is equal; to do so again would fill their memory and disk.
    parts = parts.repartition("kind", "key")
    return stage(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ppm_counts")


#: Marks a free slot; 0xFE is in no text.
_FREE = np.uint64(0xFEFEFEFEFEFEFEFE)


class Hashed:
    """Values of 64-bit keys, found by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = 63 - max(int(len(keys)).bit_length(), 4)
        size = 1 << (64 - self.shift)
        self.keys = np.full(size, _FREE)
        self.values = np.zeros(size, values.dtype)
        left = np.arange(len(keys))
        at = self.slots(keys)
        while len(left):
            free = self.keys[at] == _FREE
            self.keys[at[free]] = keys[left[free]]  # of several, the last one stays
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & (size - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        spread = keys * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(self.shift)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, and whether it is there."""
        at = self.slots(keys)
        have = self.keys[at]
        found = have == keys
        values = self.values[at]
        open_ = np.flatnonzero(~found & (have != _FREE))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            have = self.keys[at]
            same = have == keys[open_]
            values[open_[same]] = self.values[at[same]]
            found[open_[same]] = True
            rest = ~same & (have != _FREE)
            open_, at = open_[rest], at[rest]
        values[~found] = 0
        return values, found


class Trie:
    """The model: for each order the kept sequences and the contexts that have some.

    ``kept[k]`` are sequences of ``k + 1`` symbols and their counts, ``totals[k]``
    all contexts of ``k`` symbols and their counts, both sorted.
    """

    def __init__(self, kept, totals):
        self.order = len(kept) - 1
        self.grams = [g for g, _ in kept]
        self.log_n = [np.log10(2 * n - 1) for _, n in kept]
        self.contexts, first_den, first_esc, next_den, next_esc = [], [], [], [], []
        total_of, sum_of, kinds_of = [], [], []
        for k, (grams, n) in enumerate(kept):
            context, start, kinds = np.unique(grams >> _BITS, return_index=True, return_counts=True)
            kept_sum = np.add.reduceat(n, start) if len(n) else n
            keys, counts = totals[k]
            total = counts[np.searchsorted(keys, context)] if len(context) else kept_sum
            self.contexts.append(context)
            first_den.append(np.log10(2 * total))
            first_esc.append(_log(kinds + 2 * (total - kept_sum)) - first_den[-1])
            total_of.append(total)
            sum_of.append(kept_sum)
            kinds_of.append(kinds)
            if not k or not len(context):
                next_den.append(np.zeros(len(context)))
                next_esc.append(np.zeros(len(context)))
                continue
            # The shorter context, without what was seen in this one.
            below = np.searchsorted(self.contexts[k - 1], context & _mask(k - 1))
            same = np.searchsorted(kept[k - 1][0], grams & _mask(k))
            excluded = np.add.reduceat(kept[k - 1][1][same], start)
            new = kinds_of[k - 1][below] - kinds
            pruned = total_of[k - 1][below] - sum_of[k - 1][below]
            den = 2 * (sum_of[k - 1][below] - excluded + pruned)
            next_den.append(_log(den))
            next_esc.append(np.where(den > 0, _log(new + 2 * pruned) - _log(den), 0.0))
        self.first = list(zip(first_den, first_esc))
        self.next = list(zip(next_den, next_esc))
        seen = kinds_of[0].sum() if len(kinds_of[0]) else 0
        self.uniform = -np.log10(max(SYMBOLS - seen, 1))
        top = self.grams[-1]
        at = np.searchsorted(self.contexts[-1], top >> _BITS)
        self.table = Hashed(top, self.log_n[-1] - first_den[-1][at])

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """``log10`` of the probability of the last symbol of each sequence after
        the others."""
        out, found = self.table.find(grams)
        rest = np.flatnonzero(~found)
        if len(rest):
            different, back = np.unique(grams[rest], return_inverse=True)
            out[rest] = self._descend(different)[back]
        return out

    def _descend(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        left = np.arange(len(grams))  # not coded yet
        longer = np.full(len(grams), -1)  # their last context that was asked
        for k in range(self.order, -1, -1):
            context, there = _places(self.contexts[k], (grams[left] >> _BITS) & _mask(k))
            gram, coded = _places(self.grams[k], grams[left] & _mask(k + 1))
            den, esc = (a[context] for a in self.first[k]) if len(self.contexts[k]) else (0, 0)
            if k < self.order and len(self.contexts[k + 1]):
                again = longer[left] >= 0
                for_longer = np.maximum(longer[left], 0)
                den = np.where(again, self.next[k + 1][0][for_longer], den)
                esc = np.where(again, self.next[k + 1][1][for_longer], esc)
            coded &= there
            if len(self.grams[k]):
                out[left] += np.where(coded, self.log_n[k][gram] - den, np.where(there, esc, 0.0))
            longer[left] = np.where(there, context, -1)
            left = left[~coded]
        out[left] += self.uniform
        return out

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``log_probability``, which is there for every sequence."""
        return self.log_probability(grams), np.ones(len(grams), bool)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ``log10`` probability of each text of a block."""
        values = self.log_probability(sequences(data, offsets, self.order))
        return np.add.reduceat(values, offsets[:-1] + np.arange(len(offsets) - 1))


def _log(x: np.ndarray) -> np.ndarray:
    """``log10``, and 0 for 0: such a value is never used."""
    return np.log10(np.maximum(x, 1))


def _places(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _sorted_columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns sorted by their values, keys as unsigned numbers."""
    table = df.select(*names).toArrow()
    columns = [table[c].to_numpy() for c in names]
    columns = [
        x.view(np.uint64) if c in ("key", "gram", "context") else x
        for c, x in zip(names, columns)
    ]
    order = np.lexsort(columns[::-1])
    return [c[order] for c in columns]


def _levels(counts: DataFrame, order: int) -> list[DataFrame]:
    """``gram, n`` for each order: gathered counts of the longest sequences, and of
    shorter ones step by step."""
    level = counts.filter(F.col("kind") == _GRAM).select(F.col("key").alias("gram"), "n")
    levels = [level]
    for k in range(order, 0, -1):  # without the first symbol
        shorter = F.col("gram").bitwiseAND(F.lit(_signed(_mask(k)))).alias("gram")
        level = level.select(shorter, "n").groupBy("gram").agg(F.sum("n").alias("n"))
        level = stage(level, "ppm_sequences")
        levels.insert(0, level)
    return levels


def _total(counts: DataFrame) -> int:
    grams = counts.filter(F.col("kind") == _GRAM)
    return grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _context(k: int = 7):
    """The ``k`` symbols before the last one."""
    return F.shiftrightunsigned("gram", _BITS).bitwiseAND(F.lit(_mask(k))).alias("context")


def train(counts: DataFrame, order: int = ORDER, share: int = SHARE) -> Trie:
    """The trie of gathered counts in memory, which has every sequence. A text of more
    than ``share`` symbols is an error: ``score_documents`` keeps its model in tables."""
    total = _total(counts)
    if total > share:
        raise ValueError(f"{total} symbols are more than a model in memory may have")
    kept, totals = [], []
    for level in _levels(counts, order):
        kept.append(_sorted_columns(level, "gram", "n"))
        contexts = level.groupBy(_context()).agg(F.sum("n").alias("n"))
        totals.append(_sorted_columns(contexts, "context", "n"))
    return Trie(kept, totals)


def _shorter(grams: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of ``k + 1`` symbols and their counts, sorted, from those of longer ones."""
    keys, back = np.unique(grams & np.uint64(_mask(k + 1)), return_inverse=True)
    return keys, np.bincount(back, n, len(keys)).astype(np.int64)


def _below(grams: np.ndarray, n: np.ndarray, order: int, last: int) -> list:
    """Sorted sequences and counts of the orders from ``last`` to ``order``, of which the
    longest are given."""
    out = [(grams, n)]
    for k in range(order - 1, last - 1, -1):
        out.insert(0, _shorter(*out[0], k))
    return out


def _contexts(kept: list) -> list:
    """The contexts of each order and their counts."""
    out = []
    for grams, n in kept:
        keys, back = np.unique(grams >> np.uint64(_BITS), return_inverse=True)
        out.append((keys, np.bincount(back, n, len(keys)).astype(np.int64)))
    return out


def _few(order: int):
    def few(batches):
        """``key, n`` of the sequences of few symbols, counted in a table of all of them."""
        size = 1 << _BITS * (order + 1)
        total, new, held = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for _, _, data, offsets in words.blocks(batch.column(0)):
                new.append(sequences(data, offsets, order).astype(np.uint32))
                held += len(new[-1])
                if held >= RUN_PENDING:
                    total += np.bincount(np.concatenate(new), minlength=size)
                    new, held = [], 0
        if new:
            total += np.bincount(np.concatenate(new), minlength=size)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], names=["key", "n"])

    return few


def _turned(grams: np.ndarray) -> np.ndarray:
    """Sequences with the symbol next to the last one in front, and the last one lowest: sorted,
    contexts with the same end lie together, and so do those that share the table of a task."""
    return (grams >> np.uint64(_BITS)).byteswap() | (grams & np.uint64(_mask(1)))


def _turned_back(turned: np.ndarray) -> np.ndarray:
    last = turned & np.uint64(_mask(1))
    return (turned ^ last).byteswap() << np.uint64(_BITS) | last


def _part(kind: int, keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the model that has a sequence, by the three symbols before the last one,
    or a word; parts of words come behind those of sequences."""
    spread = words.mixed(keys >> np.uint64(64 - 3 * _BITS) if kind == _GRAM else keys)
    return ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64) + kind * parts


def _packed(values: np.ndarray) -> bytes:
    """Numbers of one size, byte by byte, as neighbours are alike in most bytes."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unpacked(packed, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = pa.Codec("zstd", 1).decompress(packed.as_buffer(), n * size, asbytes=True)
    planes = np.frombuffer(planes, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _symbols(text, order: int):
    """For blocks of texts their first row and the row after the last, and of their sequences
    of symbols, turned, and of their words where texts begin in that list."""
    for first, last, data, offsets in words.blocks(text):
        starts = offsets + np.arange(len(offsets))
        yield first, last, [(_turned(sequences(data, offsets, order)), starts), _tokens(data, offsets)]


def _sorted_by_part(kind: int, keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each key in ascending order, and the place of that key."""
    part = _part(kind, keys, parts)
    small = part.astype(np.uint16) if 2 * parts <= 1 << 16 else part  # sorted by digits
    order = np.argsort(small, kind="stable")
    return part[order], order


class _Bag:
    """Values of a run, put into one array, which is sorted where it lies."""

    def __init__(self, table: pa.Table):
        # No run has more sequences or words than bytes and texts.
        self.values = np.empty(table["text"].nbytes + table.num_rows, np.uint64)
        self.n = 0

    def add(self, values: np.ndarray) -> None:
        self.values[self.n : self.n + len(values)] = values
        self.n += len(values)

    def tallied(self) -> tuple[np.ndarray, np.ndarray]:
        """The different values, sorted, and how often each is there."""
        values = self.values[: self.n]
        values.sort()
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: self.n])
        return values[first], np.diff(np.append(first, self.n))


_ASKED = "file string, run long, first long, part long, size long, keys binary, counts binary"
_TOLD = (
    "file string, run long, first long, part long, size long, counts binary, totals binary, "
    "unseen binary, distinct long, learned long"
)


def _asked(order: int, parts: int):
    def asked(batches):
        """For each run of rows and each part of the model: the different sequences or words
        that the run asks for, with their counts in texts that are learned from."""

        def rows(chunks):
            table = pa.Table.from_batches(chunks)
            held = table["held_out"].to_numpy()
            learned, others = [_Bag(table) for _ in range(2)], [_Bag(table) for _ in range(2)]
            for x, y, found in _symbols(table["text"], order):
                for kind, (values, at) in enumerate(found):
                    of = np.repeat(held[x:y], np.diff(at))
                    learned[kind].add(values[~of])
                    others[kind].add(values[of])
            for kind in (_GRAM, _WORD):
                keys, n = learned[kind].tallied()
                also, _ = others[kind].tallied()
                learned[kind] = others[kind] = None
                also = also[~_places(keys, also)[1]]
                at = np.searchsorted(keys, also)
                keys, n = np.insert(keys, at, also), np.insert(n, at, 0)
                part, by_part = _sorted_by_part(kind, keys, parts)
                keys, n = keys[by_part], n[by_part]
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(cuts[1:], len(keys))
                some = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([table["file"][0].as_py()] * some, pa.string()),
                        *[pa.array([table[c][0].as_py()] * some, pa.int64()) for c in ("run", "row")],
                        pa.array(part[cuts]),
                        pa.array(ends - cuts),
                        pa.array([_packed(keys[x:y]) for x, y in zip(cuts, ends)], pa.binary()),
                        pa.array([_packed(n[x:y]) for x, y in zip(cuts, ends)], pa.binary()),
                    ],
                    names=["file", "run", "first", "part", "size", "keys", "counts"],
                )

        # A task may have pieces of a file that do not follow one another: what is asked for
        # at once lies in one of them.
        where = ["file", "block", "run"]
        now, held = None, []
        for batch in batches:
            change = np.zeros(batch.num_rows, bool)
            for c in where:
                code = batch.column(c).dictionary_encode().indices.to_numpy()
                change |= np.diff(code, prepend=code[:1]) != 0
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                name = [batch.column(c)[x].as_py() for c in where]
                if name != now and held:
                    yield from rows(held)
                    held = []
                now = name
                held.append(batch.slice(x, y - x))
        if held:
            yield from rows(held)

    return asked


def _told(order: int, parts: int, low):
    def told(table: pa.Table) -> pa.Table:
        """What a part of the model answers to each run: the counts of its sequences and their
        contexts, and the code lengths of those that were never seen; or the counts of words."""
        sizes = table["size"].to_numpy()
        many = [
            np.concatenate([_unpacked(x, n, kind) for x, n in zip(table[c], sizes.tolist())])
            for c, kind in (("keys", np.uint64), ("counts", np.int64))
        ]
        keys, back = np.unique(many[0], return_inverse=True)
        n = np.bincount(back, many[1], len(keys)).astype(np.int64)
        total, unseen, counts = n, np.zeros(len(n)), [0, 0]
        if table["part"][0].as_py() >= parts:
            counts = [int((n > 0).sum()), int(n.sum())]
        elif len(keys):
            context = keys >> np.uint64(_BITS)
            start = np.flatnonzero(np.diff(context, prepend=~context[:1]))
            total = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(keys))))
            left = np.flatnonzero(n == 0)
            if len(left):
                grams = _turned_back(keys)
                by_gram = np.argsort(grams)
                by_gram = by_gram[n[by_gram] > 0]
                kept = list(low.value)
                if order >= len(kept):
                    kept += _below(grams[by_gram], n[by_gram], order, len(kept))
                unseen[left] = Trie(kept, _contexts(kept)).log_probability(grams[left])
        ends = np.cumsum(sizes)
        found = [[], [], []]
        for first, last in zip(ends - sizes, ends):
            own = back[first:last]
            found[0].append(_packed(n[own]))
            found[1].append(_packed(total[own]))
            found[2].append(_packed(unseen[own[n[own] == 0]]))
        first = np.arange(len(sizes)) == 0
        return pa.table(
            {
                **{c: table[c] for c in ("file", "run", "first", "part", "size")},
                **{
                    c: pa.array(x, pa.binary())
                    for c, x in zip(("counts", "totals", "unseen"), found)
                },
                "distinct": pa.array(first * counts[0]),
                "learned": pa.array(first * counts[1]),
            }
        )

    return told


def _places_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, sorted, and the place of each value among them."""
    order = np.argsort(values)
    keys = values[order]
    new = np.diff(keys, prepend=~keys[:1]) != 0
    places = np.empty(len(values), np.int32 if len(values) < 1 << 31 else np.int64)
    places[order] = np.cumsum(new, dtype=places.dtype) - 1
    return keys[new], places


def _lengths(kind: int, size, counts, totals, unseen) -> np.ndarray:
    """The code lengths of sequences, or the logarithms of counts of words, from an answer."""
    n = _unpacked(counts, size.as_py(), np.int64)
    if kind == _WORD:
        return np.log10(n + 1.0)
    out = np.log10(np.maximum(2 * n - 1, 1)) - _log(2 * _unpacked(totals, len(n), np.int64))
    new = n == 0
    out[new] = _unpacked(unseen, int(new.sum()), np.float64)
    return out


def _scored(order: int, parts: int):
    def scored(docs: pa.Table, told: pa.Table) -> pa.Table:
        """The scores of the texts of a run, from what the parts of the model have told it."""
        docs = docs.sort_by("row")
        told = told.sort_by([("first", "ascending"), ("part", "ascending")])
        firsts = told["first"].to_numpy()
        cuts = np.searchsorted(docs["row"].to_numpy(), np.unique(firsts))
        ends = np.append(cuts[1:], docs.num_rows)
        out = [[], [], [], []]
        for first, x, y in zip(np.unique(firsts), cuts, ends):
            mine = np.flatnonzero(firsts == first)
            of = told["part"].to_numpy()[mine]
            text = docs["text"].slice(x, y - x)
            # Each block's different values and where they are; then the code lengths of all.
            blocks = [
                [(*_places_of(values), at) for values, at in found]
                for *_, found in _symbols(text, order)
            ]
            for kind in (_GRAM, _WORD):
                keys = np.sort(np.concatenate([b[kind][0] for b in blocks]))
                keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
                answers = [
                    _lengths(kind, *(told[c][k] for c in ("size", "counts", "totals", "unseen")))
                    for k in mine[(of >= parts) == (kind == _WORD)].tolist()
                ]
                answers = np.concatenate([np.zeros(0), *answers])
                if len(answers) != len(keys):
                    raise ValueError(f"the rows of {docs['file'][0]} have changed meanwhile")
                lengths = np.empty(len(answers))
                lengths[_sorted_by_part(kind, keys, parts)[1]] = answers
                for block in blocks:
                    own, places, at = block[kind]
                    logs = lengths[np.searchsorted(keys, own)][places]
                    sums = np.add.reduceat(logs, at[:-1])
                    if kind == _GRAM:
                        out[0].append(sums)
                    else:
                        out[1].append(np.diff(at))
                        out[2].append(np.add.reduceat((logs > 0).astype(np.int64), at[:-1]))
                        out[3].append(sums)
                    block[kind] = None
        score, n_tokens, n_known, log_sum = (np.concatenate(c) for c in out)
        alone = (np.arange(docs.num_rows) == 0).astype(np.int64)
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": docs["held_out"],
                "n_tokens": pa.array(n_tokens),
                "n_known": pa.array(n_known),
                "log_sum": pa.array(log_sum),
                "score": pa.array(score),
                "distinct": pa.array(alone * told["distinct"].to_numpy().sum()),
                "learned": pa.array(alone * told["learned"].to_numpy().sum()),
            }
        )

    return scored


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with the file, the piece of it and the row at which they lie."""
    places = {"file": "file_path", "block": "file_block_start", "row": "row_index"}
    where = [F.col(f"_metadata.{c}").alias(name) for name, c in places.items()]
    try:
        return docs.select("*", *where)
    except AnalysisException:
        return stage(docs, "ppm_documents").select("*", *where)


def score_documents(
    docs: DataFrame,
    held_out_of: int = 7,
    held_out: int = 2,
    order: int = ORDER,
    share: int = RUN_SYMBOLS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of
    every document, with a model of those that are not held out. A run of rows has about
    ``share`` bytes of text."""
    context = docs.sparkSession.sparkContext
    docs = _numbered(
        docs.select(
            "doc_id",
            F.coalesce(remainder(F.col("doc_id"), held_out_of) == held_out, F.lit(False)).alias(
                "held_out"
            ),
            F.col("text").cast("string").alias("text"),
        )
    )
    n_rows, n_bytes = docs.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    ).first()
    rows = max(1, share * n_rows // max(n_bytes, 1))
    parts = max(PARTS, n_bytes // PART_BYTES)
    docs = docs.withColumn("run", F.floor(F.col("row") / rows).cast("long"))

    last = min(order, 2)
    # The shortest contexts are few, whatever the text, and every task needs them.
    few = docs.filter("not held_out").select("text").mapInArrow(_few(last), "key long, n long")
    few = _sorted_columns(few.groupBy("key").agg(F.sum("n").alias("n")), "key", "n")
    low = context.broadcast(_below(*few, last, 0))

    asked = docs.mapInArrow(_asked(order, parts), _ASKED)
    told = asked.groupBy("part").applyInArrow(_told(order, parts, low), _TOLD)
    schema = T.StructType(
        [
            *docs.schema.fields[:2],
            *T._parse_datatype_string(
                "n_tokens long, n_known long, log_sum double, score double, distinct long, learned long"
            ).fields,
        ]
    )
    scored = (
        docs.drop("block")
        .groupBy("file", "run")
        .cogroup(told.groupBy("file", "run"))
        .applyInArrow(_scored(order, parts), schema)
    )
    scored = stage(scored, "ppm_scored")
    v, n = scored.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "learned")]
    ).first()
    per_token = float(np.log10(n + v + 1.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * per_token).alias("base_score"),
        "score",
    )


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
