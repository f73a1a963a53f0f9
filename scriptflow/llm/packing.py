"""Best-fit packing of tokenised documents under several capacities.

Documents are tokenised and cut into pieces of at most one sequence. Pieces are dealt
at random into shards of a bounded number of pieces and tokens. In a shard, from the
longest piece down, each goes to the open sequence that it fits best under every
capacity (tokens, documents, attention cost, which is the sum of squared lengths):
the one with the smallest weighted norm of what is left over afterwards, or with the
largest weighted dot product of what is left and what is asked. A new sequence is
opened only if none has room.

A shard loses about one sequence in thousands against packing everything at once, as
every shard holds pieces of all lengths.

Defined cases: a null text counts as empty and is one end token; every row of a
repeated document is packed; no rows give no pieces; a piece over a capacity has no
place anywhere, which is an error.
"""

import json
import math
import os
import string
import struct
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources.storage import stage
from . import words

TOKENS = 2048
#: Capacities that no sequence of so many tokens can exceed; set lower ones to bind.
DOCUMENTS = TOKENS
ATTENTION = TOKENS**2
#: Bounds of a shard, which one task packs.
PIECES_PER_SHARD = 16_384
TOKENS_PER_SHARD = 16_000_000
#: Pieces of words whose ids a worker remembers, and pieces that are encoded together.
REMEMBERED = 1_200_000
WORDS_AT_ONCE = 200
END_ID = 0

_PIECE = "piece int, start long, length long, ids binary"


#: Fixed value: a rule by which a tokenizer cuts words before it encodes the pieces. By
#: it, marks beside an ASCII letter or digit are pieces of their own, but for an apostrophe.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARK, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(string.punctuation.replace("'", "").encode())] = True
_SIGN[list((string.ascii_letters + string.digits).encode())] = True


def _marks_apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a block with a space wherever such a mark begins or ends."""
    mark, sign = _MARK[data], _SIGN[data]
    at = np.flatnonzero(sign[:-1] & mark[1:] | mark[:-1] & sign[1:]) + 1
    return np.insert(data, at, ord(" ")), offsets + np.searchsorted(at, offsets)


class Recent:
    """A dictionary of the keys that were used last: when the newer half is full, what
    was not used since the older one was closed goes."""

    def __init__(self, most: int):
        self.half = most // 2
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """The keys that are not there; the others are in ``new`` afterwards."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        out = []
        for key in keys.difference(self.new):
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.new[key] = value
        return out


class WordIds:
    """Token ids of words as bytes, little-endian unsigned 32-bit.

    For tokenizers whose tokens never contain white space, as then a text has the
    ids of its words one after the other. Words end at ASCII white space. Where the rules
    of the tokenizer allow it, words that differ in the case of A-Z are encoded once, and
    marks apart from the letters beside them.
    """

    def __init__(self, tokenizer: str):
        # Spark runs as many workers as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        rules = json.loads(tokenizer)
        steps = rules.get("normalizer") or {}
        steps = [step["type"] for step in steps.get("normalizers", [steps]) if step]
        self.one_case = "Lowercase" in steps and set(steps) <= {"NFC", "Replace", "Lowercase"}
        cuts = rules.get("pre_tokenizer") or {}
        first = cuts.get("pretokenizers", [cuts])[0]
        self.marks_apart = (
            self.one_case
            and first.get("type") == "Split"
            and first["pattern"] == {"Regex": _CUTS}
        )
        # What all tokens begin with that are found as they are written, before any rule.
        written = [t["content"] for t in rules.get("added_tokens") or []]
        self.written = os.path.commonprefix(written).encode().lower()
        self.pieces = Recent(REMEMBERED)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The texts of a block as they are cut into pieces at white space. One in which
        a token may be written out stays as it is."""
        given = _split(data, offsets)
        if not self.one_case:
            return given
        data = words.lowered(data)
        plain = _split(data, offsets)
        apart = _split(*_marks_apart(data, offsets)) if self.marks_apart else plain
        return [
            own if self.written in lower else cut for own, lower, cut in zip(given, plain, apart)
        ]

    def learn(self, used: set[bytes]) -> None:
        new = self.pieces.missing(used)
        for k in range(0, len(new), WORDS_AT_ONCE):
            some = new[k : k + WORDS_AT_ONCE]
            # Without offsets into the text, which take longer than the ids.
            found = self.tokenizer.encode_batch_fast(
                [w.decode() for w in some], add_special_tokens=False
            )
            for piece, encoded in zip(some, found):
                numbers = encoded.ids
                self.pieces.new[piece] = struct.pack(f"<{len(numbers)}I", *numbers)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a block."""
        split = [text.split() for text in self.texts(data, offsets)]
        self.learn(set().union(*split))
        ids = self.pieces.new.__getitem__
        return [b"".join(map(ids, found)) for found in split]


def _split(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:])]


def _word_ids(tokenizer: str) -> WordIds:
    """The one that this worker has used before, if it was of the same tokenizer.

    Functions come to a worker anew with every task, with their modules, so what
    should last is held where all of Python finds it.
    """
    held = sys.modules.setdefault("_scriptflow_word_ids", types.ModuleType("_scriptflow_word_ids"))
    if getattr(held, "tokenizer", None) != tokenizer:
        held.tokenizer, held.word_ids = tokenizer, WordIds(tokenizer)
    return held.word_ids


def _cut(ids: bytes, tokens: int):
    step = 4 * tokens
    for piece, at in enumerate(range(0, len(ids), step)):
        yield piece, piece * tokens, (min(at + step, len(ids)) - at) // 4, ids[at : at + step]


def tokenize(docs: DataFrame, tokenizer: str, tokens: int = TOKENS) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every piece of every document.

    ``tokenizer`` is the path, on the driver, of a tokenizer file whose tokens never
    contain white space. A document ends with the id 0.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches):
        ids_of = _word_ids(shared.value)
        for batch in batches:
            doc_id, text = batch.column(0), batch.column(1)
            for first, _, data, offsets in words.blocks(text, 500_000):
                rows = [
                    (first + k, *piece)
                    for k, ids in enumerate(ids_of.of(data, offsets))
                    for piece in _cut(ids + end, tokens)
                ]
                at, piece, start, length, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id.take(pa.array(at, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(_PIECE).fields])
    return slim.mapInArrow(cut, schema)


def best_fit(
    lengths: np.ndarray,
    capacity: tuple[int, int, int] = (TOKENS, DOCUMENTS, ATTENTION),
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece."""
    n = len(lengths)
    lengths = lengths.astype(np.int64)
    asked = np.column_stack([lengths, np.ones(n, np.int64), lengths**2])
    limit = np.array(capacity, np.int64)
    if n and (asked > limit).any():
        raise ValueError("a piece exceeds a capacity")
    scale = np.sqrt(np.array(weights)) / limit
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    left = np.empty((n, 3), np.int64)  # of open sequences
    names = np.empty(n, np.int64)
    used = opened = 0
    shortest = int(lengths.min()) if n else 0
    for k, i in enumerate(order):
        need = asked[i]
        best = -1
        if used:
            rest = left[:used] - need
            fits = (rest >= 0).all(axis=1).nonzero()[0]
            if len(fits):
                if rule == "norm":
                    value = ((rest[fits] * scale) ** 2).sum(axis=1)
                    best = fits[value.argmin()]
                else:
                    value = (left[fits] * scale) @ (need * scale)
                    best = fits[value.argmax()]
        if best < 0:
            best = used
            left[best], names[best] = limit, opened
            used, opened = used + 1, opened + 1
        sequence[i] = names[best]
        offset[i] = limit[0] - left[best, 0]
        left[best] -= need
        full = left[best, 0] < shortest or left[best, 1] < 1 or left[best, 2] < shortest**2
        if full:  # no later piece fits
            used -= 1
            left[best], names[best] = left[used], names[used]
    return sequence, offset


def pack(
    pieces: DataFrame,
    tokens: int = TOKENS,
    documents: int = DOCUMENTS,
    attention: int = ATTENTION,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
) -> DataFrame:
    """``pieces``, each with its ``sequence_id`` and its ``offset`` there.

    Only the column ``length`` is looked at. Columns of the two names are replaced.
    """
    carried = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fields = [pieces.schema[c] for c in carried]
    rows = stage(
        pieces.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("item"),
            F.col("length").cast("bigint").alias("_length"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "packing_pieces",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("_length"), F.lit(0))).first()
    shards = max(1, math.ceil(n / PIECES_PER_SHARD), math.ceil(total / TOKENS_PER_SHARD))

    def fill(table: pa.Table) -> pa.Table:
        sequence, offset = best_fit(
            table["_length"].to_numpy(), (tokens, documents, attention), weights, rule
        )
        shard = table["_shard"][0].as_py()
        return pa.table(
            {
                "item": table["item"],
                "sequence_id": pa.array(sequence + (shard << 32)),
                "offset": pa.array(offset),
            }
        )

    packed = (
        rows.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
        .groupBy("_shard")
        .applyInArrow(
            fill,
            T.StructType(
                [
                    T.StructField("item", T.StructType(fields)),
                    T.StructField("sequence_id", T.LongType()),
                    T.StructField("offset", T.LongType()),
                ]
            ),
        )
    )
    return packed.select(
        *[F.col(f"item.`{c}`").alias(c) for c in carried], "sequence_id", "offset"
    )


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
    return pack(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    )
