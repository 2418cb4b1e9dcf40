"""Best-fit packing by sum of squares.

Each piece of a document goes where the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes smallest, so no gap piles up that later pieces can't fill.

Scale: pieces get an id that is stored with them, are dealt into shards of about `shard_pieces` by
its hash, and every shard is packed by its own task from narrow rows (no text). Sequences that end
up nearly full are closed; the pieces of all others go to the next round, which has far fewer of
them, until they fit one shard. So the loss isn't one open sequence per gap and shard but per gap
once, no task ever holds more than about a shard, and nothing depends on the driver. Where most
pieces leave gaps that no piece fills (lengths just over half of the capacity, say), rounds close
little; then the open sequences themselves are packed into each other, round by round.

Token ids come from a public tokenizer file; each ends with `end_id`. Tokens are made word by word
through a table kept in the Python worker: the tokenizer splits at white space before anything
else, so a text's ids are the ids of its words in turn. Null text counts as empty (one piece of the
end id alone). Only documents of more than `capacity` ids are cut. Repeated rows are packed each.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.llm._common import cache_of, parts, stash, table, without

CAPACITY = 4096
SEPARATOR = "\x01"
#: Words that a worker keeps, first come; later ones are encoded again where they occur.
KEPT_WORDS, LONGEST_WORD = 600_000, 40
LAST_LATIN = "\u024f"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Ids of a text as little-endian 32-bit bytes, from the ids of its words."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.kept = kept
        self.model = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise OSError("ids are laid out as little-endian 32-bit integers")
        self.tail = {x: self._one(x) for x in ".,"}
        self.mark = self.model.encode(SEPARATOR, add_special_tokens=False).ids

    def _one(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Encode many words: a-z straight by the merges (no earlier step of the tokenizer changes or
        splits them), others at once with a separator between them by which the ids are parted."""
        merge = self.model.model.tokenize
        for w in words:
            if w.isascii() and w.isalpha() and w.islower():
                self.known[w] = array("I", [x.id for x in merge(w)]).tobytes()
        words = [w for w in words if w not in self.known]
        odd = [w for w in words if SEPARATOR in w]
        words = [w for w in words if SEPARATOR not in w]
        if len(self.mark) == 1 and words:
            ids = np.array(self.model.encode_batch_fast([f" {SEPARATOR} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) == len(words) - 1:
                raw, bounds = ids.tobytes(), [0, *(4 * (ends + 1)).tolist(), 4 * (len(ids) + 1)]
                self.known.update((w, raw[bounds[k] : bounds[k + 1] - 4]) for k, w in enumerate(words))
                words = []
        for w in [*words, *odd]:
            self.known[w] = self._one(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        # ASCII texts may be lower-cased at once: the tokenizer does it too, after finding its special tokens.
        split = [(t.lower() if t.isascii() and "<|" not in t else t).replace("\n", " ").split(" ") for t in texts]
        new, known = set().union(*split).difference(self.known), self.known
        # A full stop or comma after a Latin letter is a token run of its own, so such words are made of two.
        tails = [w for w in new if w[-1] in ".," and "A" <= w[-2:-1] <= LAST_LATIN and w[-2].isalpha()]
        learned = new.difference(tails).union([w[:-1] for w in tails]).difference(known)
        long = [w for w in learned if len(w) > LONGEST_WORD]
        full = len(known) > self.kept
        self._learn([w for w in learned if len(w) <= LONGEST_WORD])
        for w in long:
            known[w] = self._one(w)
        for w in tails:
            known[w] = known[w[:-1]] + self.tail[w[-1]]
        get = known.__getitem__
        out = [b"".join(map(get, own)) for own in split]
        for w in [*tails, *learned] if full else long:
            del known[w]
        return out


def _words(path: str, kept: int) -> WordTable:
    held = cache_of("packing")
    if (path, kept) not in held:
        held[path, kept] = WordTable(path, kept)
    return held[path, kept]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int = KEPT_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document.

    `tokenizer` is a path that every executor has (part of the Python environment). `kept_words`
    trades a worker's memory, about 250 bytes a word, for time; it doesn't change the ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        model = _words(tokenizer, kept_words)
        for part in parts(batches, 1):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), model.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[s : s + 4 * capacity]
                    rows.append((doc, k, s // 4, len(cut) // 4, zlib.crc32(cut), cut))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], part.column(0).type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of each bin) for items placed longest first by the least sum of squares.

    With counts N[g] of open bins by gap g (full bins don't count), opening a bin for an item of
    length s costs (N[c-s]+1)^2 - N[c-s]^2, and placing it at gap g costs
    (N[g-s]+1)^2 - N[g-s]^2 + (N[g]-1)^2 - N[g]^2. Ties go to the smallest gap, a new bin last.
    """
    n = len(lengths)
    bins, offsets, fills = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        own = count[s:]
        cost = 2 * (count[: capacity + 1 - s] - own) + 2
        if s <= capacity:
            cost[0] = 1 - 2 * own[0]  # a full bin leaves the sum
        cost = np.where(own > 0, cost, np.iinfo(np.int64).max)
        g = int(cost.argmin())
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if own[g] > 0 and cost[g] <= fresh:
            b = open_bins[g + s].pop()
            count[g + s] -= 1
        else:
            b, g = len(fills), capacity - s
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += s
        if g:
            open_bins[g].append(b)
            count[g] += 1
    return bins, offsets, np.array(fills, np.int64)


def _packer(capacity: int, level: int, slack: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        b, off, fill = sum_of_squares(table.column("length").to_numpy(), capacity)
        ids = (level << 56) + (key[0].as_py() << 24) + b
        return pa.table({"__row": table.column("__row"), "sequence_id": ids, "offset": off, "length": table.column("length"), "closed": capacity - fill[b] <= slack})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = 4000, slack: float = 0.002, gain: float = 0.001, merges: int = 8) -> DataFrame:
    """pieces (with `length` of 1 to `capacity`) with sequence_id and offset added.

    A round that closes under 30 % of its pieces is followed by merge rounds, in which open sequences
    are packed as wholes, until one saves under `gain` of the sequences it was given, `merges` at most.
    """
    # Ids are written with the rows: made on top of a stored table, they would follow each job's file splits.
    pieces = stash(without(pieces, ["__row", "sequence_id", "offset"]).withColumn("__row", F.monotonically_increasing_id()), "pieces")
    loose = pieces.select("__row", "length")
    placed, n, level = [], loose.count(), 0
    while True:
        shards = max(1, -(-n // shard_pieces))
        done = _round(loose, capacity, level, shards, capacity if shards == 1 else int(slack * capacity))
        placed.append(done.filter("closed").select("__row", "sequence_id", "offset"))
        if shards == 1:
            break
        left = done.filter("not closed").count()
        if left > 0.7 * n:
            placed.append(_merge(done.filter("not closed").drop("closed"), capacity, level + 1, shard_pieces, gain, merges))
            break
        loose, n, level = done.filter("not closed").select("__row", "length"), left, level + 1
    both = placed[0]
    for x in placed[1:]:
        both = both.unionByName(x)
    return pieces.join(both, "__row").drop("__row")


def _round(loose: DataFrame, capacity: int, level: int, shards: int, slack: int) -> DataFrame:
    """(__row, sequence_id, offset, length, closed) of loose(__row, length), shard by shard."""
    dealt = loose.select("__row", "length", F.expr(f"pmod(xxhash64(__row, {level}), {shards})").alias("__shard"))
    return stash(dealt.groupBy("__shard").applyInArrow(_packer(capacity, level, slack), "__row long, sequence_id long, offset long, length long, closed boolean"), f"packed{level}")


def _merge(opened: DataFrame, capacity: int, level: int, shard_pieces: int, gain: float, merges: int) -> DataFrame:
    """(__row, sequence_id, offset): open sequences packed into each other, their pieces moved along."""
    now = opened.select("__row", "sequence_id", "offset", "length")
    for k in range(merges):
        wholes = stash(now.groupBy(F.col("sequence_id").alias("__row")).agg(F.sum("length").alias("length")), f"open{level + k}")
        n = wholes.count()
        shards = max(1, -(-n // shard_pieces))
        moved = _round(wholes, capacity, level + k, shards, capacity)
        to = moved.select(F.col("__row").alias("sequence_id"), F.col("sequence_id").alias("__to"), F.col("offset").alias("__by"))
        now = stash(now.join(to, "sequence_id").select("__row", F.col("__to").alias("sequence_id"), (F.col("offset") + F.col("__by")).alias("offset"), "length"), f"merged{level + k}")
        if shards == 1 or n - moved.select("sequence_id").distinct().count() < gain * n:
            break
    return now.drop("length")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS) -> DataFrame:
    return pack(tokenize(docs, tokenizer or tokenizer_file(), end_id, capacity, kept_words=kept_words), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
