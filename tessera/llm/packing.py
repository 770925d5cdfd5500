"""Packing token sequences as a cutting-stock problem solved by column generation.

Documents are cut into full sequences and one rest. Lengths fall into classes of ``width`` tokens; the linear program over
patterns (how many pieces of which class share a sequence) starts from uniform patterns, and a knapsack dynamic program
over the classes' prices adds the pattern that would help most until none does. Rounded down, the program's patterns take
nearly all pieces; what is left is packed by first fit decreasing. The driver sees the histogram of classes, never pieces.
Pieces are then ranked within their class and each rank looks up its slot.

Defined results: null text is empty text; a document is its ids and a closing id 1, so an empty one has one token. Rows
that repeat a doc_id are packed each on their own. Documents without a doc_id are packed too. Texts may be of any length;
each is cut into as many full sequences as it fills. Columns but doc_id and text are ignored, whatever their names. Pieces
that are equal in all columns are ranked in any order. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage

CAPACITY, END_ID = 2048, 1
#: Bytes of words and ids that a Python worker remembers, each with so many of overhead; beyond, it forgets them all.
REMEMBER, OVERHEAD = 80_000_000, 200
_memory: dict[str, tuple] = {}
_RUN_OF_MARKS = re.compile(rb"[.,](?<![0-9A-Za-z][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])(?<![\xc4\xc5][\x80-\xbf][.,])[ \n]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> tuple:
    """(tokenizer, word -> ids as bytes, which ids end a word), once per Python worker."""
    if path not in _memory:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        ends = np.zeros(t.get_vocab_size(), bool)
        ends[[i for s, i in t.get_vocab().items() if s.endswith("</w>")]] = True
        _memory[path] = t, {}, ends
    return _memory[path]


def _learn(words: list[bytes], path: str) -> None:
    """Add the ids of words to the memory. The tokenizer never looks across blanks, so words are encoded on their own.

    Words of letters go in one call, told apart by the tokens that end them.
    """
    t, known, ends = _tokenizer(path)
    plain, odd = [w for w in words if w.isalpha()], []  # ASCII letters
    for w in words:
        if not w.isalpha():
            text = w.decode("utf-8", "surrogatepass")
            # One word in the tokenizer's eyes too, also in lower case.
            (plain if text.isalpha() and max(text) < "\u0250" and "\u0130" not in text else odd).append(w)
    if plain:
        ids = np.array(t.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0].ids, np.uint32)
        stops = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(stops) != len(plain):
            raise ValueError("the tokenizer does not end words as its model says")
        raw = ids.tobytes()
        known.update(zip(plain, [raw[a:b] for a, b in zip([0, *stops], stops)]))
    if odd:
        found = t.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in odd], add_special_tokens=False)
        known.update(zip(odd, [np.array(e.ids, np.uint32).tobytes() for e in found]))


def _words(text: str | None) -> list[bytes]:
    """Parts of a text that the tokenizer treats on their own, with A-Z lower-cased as it would itself.

    Full stops and commas behind a plain letter or digit and before a blank are parts too. Texts with other marks before
    them, or with what may be a special token, are only cut at blanks.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if b"<|" in data:
        return data.split()
    if not _RUN_OF_MARKS.search(data):
        for mark in (b".", b","):
            data = data.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return data.lower().split()


def token_ids(texts: Iterable[str | None], path: str, together: int = 200) -> Iterator[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers."""
    known = _tokenizer(path)[1]
    texts, held = iter(texts), sum(map(len, known)) + sum(map(len, known.values())) + OVERHEAD * len(known)
    while group := [_words(t) for t in islice(texts, together)]:
        found = [list(map(known.get, words)) for words in group]
        new = list({w for words, ids in zip(group, found) if None in ids for w, i in zip(words, ids) if i is None})
        if held > REMEMBER:
            known.clear()
            held = 0
        for s in range(0, len(new), 5000):
            _learn(new[s : s + 5000], path)
        held += sum(len(w) + len(known[w]) + OVERHEAD for w in new)
        for words, ids in zip(group, found):
            yield b"".join(ids if None not in ids else [known[w] if i is None else i for w, i in zip(words, ids)])


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full sequences and a rest for each document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), token_ids((x.as_py() for x in batch["text"]), path)):
                ids += END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                rows += [(doc, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of classes (class c takes c of ``room``) whose prices sum to most."""
    value, choice = np.zeros(room + 1), np.zeros(room + 1, int)
    for r in range(1, room + 1):
        gain = value[r - 1 :: -1][:r] + prices[1 : r + 1]
        c = int(gain.argmax())
        value[r], choice[r] = (gain[c], c + 1) if gain[c] > value[r - 1] else (value[r - 1], 0)
    pattern, r = np.zeros(room + 1, int), room
    while r:
        pattern[choice[r]] += choice[r] > 0
        r -= max(1, choice[r])
    return value[room], pattern


def patterns(demand: np.ndarray, room: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): together they hold exactly ``demand[c]`` pieces of each class c from 1 to ``room``."""
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    d = demand[used].astype(float)
    columns = [{int(c): int(room // c)} for c in used]
    inverse = np.diag([1 / (room // c) for c in used])
    amount = inverse @ d
    for _ in range(rounds):
        prices = np.zeros(room + 1)
        prices[used] = inverse.sum(0)
        worth, pattern = best_pattern(np.maximum(prices, 0), room)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern[used]
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[out] = {int(c): int(pattern[c]) for c in np.flatnonzero(pattern)}
        inverse[out] /= step[out]
        amount[out] = ratio[out]
        for i in np.flatnonzero(np.abs(step) > 1e-12):
            if i != out:
                inverse[i] -= step[i] * inverse[out]
                amount[i] -= step[i] * amount[out]
    left, chosen = demand.astype(int).copy(), []
    for column, x in zip(columns, amount):
        times = min([int(x + 1e-6), *(left[c] // a for c, a in column.items())])
        if times > 0:
            chosen.append((column, times))
            for c, a in column.items():
                left[c] -= a * times
    while left.any():  # first fit decreasing, many equal sequences at once
        column, free = {}, room
        for c in np.flatnonzero(left)[::-1]:
            if take := min(left[c], free // c):
                column[int(c)] = int(take)
                free -= take * c
        times = min(left[c] // a for c, a in column.items())
        chosen.append((column, int(times)))
        for c, a in column.items():
            left[c] -= a * times
    return chosen


class Slots:
    """Where the piece of each rank within its class goes."""

    def __init__(self, chosen: list[tuple[dict[int, int], int]]):
        self.by_class: dict[int, list[tuple[int, int, int, int]]] = {}
        first, filled = 0, {}
        for column, times in chosen:
            before = 0
            for c in sorted(column, reverse=True):
                at = filled.get(c, 0)
                self.by_class.setdefault(c, []).append((at, first, column[c], before))
                filled[c] = at + column[c] * times
                before += column[c]
            first += times
        self.arrays = {c: np.array(v) for c, v in self.by_class.items()}

    def find(self, classes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place in it) of each."""
        sequence, place = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for c in np.unique(classes):
            own = np.flatnonzero(classes == c)
            runs = self.arrays[int(c)]
            run = runs[np.searchsorted(runs[:, 0], ranks[own], side="right") - 1]
            local = ranks[own] - run[:, 0]
            sequence[own] = run[:, 1] + local // run[:, 2]
            place[own] = run[:, 3] + local % run[:, 2]
        return sequence, place


def pack(docs: DataFrame, capacity: int = CAPACITY, width: int = 8, shards: int = 64, shard_rows: int = 500_000, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Pieces of a class are ranked in shards, at least ``shards`` and so many that one holds about ``shard_rows`` pieces, up
    to 64 times ``shards``: what the driver counts and every task gets is one number for each class and shard.
    """
    cut = cut_lineage(pieces(docs, capacity, path).withColumn("class", F.ceil(F.col("length") / width).cast("int")))
    most = cut.groupBy("class").count().agg(F.max("count")).first()[0] or 0
    shards = min(64 * shards, max(shards, most // shard_rows))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).cast("int"))
    room = -(-capacity // width)
    counts = np.zeros((room + 1, shards), np.int64)
    for r in cut.groupBy("class", "shard").count().collect():
        counts[r["class"], r["shard"]] = r["count"]
    chosen = patterns(counts.sum(1), room)
    shared = docs.sparkSession.sparkContext.broadcast((np.cumsum(counts, axis=1) - counts, Slots(chosen)))

    @F.pandas_udf("sequence_id long, place long")
    def slot(classes, shard, number):
        import pandas as pd

        before, slots = shared.value
        c = classes.to_numpy()
        sequence, place = slots.find(c, before[c, shard.to_numpy()] + number.to_numpy() - 1)
        return pd.DataFrame({"sequence_id": sequence, "place": place})

    order = Window.partitionBy("class", "shard").orderBy("doc_id", "start", "ids_crc32")
    placed = cut.withColumn("number", F.row_number().over(order)).withColumn("slot", slot("class", "shard", "number"))
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot.sequence_id", "slot.place")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("place")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)
