"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text stands for each language. A document is parsed left to right into
the longest phrases that occur in that text; the language whose parse costs least, phrases * log2(size of its text),
wins. Each automaton has an alphabet of its own, all letters of its sample. It is a dense table of next states in which a
missing transition already points to where the next phrase begins, with a mark, so that all segments of a batch of
documents step through it at once; with more than ``WIDE`` symbols it is a sorted list of its transitions.

Text is lower-cased letter by letter, everything else counts as one blank. Parses restart at segments of ``SEGMENT``
characters, for every language alike.

Defined results: null text or text without a letter is ``und`` with score 0. Ties go to the first language by code
point. Without any labelled text everything is ``und``. Letters that occur in no sample end a phrase in all languages.
Texts may be of any length and are read whole. Rows are judged each on their own, so repeated rows get equal results; an
empty table gives an empty one. Of rows that share a doc_id all or none are held out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import free

UND = "und"
SEGMENT = 256
#: Symbols of the automata: 0 pads, 1 is any letter not in the sample, 2 is a blank.
PAD, OTHER, BLANK = 0, 1, 2
#: Above so many symbols an automaton is sparse.
WIDE = 64
_MARK = np.int32(1 << 30)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``text``; state 0 is the empty one."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                split = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = split
                    p = link[p]
                link[q] = link[new] = split
        last = new
    return nexts


class Automaton:
    """A language's sample: ``local`` turns the model's symbols into its own."""

    def __init__(self, text: np.ndarray, symbols: int):
        own = np.unique(text[text > BLANK])
        self.local = np.full(symbols, OTHER, np.int32)
        self.local[[PAD, BLANK]] = PAD, BLANK
        self.local[own] = np.arange(len(own)) + BLANK + 1
        self.width, self.bits = BLANK + 1 + len(own), math.log2(len(text) + 2)
        nexts = _suffix_automaton(self.local[text])
        self.root = np.full(self.width, _MARK, np.int32)
        for c, s in nexts[0].items():
            self.root[c] = s | _MARK
        self.table = self.keys = self.targets = None
        if self.width > WIDE:
            moves = sorted((s * self.width + c, target) for s, step in enumerate(nexts) for c, target in step.items())
            self.keys, self.targets = np.array([k for k, _ in moves], np.int64), np.array([t for _, t in moves], np.int32)
            return
        table = np.empty((len(nexts), self.width), np.int32)
        table[:] = self.root
        for s, step in enumerate(nexts):
            for c, target in step.items():
                table[s, c] = target
        table[:, PAD] = np.arange(len(nexts))
        self.table = table.ravel()

    def phrases(self, steps: np.ndarray) -> np.ndarray:
        """Phrases that end within each column of ``steps``."""
        state, out = np.zeros(steps.shape[1], np.int32), np.zeros(steps.shape[1], np.int32)
        for symbols in steps:
            symbols = self.local.take(symbols)
            if self.table is not None:
                state *= self.width
                state += symbols
                state = self.table.take(state)
            else:
                key = state.astype(np.int64) * self.width + symbols
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                moved = np.where(self.keys[at] == key, self.targets[at], self.root[symbols])
                state = np.where(symbols == PAD, state, moved)
            out += state >> 30
            state &= _MARK - 1
        return out


class Model:
    """The languages' automata, and one symbol for each letter of their samples."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        seen = sorted({c for text in samples.values() for c in text.lower() if c.isalpha()})
        self.symbols, self._lut = {c: i + BLANK + 1 for i, c in enumerate(seen)}, None
        self.automata = [Automaton(self.encode(samples[name]), BLANK + 1 + len(seen)) for name in self.languages]

    def __getstate__(self):
        return self.__dict__ | {"_lut": None}

    def lut(self) -> np.ndarray:
        if self._lut is None:
            lut = np.where(_letters(), OTHER, BLANK).astype(np.int32)
            for c, i in self.symbols.items():
                for form in {c, c.upper(), c.title()}:
                    if len(form) == 1:
                        lut[ord(form)] = i
            self._lut = lut
        return self._lut

    def encode(self, text: str) -> np.ndarray:
        return self.lut()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text's parse per language, its number of letters, and of those that occur in any sample."""
        sizes = np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        symbols = self.lut()[flat]
        of_texts = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[np.concatenate([[0], ends])])
        letters, known = of_texts(_letters()[flat]), of_texts(symbols > BLANK)
        segments = np.maximum(1, -(-sizes // SEGMENT))
        first = np.concatenate([[0], np.cumsum(segments)])
        grid = np.zeros((first[-1], SEGMENT), np.int32)
        row = np.repeat(first[:-1], sizes) + (np.arange(len(flat)) - np.repeat(ends - sizes, sizes)) // SEGMENT
        column = (np.arange(len(flat)) - np.repeat(ends - sizes, sizes)) % SEGMENT
        grid[row, column] = symbols
        steps = np.ascontiguousarray(grid.T)
        costs = np.zeros((len(texts), len(self.languages)))
        for i, automaton in enumerate(self.automata):
            costs[:, i] = (np.add.reduceat(automaton.phrases(steps), first[:-1]) + segments) * automaton.bits
        return costs, letters, known

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, known): the winner's share when languages weigh 2^-(bits per character), the share of known letters."""
        out = [(UND, 0.0, 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t]
        if not some or not self.languages:
            return out
        costs, letters, known = self.costs([texts[i] for i in some])
        best = costs.argmin(1)
        rate = costs / np.array([len(texts[i]) for i in some])[:, None]
        share = 1 / np.exp2(rate.min(1)[:, None] - rate).sum(1)
        for i, b, s, n, k in zip(some, best.tolist(), share.tolist(), letters.tolist(), known.tolist()):
            if n:
                out[i] = (self.languages[b], float(s), k / n)
        return out


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, chars: int = 24_000, rows: int = 120, row_chars: int = 2_000, all_chars: int = 400_000) -> Model:
    """Learn from a bounded sample of the labelled documents that are not held out.

    Per language about ``rows`` documents, chosen by a hash of their id, of each at most ``row_chars`` characters, in all
    at most ``chars`` a language and ``all_chars`` over all languages: that is what the driver holds.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model({})
    cuts = docs.sparkSession.createDataFrame([(k, int(min(1.0, rows / n) * (1 << 30))) for k, n in counts.items()], "lang string, __cut long")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30))
    # One row per language.
    picked = labelled.select("lang", drawn.alias("drawn"), "text").join(F.broadcast(cuts), "lang").where("drawn < __cut AND text IS NOT NULL")
    texts = defaultdict(list)
    for r in sorted(picked.select("lang", "drawn", F.substring("text", 1, row_chars).alias("text")).collect()):
        texts[r.lang].append(r.text)
    most = min(chars, all_chars // len(counts))
    samples = {k: "\n".join(v)[:most] for k, v in texts.items()}
    return Model({k: v for k, v in samples.items() if any(c.isalpha() for c in v)})


def identify(docs: DataFrame, model: Model, as_column: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang, score, known) of the prediction from its text; one of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, known double")
    def predict(texts):
        import pandas as pd

        texts, out, at = texts.tolist(), [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at] or "")
            while end < len(texts) and size + len(texts[end] or "") <= 250_000:
                size += len(texts[end] or "")
                end += 1
            out += shared.value.predict(texts[at:end])
            at = end
        return pd.DataFrame(out, columns=["lang", "score", "known"])

    return docs.withColumn(as_column, predict(F.col("text")))


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those that are in no learned language: no text, no letter, or fewer than ``least`` of its letters known.

    Known are letters that occur in any language's sample: what is written in another script is in none of them. Where no
    language could be learned, a letter is looked for in the text itself.
    """
    model = fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free(docs, "__language")
    found = identify(docs, model, name).where((F.col(f"{name}.lang") != UND) & (F.col(f"{name}.known") >= least))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), fit(docs))
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
