"""MinHash near-dedup: many universal hash minima with banding, verified links, connected components.

Documents with equal shingle sets are one class, stood for by its least doc_id; each class has a signature of
``bands * rows`` minima, cut to one byte each for comparing, and one key per band. Within a band key every class is
compared with the least one. Classes that agree with it so well that every partner they may have agrees with it in a
share of ``kin`` (agreement obeys the triangle inequality) are done with that key; the others of the key are compared
among themselves, in salted blocks of bounded size that see signatures only and return one edge for each two groups they
join. Edges make families, so that two classes with a common key and an agreement that may reach the threshold are in one
family, whatever the least class of the key is like; each class is linked to the candidate that agrees best, if the full
shingle sets confirm it. Where a family then still holds several components, its classes outside the largest are compared
with all others there, in blocks of bounded size that see the full sets and return one link for each two components they
join: no pairs are written, and no link is missed because a common neighbour was none.

Signatures only rule out pairs whose agreement lies ``sigmas`` standard deviations below the threshold.

Defined results: words are runs of anything but blanks, A-Z lower-cased; a text with fewer words than a shingle is one
shingle; null, empty and blank texts have no shingle and link with nothing. Texts may be of any length. Rows that share a
doc_id are one document when kept (``dedup`` keeps them all or none if any of their texts is a copy of a smaller doc_id's);
``components`` gives each such row the size and the component of its own text, and compares for each doc_id the text with
the greatest set of hashes in byte order. Ties: of equal texts the least doc_id stands for all, and of equally good partners
the least. Rows without a doc_id are kept. Other columns pass through untouched. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut_lineage, free, pieces
from .components import connected_components

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
#: Above so many documents with candidates, their ids are joined by a shuffle instead of being sent to every task.
SEND_IDS = 500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(1 << 19)


def _new_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, base, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64. Those for longer texts are not kept."""
    return _kept_powers() if size <= 1 << 19 else _new_powers(size)


def shingles(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of ``words`` words."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    power, inverse = _powers(len(data))
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=total[1:])
    word = _mixed((total[ends] - total[starts]) * inverse[starts])
    doc_ends = np.cumsum([len(r) + 1 for r in raw])
    first = np.searchsorted(starts, np.concatenate([[0], doc_ends]) + 1, side="left")
    with np.errstate(over="ignore"):
        salt = [_U((_BASE * (2 * i + 3)) & (2**64 - 1)) for i in range(words)]
        n = max(0, len(word) - words + 1)
        whole = np.zeros(n, _U)
        for i in range(words):
            whole += word[i : n + i] * salt[i]
        whole = _mixed(whole)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                short = _U(b - a)
                for i in range(b - a):
                    short = short + word[a + i] * salt[i]
                yield _mixed(np.array([short], _U))
            else:
                yield np.empty(0, _U)


def sketches(docs: DataFrame, words: int, bands: int, rows: int, seed: int = 5) -> DataFrame:
    """(doc_id, n, d1, d2, sig, keys): size and digest of the shingle set, a byte of each minimum, a key of each band."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(np.ascontiguousarray(x).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in pieces(batch["text"], 500_000):
                sets = list(shingles(batch["text"].slice(s, e - s).to_pylist(), words))
                size = np.array([len(x) for x in sets])
                full = np.flatnonzero(size)
                low = np.zeros((len(sets), len(a)), np.uint32)
                if len(full):
                    x = (np.concatenate([sets[i] for i in full]) >> _U(32)).astype(np.uint32)
                    at, h = np.concatenate([[0], np.cumsum(size[full])[:-1]]), np.empty_like(x)
                    for k in range(len(a)):
                        np.multiply(x, a[k], out=h)
                        np.add(h, b[k], out=h)
                        low[full, k] = np.minimum.reduceat(h, at)
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)
                key = np.arange(1, bands + 1, dtype=_U)[None, :] * _U(_BASE) + np.zeros((len(sets), 1), _U)
                for r in range(rows):
                    key = _mixed(key + low[:, r::rows].astype(_U))
                sig = (low >> np.uint32(7)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(s, e - s), pa.array(size.astype(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array([r.tobytes() for r in sig], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)), signed(key.ravel()))],
                    names=["doc_id", "n", "d1", "d2", "sig", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sig binary, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, grams): the shingle sets of the documents in ``ids``, as bytes of sorted 64-bit hashes."""
    few = ids.limit(SEND_IDS + 1).count() <= SEND_IDS
    some = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in pieces(batch["text"], 500_000):
                grams = [x.tobytes() for x in shingles(batch["text"].slice(s, e - s).to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(s, e - s), pa.array(grams, pa.binary())], names=["id", "grams"])

    return some.mapInArrow(run, "id long, grams binary")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    @F.pandas_udf("boolean")
    def linked(left, right):
        import pandas as pd

        return pd.Series([_linked(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(left, right)], dtype=bool)

    left = sets.select(F.col("id").alias("b"), F.col("grams").alias("right"))
    right = sets.select(F.col("id").alias("a"), F.col("grams").alias("left"))
    return pairs.join(left, "b").join(right, "a").where(linked("left", "right")).select("a", "b")


def _agreement(left, right) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (left, right))
    return (x == y).mean(1)


def _among(rows: pa.Table, percent: int, floor: float, kin: float, settled: float) -> pa.Table:
    """Edges (a, b, same, fits) that connect all classes with a common (key, i, j) and an agreement of ``floor``."""
    ids, key, n = (rows[c].to_numpy() for c in ("id", "key", "n"))
    block = rows["i"].to_numpy().astype(np.int64) << 32 | rows["j"].to_numpy()
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(rows), -1)
    order = np.lexsort((ids, block, key))
    cuts = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(block[order]) != 0)) + 1
    root, out, wide = {}, {}, sig.shape[1]

    def top(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    def edge(x: int, y: int, same: float) -> None:
        a, b = top(int(ids[x])), top(int(ids[y]))
        if a != b:
            root[max(a, b)] = min(a, b)
            x, y = (x, y) if ids[x] < ids[y] else (y, x)
            out[int(ids[x]), int(ids[y])] = same, bool(min(n[x], n[y]) * 100 >= max(n[x], n[y]) * percent)

    for left in np.split(order, cuts):
        while len(left) > 1:
            head, left = left[0], left[1:]
            same = np.count_nonzero(sig[left] == sig[head], axis=1) / wide
            for at in np.flatnonzero(same >= floor):
                edge(head, left[at], float(same[at]))
            done, about = left[same >= settled], np.flatnonzero((same >= kin) & (same < settled))
            # Partners of those that are done agree with the head in a share of kin: compared, or taken as they are.
            if len(done) and len(done) * len(about) <= 200_000:
                for at in about:
                    with_done = np.count_nonzero(sig[done] == sig[left[at]], axis=1) / wide
                    if with_done.max() >= floor:
                        edge(done[with_done.argmax()], left[at], float(with_done.max()))
            elif len(done):
                for at in about:
                    edge(head, left[at], float(same[at]))
            left = left[same < settled]
    a, b, same, fits = zip(*((*k, *v) for k, v in out.items())) if out else ((),) * 4
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(same, pa.float64()), pa.array(fits, pa.bool_())], names=["a", "b", "same", "fits"])


def _across(left: pa.Table, right: pa.Table, percent: int, floor: float) -> pa.Table:
    """Links (a, b) between documents left and right of different components: one for each two components joined here."""
    out = []
    if len(left) and len(right):
        ids, comp, n = (right[c].to_numpy() for c in ("id", "comp", "n"))
        sig = np.frombuffer(b"".join(right["sig"].to_pylist()), np.uint8).reshape(len(right), -1)
        grams, root = right["grams"], {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        for i, c, m, s, own in zip(*(left[f"o_{x}"] for x in ("id", "comp", "n", "sig", "grams"))):
            i, c, m, own = i.as_py(), c.as_py(), m.as_py(), np.frombuffer(own.as_py(), _U)
            near = np.flatnonzero((comp != c) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent))
            same = (sig[near] == np.frombuffer(s.as_py(), np.uint8)).mean(1)
            for j in near[np.argsort(-same, kind="stable")[: int((same >= floor).sum())]].tolist():
                if top(int(comp[j])) != top(c) and _linked(own, np.frombuffer(grams[j].as_py(), _U), percent):
                    root[top(c)] = top(int(comp[j]))
                    out.append((i, int(ids[j])))
    return pa.table([pa.array(x, pa.int64()) for x in (list(zip(*out)) or [[], []])], names=["a", "b"])


def components(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, sigmas: float = 4.5, kin: float = 0.5, block_rows: int = 512, task_rows: int = 20_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs`` with a doc_id."""
    docs = docs.where(F.col("doc_id").isNotNull())
    every = cut_lineage(sketches(docs, words, bands, rows))
    same = every.where("n > 0").groupBy("d1", "d2").agg(F.min_by(F.struct("n", "sig", "keys"), "doc_id").alias("x"), F.min("doc_id").alias("id"))
    same = same.select("id", "d1", "d2", "x.n", "x.sig", "x.keys")
    reps = cut_lineage(same)
    share = percent / 100
    floor = share - sigmas * (share * (1 - share) / (bands * rows)) ** 0.5

    # Every class of a band key against the least class there.
    keyed = reps.select("id", F.explode("keys").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = cut_lineage(keyed.join(heads, "key").where("id <> head").select("key", F.col("head").alias("a"), F.col("id").alias("b")))
    pairs = met.select("a", "b").distinct()
    sigs = reps.select("id", "n", "sig")

    @F.pandas_udf("double")
    def agree(left, right):
        import pandas as pd

        return pd.Series(_agreement(left.tolist(), right.tolist()) if len(left) else [], dtype=float)

    side = lambda c: sigs.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    scored = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", agree("sig_a", "sig_b").alias("same"), fits.alias("fits")))

    # What may have a partner that is not of the head's family: all of a key that are left, in blocks of two salts.
    settled = max(floor, kin + 1 - floor)
    rest = cut_lineage(met.join(scored.where(F.col("same") < settled).select("a", "b"), ["a", "b"]).select("key", F.col("b").alias("id")))
    salts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.ceil(F.col("size") / block_rows).cast("int").alias("salts"))
    rest = rest.join(salts, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("salts")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.when(F.col("salts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("salts") - 1), F.col("own")))))
    rest = cut_lineage(rest.select("id", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    tasks = rest.count() // task_rows + 1
    dealt = rest.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks))).join(sigs, "id")
    edges = dealt.groupBy("task").applyInArrow(lambda t: _among(t.drop_columns(["task"]), percent, floor, kin, settled), "a long, b long, same double, fits boolean")
    scored = cut_lineage(scored.where(F.col("same") >= kin).unionAll(edges))
    best = scored.where(F.col("fits") & (F.col("same") >= floor)).groupBy("b").agg(F.max_by("a", F.struct("same", -F.col("a"))).alias("a"))
    families = cut_lineage(connected_components(scored.select("a", "b")).withColumnsRenamed({"node": "id", "component": "family"}))
    sets = cut_lineage(_sets(docs, families.select("id"), words).groupBy("id").agg(F.max("grams").alias("grams")))
    links = cut_lineage(_confirmed(best, sets, percent))

    # Families that still hold several components: what is outside the largest against all others there, in blocks.
    found = connected_components(links).withColumnRenamed("node", "id")
    members = cut_lineage(families.join(found, "id", "left").select("id", "family", F.coalesce("component", "id").alias("comp")))
    counts = members.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = counts.groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    main = main.select("family", "main", F.ceil((F.col("all") - F.col("most")) / block_rows).cast("int").alias("lefts"), F.ceil(F.col("all") / block_rows).cast("int").alias("rights"))
    main = cut_lineage(main)
    few = main.limit(SEND_IDS + 1).count() <= SEND_IDS
    mixed = members.join(F.broadcast(main) if few else main, "family").join(sigs, "id").join(sets, "id")
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ("id", "comp", "n", "sig", "grams")
    held = mixed.select("family", deal("rights", 1).alias("j"), every_of("lefts").alias("i"), *data)
    outside = mixed.where("comp <> main").withColumn("oi", deal("lefts", 2)).withColumn("oj", every_of("rights"))
    outside = outside.select(F.col("family").alias("of"), "oi", "oj", *[F.col(c).alias(f"o_{c}") for c in data])
    more = outside.groupBy("of", "oi", "oj").cogroup(held.groupBy("family", "i", "j")).applyInArrow(lambda x, y: _across(x, y, percent, floor), "a long, b long")

    groups = connected_components(links.unionAll(more))
    found = reps.select("id", "d1", "d2").join(groups.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = every.select("doc_id", F.col("n").alias("n_shingles"), "d1", "d2").join(found, ["d1", "d2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, that of the least doc_id."""
    name = free(docs, "__gone")
    gone = components(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's links: shingles of three words, similarity of 0.85 or more."""
    found = components(docs.select("doc_id", "text"), words=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
