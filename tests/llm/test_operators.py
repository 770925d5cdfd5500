"""Small tables against brute force, and the edge cases every operator defines."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, embed_dedup, html_text, lang_id, line_dedup, minhash, mixing, packing, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __doc string"
LONG = "the quick brown fox jumps over the lazy dog again and again"


@pytest.fixture(scope="module")
def docs(spark):
    english = ["this is the house that the man and the dog live in with their friends", LONG]
    german = ["das ist das haus in dem der mann und der hund mit ihren freunden leben", "der schnelle braune fuchs springt über den faulen hund"]
    rows = [(i, (english if i % 2 else german)[i // 2 % 2] * 3, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, 1, "x") for i in range(40)]
    rows += [(100, None, "en", "s0", 0, "x"), (101, "", None, None, 0, "x"), (102, "123 %%", "de", "s1", 0, "x"), (103, "a " * 30_000, "en", "s0", 0, "x"), (103, "a " * 30_000, "en", "s0", 0, "x"), (None, "no id here", "en", "s2", 0, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (lang_id.digest, mixing.digest, minhash.digest, line_dedup.digest, packing.digest, pii.digest):
        assert f(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ann.digest(vectors).count() == 0 and embed_dedup.digest(vectors).count() == 0
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language(docs):
    rows = lang_id.digest(docs).join(docs.select(F.col("doc_id").alias("d"), "lang").distinct(), F.col("doc_id") == F.col("d")).collect()
    assert len([r for r in rows if r.doc_id < 40]) == 40 and all(r.lang_pred == r.lang for r in rows if r.doc_id < 40)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (100, 101, 102))
    kept = lang_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_mixing(docs):
    rows = mixing.digest(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.digest(docs).collect()))
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r.source, [0, 0, r.target])
        s[0] += r.size
        s[1] += r.taken
    assert all(abs(t - g) < 1 and g <= 2 * n for n, t, g in by.values())
    assert mixing.targets([10, 10, 100], [5, 2, 1]) == [20, 20, 140]
    assert mixing.repeat(docs).columns == docs.columns


def test_minhash_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = [[f"w{rng.integers(500)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for b in base:
        for k in range(8):
            w = list(b)
            for at in rng.choice(120, k, replace=False):
                w[at] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "two words", "Two Words", "", None]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    parent = list(range(len(texts)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    found = {r.doc_id: r for r in minhash.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [found[i].component_id for i in range(len(texts))] == [top(i) for i in range(len(texts))]


def test_line_dedup(spark, docs):
    rows = [(i, f"{LONG}\nown line of document {i}\n  {LONG.upper()} ") for i in range(5)] + [(9, None), (4, LONG)]
    out = line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped) for r in out) == [(0, 3, 2), (1, 3, 2), (2, 3, 2), (3, 3, 2), (4, 1, 0), (4, 3, 0), (9, 1, 0)]
    assert {r.kept_sha256 for r in out if r.doc_id == 0} == {hashlib.sha256(b"own line of document 0").hexdigest()}
    assert line_dedup.dedup_lines(docs).columns == docs.columns and line_dedup.dedup_lines(docs).count() == docs.count()


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["It's 3.14, e.g. \"so.\" ... ok., É. Œuvre, x y <|endoftext|> A<|ENDOFTEXT|> ñandú. 中文，好. é. ﬁ", "", None, "İstanbul. ΣΑΣ, \x1c a"]
    ids = list(packing.token_ids(texts, packing.tokenizer_path()))
    assert [np.frombuffer(i, np.uint32).tolist() for i in ids] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    rows = packing.digest(docs).collect()
    by, filled = {}, {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert all(sum(v) % n == 0 for (_, n), v in by.items())
    for v in filled.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048


def test_packing_patterns():
    demand = np.bincount([60, 60, 60, 100, 128, 128, 7, 7, 7, 256], minlength=257)
    chosen = packing.patterns(demand, 256)
    held = np.zeros(257, int)
    for pattern, times in chosen:
        assert sum(c * n for c, n in pattern.items()) <= 256
        for c, n in pattern.items():
            held[c] += n * times
    assert (held == demand).all() and sum(t for _, t in chosen) == 4


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[200:260] = x[5] + rng.standard_normal((60, 16)) * 0.05
    x[290:] = x[7]
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0), (404, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    d = x.astype(float)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    out = {r.vec_id: r for r in embed_dedup.digest(df).collect()}
    assert len(out) == 305 and all(out[i].kept and out[i].n_links == 0 for i in range(400, 405))
    assert [out[i].n_links for i in range(300)] == linked.sum(1).tolist()
    assert out[295].component_id == 7 and not out[295].kept
    near = ann.digest(df).collect()
    hit = 0
    for q in range(0, 300, 20):
        score = d @ d[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(300), -score))[:20]
        hit += len(set(want.tolist()) & {r.vec_id for r in near if r.query_id == q})
    assert hit / 300 >= 0.9 and len(near) == 300


def test_pages():
    page = "<html><head><title>t</title></head><body><header><p>Top</p></header><nav><ul><li><a href='/'>Home</a></ul></nav><article><h1>Fish &amp chips</h1><p>One<br>two <b>bold</b>.<p>Next &lt;b&gt;<div class='comments'><p>I agree</p></div><form><p>Send</p></form></article><footer>x</footer><script>var p='</p>';"
    assert html_text.main_text(page) == "Fish & chips\nOne two bold.\nNext <b>"
    plain = "<body><div><a>Menu</a></div><div class='x'><p>" + "A long sentence, with commas, and more. " * 5 + "</p></div><div id=sidebar><p>" + "Words, words, words. " * 9 + "</p></div>"
    assert html_text.main_text(plain) == ("A long sentence, with commas, and more. " * 5).strip()
    assert html_text.main_text(None) == "" and html_text.main_text("<p") == ""


def test_private_values(spark):
    text = "Card 4111111111111111, not 4111111111111112. Ring +1 (202) 555-0143 or mail Ann.Lee7@mail.example.com from 10.1.2.3 on 1987-06-05 (4.0)."
    a, b, c = (r.text for r in pii.pseudonymize(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string"), "key").orderBy("doc_id").collect())
    assert a == b and c is None
    for gone in ("4111111111111111", "555-0143", "Ann.Lee7", "10.1.2.3", "1987-06-05"):
        assert gone not in a
    assert "4111111111111112" in a and "(4.0)." in a and "@mail.example.com" in a
    other = a.split("Card ")[1].split(",")[0]
    assert len(other) == 16 and spark.range(1).select(pii.is_card(F.lit(other))).first()[0]


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good <|im_end|> \\", 2.0), (1, 3, 1, "assistant", "bad", 1.0), (1, 4, 2, "user", None, 3.0), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0), (3, 5, 9, "system", "lost parent", None)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    out = {r.conv_id: r for r in chat.format_paths(nodes, chat.chosen_paths(nodes)).collect()}
    assert set(out) == {1, 3} and chat.read_back(out[1].formatted) == [("user", "q"), ("assistant", "good <|im_end|> \\"), ("user", "")]
    (span,) = out[1].loss
    assert chat.unescape(out[1].formatted[span["start"] : span["end"]]) == "good <|im_end|> \\"
