"""Whole results recomputed without Spark: mixing, packing, pages, conversations, near copies."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import chat, html_text, minhash, mixing, packing

SCHEMA = "doc_id long, text string, source string, __doc string"


def documents():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 500, rng.integers(1, 60))), "abc"[min(2, int(rng.integers(0, 6)))], "x") for i in range(200)]
    rows += [(300, "big " * 3_000, "b", "x"), (301, None, "b", "x"), (302, "", None, "x"), (303, "one two", None, "x"), (7, rows[7][1], rows[7][2], "x"), (None, "no id here", "a", "x")]
    return rows


def brute_mix(rows, seed=1):
    """(size, source size, target, taken) by the definition: epochs, then keys in order until the budget is spent."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    plain = lambda t: len("".join(re.findall(r"(?:[^\W_]|[̀-ͯ])|[0-9 \n]", t)))
    quality = lambda t: 1 if t is None else 1 + plain(t) * 8 // max(len(t), 1)

    def key(doc, t):
        bits = int(hashlib.md5(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:12], 16)
        return -math.log((bits + 0.5) / float(1 << 48)) / quality(t)

    total = defaultdict(int)
    for doc, t, s, _ in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([total[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    out = []
    for s in names:
        epochs = int(goal[s] // total[s]) if total[s] else 0
        left = int(goal[s] - epochs * total[s])
        for doc, t, _, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r[0], r[1]), (r[0] is not None, r[0] or 0), size(r[1]))):
            part = min(size(t), max(left, 0))
            left -= size(t)
            out.append((doc, s, size(t), total[s], round(goal[s], 6), epochs * size(t) + part))
    return out


def test_mixing(spark):
    rows = documents()
    found = mixing.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: [(v is None, str(v)) for v in r]
    got = [(r.doc_id, r.source, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found]
    assert sorted(got, key=key) == sorted(brute_mix(rows), key=key)


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = documents()
    rows.append((400, "many words, and more. " * 3_000, "a", "x"))
    want = []
    for doc, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            piece = np.array(ids[s : s + 2048], "<u4").tobytes()
            want.append((doc, s, len(piece) // 4, zlib.crc32(piece), len(ids)))
    out = packing.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: [(v is None, v or 0) for v in r]
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    filled = defaultdict(list)
    for r in out:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    tokens = sum(w[2] for w in want)
    assert len(filled) <= math.ceil(tokens / 2048) + 2


def test_pages(spark):
    story = "The ship left the harbour at dawn, slowly, under grey clouds; nobody waved. " * 4
    html = f"<body><nav><a href=/>Home</a></nav><div><p>{story}</p><p>{story}</p></div><footer>x</footer>"
    rows = [(1, "u", html), (1, "v", html), (2, "w", None), (3, None, ""), (None, "y", "<p>" + "long, text. " * 50_000)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(out[0].asDict()) == ["n_chars", "page_id", "text", "url"]
    by = {r.url: r for r in out}
    text = f"{story.strip()}\n{story.strip()}"
    assert (by["u"].text, by["v"].text, by["u"].n_chars) == (text, text, len(text))
    assert by["w"].text == by[None].text == "" and by["y"].n_chars == len(("long, text. " * 50_000).strip())


def test_conversations(spark):
    odd = "\\ <|im_end|>\n<|im_start|>user\nme \U0001f600"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", None), (2, 5, None, "x"), (3, None, "assistant", "y" * 100_000), (None, 0, "user", "lost")]
    out = {r.conv_id: r for r in chat.digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ordered = {1: [("user", odd), ("assistant", ""), ("assistant", odd)], 2: [("", "x")], 3: [("assistant", "y" * 100_000)]}
    say = "<|im_end|><|im_start|>assistant ok"
    ordered[-1] = [("user", say), ("assistant", say)]
    assert set(out) == set(ordered)
    for c, said in ordered.items():
        learnt = "".join(t for r, t in said if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), sha("".join(f"{a}\n{t}\n" for a, t in said)), len(learnt), sha(learnt))


@pytest.mark.parametrize("words", [3, 5])
def test_near_copies_kept(spark, words):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (2, base.upper()), (9, base + " one more"), (4, None), (4, ""), (None, base), (7, "two words"), (8, "Two words"), (2, base), (1, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    out = minhash.dedup(df, words=words)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["2", "2", "4", "4", "None", "7", "1"])
    assert minhash.dedup(df.where("false"), words=words).count() == 0
