"""Chat formatting of reply trees.

Pointers to ancestors double with every self-join, which gives each message its depth and the score of its branch; leaves
are ranked per tree and the paths of the chosen ones enumerated from the same pointers, so a tree of depth d takes about
log2(d) joins. Each path becomes one conversation in a template that marks its turns; control strings within roles and
texts are escaped so that reading back gives what went in. The loss mask covers the texts of assistant turns.

Defined results: null text or role is empty. A parent that is not in the tree makes a root. Messages on or below a cycle
have no root and are left out, as are rows without a conversation or message id. Ties between branches go to the longer,
then to the smaller leaf id. Rows that repeat a message id within a tree must be numbered first, as ``turns`` does: it
orders rows of equal turn by role and text. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"
TREE = ["conv_id", "node"]


def turns(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: every message answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.where("conv_id IS NOT NULL").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(conv_id, leaf, rank, node, place): the messages of the ``best`` branches of each tree, the root at the last place.

    A branch scores the mean of its messages' ``score``; null scores count 0.
    """
    nodes = nodes.where("conv_id IS NOT NULL AND node IS NOT NULL")
    known = nodes.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    linked = nodes.join(known, (F.col("conv_id") == F.col("c")) & (F.col("parent") == F.col("n")), "left")
    now = cut_lineage(linked.select("conv_id", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    jumps, most = [], nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        if not now.where("up IS NOT NULL").limit(1).count():
            break
        jumps.append(now.where("up IS NOT NULL").select("conv_id", "node", "up"))
        above = now.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("score").alias("extra"))
        # Only messages that have not reached their root are joined again.
        both = now.where("up IS NOT NULL").join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("n")))
        further = both.select("conv_id", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("extra")).alias("score"))
        now = cut_lineage(now.where("up IS NULL").unionByName(further))
    parents = nodes.where("parent IS NOT NULL").select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = now.where("up IS NULL").join(parents, TREE, "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("place"))
    for k, jump in enumerate(jumps):
        far = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "up")
        higher = paths.join(far, (F.col("conv_id") == F.col("c")) & (F.col("node") == F.col("n")))
        paths = cut_lineage(paths.unionByName(higher.select("conv_id", "leaf", "rank", F.col("up").alias("node"), (F.col("place") + (1 << k)).alias("place"))))
    return paths


def _escaped(column, line: bool = False):
    out = F.replace(F.replace(F.coalesce(column, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line else out


def format_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss array<struct<start,end>>): one conversation per path; places count from 0."""
    texts = nodes.select("conv_id", "node", _escaped(F.col("role"), line=True).alias("role"), _escaped(F.col("text")).alias("text"))
    rows = paths.join(texts, TREE).groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("at"), "role", "text"))).alias("turns"))
    head = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"))
    whole = lambda t: F.concat(head(t), t["text"], F.lit(f"{END}\n"))

    def span(acc, t):
        start = acc["length"] + F.length(head(t))
        own = F.struct(start.alias("start"), (start + F.length(t["text"])).alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"])
        return F.struct((acc["length"] + F.length(whole(t))).alias("length"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("length"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return rows.select("conv_id", "leaf", "rank", F.array_join(F.transform("turns", whole), "").alias("formatted"), F.aggregate("turns", none, span)["spans"].alias("loss"))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations."""
    odd = f"{END}{START}assistant ok"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    nodes = cut_lineage(turns(rows))
    out = format_paths(nodes, chosen_paths(nodes))

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(formatted, loss):
        import pandas as pd

        rows = []
        for text, spans in zip(formatted, loss):
            back = read_back(text)
            learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            hashed = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in back), learnt)]
            rows.append((len(back), hashed[0], len(learnt), hashed[1], len(text)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return out.withColumn("read", read("formatted", "loss")).select("conv_id", "read.*")
