"""Chat formatting of reply trees.

A tree is given by rows with a parent. Iterative self-joins enumerate the root-to-leaf paths: each round joins the paths known
so far to themselves, so that a link spans twice as many turns as before and the depth of a tree costs only
its logarithm in rounds. Paths are ranked by score, the best are chosen, and each becomes one conversation in a template whose
control strings are escaped inside texts, so that the output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

# The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", ">>")
ESCAPE = "\\"
#: A text's controls and backslashes get a backslash before them.
_ESCAPED = "(" + "|".join(re.escape(c) for c in (ESCAPE, *CONTROL)) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE:|>>)", r"\\$1")


def escaped_role(role: Column) -> Column:
    """A role inside its control: every ">" is written as backslash and full stop, so none can meet the control's end."""
    return F.replace(F.regexp_replace(role, r"(\\|\[INST\]|\[/INST\]|<<ROLE:)", r"\\$1"), F.lit(">"), F.lit("\\."))


def turn_text(role: Column, text: Column) -> Column:
    """One turn: the loss mask covers what stands between "[/INST] " and "</s>" of an assistant turn."""
    body = escaped(text)
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("[/INST] "), body, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), body, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("<<ROLE:"), F.coalesce(F.concat(F.lit("="), escaped_role(role)), F.lit("")), F.lit(">>"), body, F.lit("<</SYS>>")))
    )


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, depth, node): every node on the way from a leaf up to its root, depth 0 at the leaf.

    nodes: tree, node, parent (null, missing or itself: a root), one row a node; a null tree or node is part of no path, and repeated rows of a
    node repeat its paths (`format_conversations` takes one each). Round k joins the links that span 2^k turns to themselves;
    a cycle has no root, is never part of a path, and ends after as many rounds as its length has bits.
    """
    n = nodes.select("tree", "node", "parent")
    known = n.select("tree", F.col("node").alias("parent"))
    up = n.where("parent <> node").join(known.distinct(), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up"), F.lit(1).alias("span"))
    leaves = n.join(up.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    paths = cut(leaves.select("tree", "leaf", F.lit(0).cast("long").alias("depth"), F.col("leaf").alias("node")))
    jump = cut(up.select("tree", "node", "up"))
    span = 1
    while True:
        # Each path, known to depth span - 1, is copied up by `span` turns; then links are doubled.
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", (F.col("depth") + span).alias("depth"), F.col("up").alias("node"))
        more = cut(more)
        if more.isEmpty():
            return paths
        paths = paths.unionByName(more)
        other = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("top"))
        jump = cut(jump.join(other, ["tree", "up"]).select("tree", "node", F.col("top").alias("up")))
        span *= 2


def best_paths(nodes: DataFrame, keep: int = 1, decay: float = 1.0) -> DataFrame:
    """(tree, leaf, path_score, branch): the `keep` best leaves of each tree by mean score of the nodes on the path, ties by leaf; and the scored paths.

    A null score counts as 0; nodes as in `reply_paths`, so a null tree has no path."""
    paths = reply_paths(nodes)
    scored = paths.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    ranks = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"))
    order = Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf")
    return ranks.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= keep), scored


def format_conversations(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, branch, path_score, n_turns, formatted): one row per chosen root-to-leaf path.

    nodes: tree, node, parent, role, text, score. A null text counts as empty, a null score as 0; rows with a null tree or node are
    left out; repeated (tree, node) count once, the one of least role and text. Any role is kept, a null one too.
    """
    n = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("r"), F.coalesce("text", F.lit("")).alias("text"), "role", "parent", "score")).alias("x"))
    n = cut(n.select("tree", "node", "x.parent", "x.role", "x.text", F.col("x.score").cast("double").alias("score")))
    best, scored = best_paths(n, keep)
    turns = best.join(scored.select("tree", "leaf", "depth", "node"), ["tree", "leaf"]).join(n.select("tree", "node", "role", "text"), ["tree", "node"])
    order = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), turn_text(F.col("role"), F.col("text")).alias("t"))))
    return turns.groupBy("tree", "leaf", "branch", "path_score").agg(F.count("*").alias("n_turns"), order.alias("all")).select("tree", "leaf", "branch", "path_score", "n_turns", F.array_join("all.t", "").alias("formatted"))


_TOKEN = re.compile(r"(?P<skip>\\)(?P<plain>\.)|" + _ESCAPED.replace("(", r"(?P<skipped>\\)?(?P<control>", 1))


def read_back(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns: list[tuple[str | None, str]] = []
    role: str | None = None
    out: list[str] = []
    state = "open"  # open, text, role
    at = 0
    i = 0
    while i < len(formatted):
        m = _TOKEN.search(formatted, i)
        if m is None:
            break
        if m["skip"] or m["skipped"]:  # an escaped control: the plain string; an escaped full stop: the ">" of a role
            out.append(formatted[at : m.start()] + (">" if m["plain"] else m["control"]))
            at = i = m.end()
            continue
        if m["control"] == ESCAPE:
            raise ValueError("a lone escape")
        c = m["control"]
        before = "".join([*out, formatted[at : m.start()]])
        if state == "open":
            role = {"<s>": "user", "[/INST]": "assistant", "<<SYS>>": "system", "<<ROLE:": None}[c]
            state, at = ("role", m.end()) if c == "<<ROLE:" else ("text", m.end() + {"<s>": len("[INST] "), "[/INST]": 1, "<<SYS>>": 0}[c])
        elif state == "role":
            role, state, at = (before[1:] if before else None), "text", m.end()
        else:
            turns.append((role, before[:-1] if role == "user" else before))
            state, at = "open", m.end()
        out, i = [], at
    if state != "open" or at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        rows = [read_back(f) for f in x.column("formatted").to_pylist()]
        turns = [hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in row).encode()).hexdigest() for row in rows]
        loss = ["".join(t for r, t in row if r == "assistant") for row in rows]
        yield pa.RecordBatch.from_arrays(
            [x.column("tree"), pa.array([len(r) for r in rows], pa.int64()), pa.array(turns, pa.string()), pa.array([len(t) for t in loss], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in loss], pa.string()), pa.array([len(f) for f in x.column("formatted").to_pylist()], pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): one row per conv_id of (conv_id, turn, role, text).

    A conversation is a tree without branches: each row answers the one before it in order of turn, null turns last. Rows of one
    turn follow each other by role and text, so every row is a turn of its own. Rows with a null conv_id are one conversation.
    """
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("id"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.coalesce("text", F.lit("")))
    nodes = rows.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order))
    nodes = nodes.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    out = format_conversations(nodes).select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("tree"), "formatted")
    return out.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string"))
    return conversations(rows)


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE:|>>)', '\\\1', 'g') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 12 WHEN 'system' THEN 15
    ELSE 17 + coalesce(1 + length(regexp_replace(role, '(\\|\[INST\]|\[/INST\]|<<ROLE:|>)', '\\\1', 'g')), 0) END)::bigint AS formatted_chars
FROM e GROUP BY conv_id
"""
