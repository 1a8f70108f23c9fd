"""Mixing sources to target weights by hierarchical budgeting.

A tree of weights over domain, language and source says what share of a token
budget each node should get. Budgets go down the tree by weight. A node that
cannot use its budget (its documents, times the epochs allowed, hold fewer
tokens) hands the rest to its siblings first, by weight; only what no sibling
can use goes up to the ancestor's siblings.

A leaf then draws whole epochs and a prefix of one more. In each epoch its
documents stand in an order seeded by leaf and epoch, and the prefix ends with
the document that reaches the budget. The running token count is taken in two
steps, inside cells of the seeded order and then over the cells' sums, these in
two levels, so a leaf with a third of all rows is no task of its own.

Only the leaves' totals reach the driver: as many rows as there are distinct
paths in the tree, at most ``max_leaves``, else an error is raised.

Defined cases: a null in a level is a node of its own; leaves outside the
weight tree share evenly the weight ``other`` of their level; documents without
tokens are never drawn; texts of any length count in whole, and one above its
leaf's budget is the leaf's only draw where it comes first; repeated rows are
drawn one by one; an empty table
gives an empty result; columns other than key, levels and tokens are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import free_name, materialize, row_key, running_sums, words_of

Path = tuple[str | None, ...]


@dataclass
class Node:
    """A node of the tree: what it holds, its weight among its siblings, its children by name."""

    weight: float = 1.0
    capacity: float = 0.0
    children: dict[str | None, "Node"] = field(default_factory=dict)


def build_tree(capacities: dict[Path, float], weights: dict[Path, float] | None = None, other: float = 1.0) -> Node:
    """The tree over all leaves; a node's weight is ``weights[path]`` or else ``other``."""
    root = Node()
    for path, tokens in sorted(capacities.items(), key=lambda x: tuple((p is not None, p or "") for p in x[0])):
        node = root
        node.capacity += tokens
        for depth, name in enumerate(path):
            node = node.children.setdefault(name, Node((weights or {}).get(path[: depth + 1], other)))
            node.capacity += tokens
    return root


def share_out(budget: float, nodes: list[Node]) -> list[float]:
    """Fill siblings by weight; those that are full drop out and the rest is shared again."""
    given, open_, left = [0.0] * len(nodes), [i for i, n in enumerate(nodes) if n.weight > 0 and n.capacity > 0], budget
    while open_ and left > 1e-9:
        total = sum(nodes[i].weight for i in open_)
        full = [i for i in open_ if given[i] + left * nodes[i].weight / total >= nodes[i].capacity]
        if not full:
            for i in open_:
                given[i] += left * nodes[i].weight / total
            break
        for i in full:
            given[i] = nodes[i].capacity
        open_ = [i for i in open_ if i not in full]
        for i in open_:
            given[i] = 0.0
        left = budget - sum(given)
    return given


def leaf_budgets(root: Node, budget: float) -> dict[Path, float]:
    """Each leaf's share. Since siblings are filled before a shortage is seen above, ancestors come last."""
    out: dict[Path, float] = {}

    def down(node: Node, amount: float, path: Path) -> None:
        if not node.children:
            out[path] = amount
            return
        names = list(node.children)
        for name, part in zip(names, share_out(amount, [node.children[n] for n in names]), strict=True):
            down(node.children[name], part, (*path, name))

    def usable(node: Node) -> float:
        """What can be used below, as nodes of weight 0 get nothing."""
        if node.children:
            node.capacity = sum(usable(c) for c in node.children.values())
        if node.weight <= 0:
            node.capacity = 0.0
        return node.capacity

    root.weight = 1.0
    down(root, min(budget, usable(root)), ())
    return out


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    budget: float,
    weights: dict[Path, float] | None = None,
    max_epochs: int = 1,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    max_leaves: int = 200_000,
    cell_rows: int = 512,
) -> DataFrame:
    """One row per draw: key, the levels, n_tokens, ``epoch``, ``end_token`` (running count in its leaf and epoch).

    ``budget`` up to 1 is a share of all tokens, above 1 a number of tokens.
    """
    names = list(levels)
    rows = materialize(
        docs.select(F.col(key).alias("doc_id"), F.size(words_of(F.col(text))).cast("long").alias("n_tokens"), *[c.cast("string").alias(n) for n, c in levels.items()]),
        "mix-rows",
    )
    stats = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(max_leaves + 1).collect()
    if len(stats) > max_leaves:
        raise ValueError(f"more than {max_leaves} leaves; group sources first")
    held = {tuple(r[n] for n in names): float(r["tokens"]) for r in stats}
    total = sum(held.values())
    wanted = budget * total if budget <= 1 else budget
    shares = leaf_budgets(build_tree({p: t * max_epochs for p, t in held.items()}, weights), wanted)
    plan = [(*p, int(round(shares[p])), int(held[p]), max(1, -(-r["n"] // cell_rows))) for r in stats if (p := tuple(r[n] for n in names)) in shares and shares[p] >= 0.5]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_want", T.LongType()), T.StructField("_held", T.LongType()), T.StructField("_cells", T.LongType())])
    leaves = rows.sparkSession.createDataFrame(plan, schema)
    same = [rows[n].eqNullSafe(leaves[n]) for n in names]
    drawn = rows.filter("n_tokens > 0").join(F.broadcast(leaves), same).select("doc_id", "n_tokens", *[rows[n] for n in names], "_want", "_held", "_cells")
    # An epoch is drawn from as long as those before it have not met the budget.
    drawn = drawn.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("_want") - 1) / F.col("_held")).cast("int"))))
    drawn = drawn.withColumns({"_left": F.col("_want") - F.col("epoch") * F.col("_held"), "_at": F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"), *[F.col(n) for n in names])})
    # Cells are ranges of the seeded order, so the order of the cells is the order of the rows.
    drawn = drawn.withColumn("_cell", F.floor((F.shiftrightunsigned("_at", 1) / F.lit(float(2**63))) * F.col("_cells")).cast("long"))
    drawn = drawn.withColumn("_at", F.shiftrightunsigned("_at", 1))
    leaf = [*names, "epoch"]
    cells = running_sums(drawn.groupBy(*leaf, "_cell").agg(F.sum("n_tokens").alias("_sum")), leaf, "_cell", "_sum", "_before").drop("_sum")
    inner = Window.partitionBy(*leaf, "_cell").orderBy("_at", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = drawn.withColumn("_run", F.sum("n_tokens").over(inner))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*leaf, "_cell")]
    return (
        inside.alias("l").join(cells.alias("r"), on)
        .select("l.doc_id", *[f"l.{n}" for n in names], "l.n_tokens", "l.epoch", (F.col("r._before") + F.col("l._run")).alias("end_token"), "l._left")
        .filter(F.col("end_token") - F.col("n_tokens") < F.col("_left"))
        .drop("_left")
    )


def keep_drawn(docs: DataFrame, levels: dict[str, Column], budget: float, weights: dict[Path, float] | None = None, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that one epoch of the mix draws, with their columns."""
    row = free_name(docs)
    named = docs.withColumn(row, row_key(key, text))
    drawn = mix(named, levels, budget, weights, max_epochs=1, seed=seed, key=row, text=text).select(F.col("doc_id").alias(row))
    return named.join(drawn, row, "left_semi").select(*docs.columns)
