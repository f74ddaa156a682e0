"""Items of varying size put into containers of fixed capacity, with little space left over.

Vector best fit: an item demands tokens, one of the documents a container may hold, and attention cost (its size squared, as items
attend to themselves only). The largest items go first; each goes to the open container that fits under every capacity and
is left with the smallest weighted residual norm, or has the largest weighted dot product of demand and residual. An item whose
attention cost alone is above that capacity cannot be split for it and has a container to itself. Items are packed in groups of
bounded size side by side; containers that end up poorly filled are opened again and their items packed together in the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.llm.tokens import count_tokens
from lumatable.runtime import materialize, ship, table

CAPACITY = 2_048


@dataclass(frozen=True)
class Limits:
    """Capacities of a container, the weights of their residuals, and the rule that chooses among containers that fit.

    Attention is held at 0.75 of what one full-length item costs, so that no container takes much longer than others; documents
    at 96, the entries of a container's table of starts.
    """

    tokens: int = CAPACITY
    documents: int = 96
    attention: float = 0.75 * CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"


#: Items of a group, share of the tokens from which a container counts as well filled, and rounds at most.
GROUP_ITEMS, WELL_FILLED, ROUNDS = 8_192, 0.995, 4


def best_fit(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """The container number of each item; items must be in order of falling size, each within the tokens."""
    full = np.array([limits.tokens, limits.documents, limits.attention], dtype=float)
    weights = np.array(limits.weights)
    demand = np.column_stack([sizes, np.ones(len(sizes)), sizes.astype(float) ** 2]) / full
    left = np.empty((len(sizes) + 1, 3))  # shares of each capacity left in the open containers
    number = np.empty(len(sizes) + 1, dtype=np.int64)
    open_n, made, out = 0, 0, np.empty(len(sizes), dtype=np.int64)
    least = float(sizes.min()) / full[0] if len(sizes) else 0.0
    for i, d in enumerate(demand):
        if d[2] > 1:  # alone above the attention capacity
            out[i], made = made, made + 1
            continue
        rest = left[:open_n] - d
        fits = np.nonzero((rest >= -1e-9).all(axis=1))[0]
        if len(fits):
            if limits.rule == "dot":
                at = fits[int(((left[fits] * d) @ weights).argmax())]
            else:
                at = fits[int((rest[fits] ** 2 @ weights).argmin())]
        else:
            at, open_n = open_n, open_n + 1
            left[at], number[at], made = 1.0, made, made + 1
        left[at] -= d
        out[i] = number[at]
        if left[at, 0] < least - 1e-9 or left[at, 1] < 1 / full[1] - 1e-9:  # nothing fits any more: the last one takes its place
            open_n -= 1
            left[at], number[at] = left[open_n], number[open_n]
    return out


def pack(sizes: DataFrame, limits: Limits = Limits(), group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, piece, n_tokens, container_id, first_token) of documents (doc_id, n_tokens), one row each.

    A text is whole in one container (piece 0) unless it alone is longer than the capacity; then its full pieces each fill a
    container and its rest is an item like others. Texts without tokens take no space and have a null container_id. Rows with
    a null doc_id or size are dropped. Pieces of a container lie one after the other from first_token.
    """
    spark = sizes.sparkSession
    ship(spark)
    c = limits.tokens
    known = sizes.where("doc_id is not null and n_tokens is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("int").alias("n"))
    empty = known.where("n <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("int").alias("first_token"))
    cut = known.where("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.call_function("div", F.col("n") - 1, F.lit(c)).cast("int"))).alias("piece"), "n").select("doc_id", "piece", F.least(F.lit(c), F.col("n") - F.col("piece") * c).alias("n_tokens"))
    done = [empty, cut.where(F.col("n_tokens") == c).select("doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container_id"), F.lit(0).alias("first_token"))]
    waiting = materialize(cut.where(F.col("n_tokens") < c), "items")
    schema = "doc_id bigint, piece int, n_tokens int, container_id string, first_token int, filled int"
    for turn in range(ROUNDS):
        n = waiting.count()
        groups = max(1, -(-n // group_items))

        def group(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
            items = items.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
            at = best_fit(items.n_tokens.to_numpy(), limits)
            by = items.groupby(at).n_tokens
            name = f"{items.turn.iloc[0]}-{key[0]}-"
            return pd.DataFrame({"doc_id": items.doc_id, "piece": items.piece, "n_tokens": items.n_tokens, "container_id": [name + str(x) for x in at], "first_token": (by.cumsum() - items.n_tokens).astype("int32"), "filled": by.transform("sum").astype("int32")})

        hashed = waiting.withColumn("group_id", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(groups)).cast("int")).withColumn("turn", F.lit(turn))
        hashed = hashed.repartition(2 * groups, "group_id")  # a number of its own, else small groups are put into one task
        packed = materialize(hashed.groupBy("group_id").applyInPandas(group, schema), "packed")
        last = groups == 1 or turn == ROUNDS - 1
        # containers of one costly item cannot be filled any better
        settled = (F.col("filled") >= int(c * WELL_FILLED)) | (F.col("n_tokens").cast("double") ** 2 > limits.attention)
        done.append((packed if last else packed.where(settled)).drop("filled"))
        if last:
            break
        waiting = packed.where(~settled).select("doc_id", "piece", "n_tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p9_containers: each text's place in containers of 2,048 tokens of the byte-level vocabulary."""
    return pack(materialize(count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")), "sizes"))


def tightness(packed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(constraint, n_containers, fill): how many containers each constraint closes, as the one with the smallest share left, and the
    share of the tokens that these containers use."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens").cast("double") ** 2).alias("cost"))
    shares = F.struct((F.col("n") / limits.tokens).alias("share"), F.lit("tokens").alias("constraint")), F.struct((F.col("docs") / limits.documents).alias("share"), F.lit("documents").alias("constraint")), F.struct((F.col("cost") / limits.attention).alias("share"), F.lit("attention").alias("constraint"))
    tight = F.when(F.col("n") == limits.tokens, "tokens").otherwise(F.greatest(*shares)["constraint"])
    return used.groupBy(tight.alias("constraint")).agg(F.count(F.lit(1)).alias("n_containers"), (F.sum("n") / (F.count(F.lit(1)) * limits.tokens)).alias("fill"))


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p9_constraints: which constraint closes how many of the corpus's containers, and how full they are."""
    return tightness(containers(spark, sf_dir))
