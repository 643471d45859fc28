"""Count-based bigram model and perplexity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import bigrams, words
from textloom.operators.batching import DEFAULT_BATCH, assign_batches
from textloom.session import new_dir
from textloom.sources.sinks import materialise

ADD_K = 0.1
# Pairs to be scored that are sent to the model's tasks, at most; with more, the planner decides.
MOST_SENT = 200_000


@dataclass(frozen=True)
class BigramModel:
    """``pairs(prev, token, n)`` and ``tokens(token, followed, n)``: how often a token comes first, and at all."""

    pairs: DataFrame
    tokens: DataFrame
    k: float = ADD_K

    @classmethod
    def of_pairs(cls, pairs: DataFrame, k: float = ADD_K) -> BigramModel:
        zero = F.lit(0).cast("bigint")
        first = F.struct(F.col("prev").alias("token"), F.col("n").alias("followed"), zero.alias("n"))
        second = F.struct(F.col("token").alias("token"), zero.alias("followed"), F.col("n").alias("n"))
        sides = pairs.select(F.inline(F.array(first, second)))
        tokens = sides.groupBy("token").agg(F.sum("followed").alias("followed"), F.sum("n").alias("n"))
        return cls(pairs, tokens, k)

    @classmethod
    def load(cls, spark: SparkSession, path: str, k: float = ADD_K) -> BigramModel:
        return cls(spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/tokens"), k)

    def save(self, path: str) -> BigramModel:
        """Write the counts to a shared folder; go on with what this returns, so that texts are counted once only."""
        spark = self.pairs.sparkSession
        self.pairs.write.parquet(f"{path}/pairs")
        BigramModel.of_pairs(spark.read.parquet(f"{path}/pairs")).tokens.write.parquet(f"{path}/tokens")
        return BigramModel.load(spark, path, self.k)

    def contexts(self) -> DataFrame:
        return self.tokens.where(F.col("followed") > 0).select(F.col("token").alias("prev"), "followed")

    def size(self) -> Column:
        """Distinct tokens and one more for all unseen ones, as a scalar subquery."""
        return self.tokens.where(F.col("n") > 0).agg((F.count(F.lit(1)) + 1).alias("v")).scalar()


def _pairs_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    tokens = df.select(*keep, words(F.col(text)).alias("__t"))
    return tokens.select(*keep, F.inline(bigrams(F.col("__t"))).alias("prev", "token")).where(F.col("token").isNotNull())


def fit_bigrams(df: DataFrame, text: str = "text", k: float = ADD_K) -> BigramModel:
    """Count ``(prev, token)`` over all texts; each text starts with a start mark. Counts combine before the shuffle.

    Nothing is computed yet. ``save`` the model before scoring, which reads the counts several times.
    """
    counted = _pairs_of(df, text).groupBy("prev", "token").agg(F.count(F.lit(1)).alias("n"))
    return BigramModel.of_pairs(counted, k)


def score_texts(df: DataFrame, model: BigramModel, key: str, text: str = "text") -> DataFrame:
    """Mean negative log-likelihood per row as ``(key, n_tokens, loss)``; a text without words has a null loss.

    Rows with one text share its score, so null and repeated keys come back like any others. Texts are split once and
    never shuffled: their pairs are counted by the digest of the text. Only the pairs and contexts that the texts have
    meet the model, by inner joins, to which they are sent if there are up to ``MOST_SENT``, so that the model is not
    shuffled; else the planner may send either side. Those that it does not know are added where the texts' own pairs are
    scored.
    """
    marked = df.select(key, F.col(text).alias("__text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("__digest"))
    counted = _pairs_of(marked, "__text", "__digest").groupBy("__digest", "prev", "token").agg(F.count(F.lit(1)).alias("c"))
    counted = materialise(counted, new_dir(df.sparkSession, "pairs-to-score"))
    sent = F.broadcast if counted.count() <= MOST_SENT else (lambda table: table)
    seen = model.pairs.select("prev", "token", "n").join(sent(counted.select("prev", "token").distinct()), ["prev", "token"])
    contexts = model.contexts().join(sent(counted.select("prev").distinct()), "prev")
    in_context = counted.join(seen, ["prev", "token"], "left").join(contexts, "prev", "left")
    probability = (F.coalesce("n", F.lit(0)) + model.k) / (F.coalesce("followed", F.lit(0)) + model.k * model.size())
    scored = in_context.groupBy("__digest").agg(
        F.sum("c").alias("__pairs"), (-F.sum(F.col("c") * F.ln(probability)) / F.sum("c")).alias("loss")
    )
    # a text's pairs were counted once per row that has it, which the mean does not see
    copies = marked.groupBy("__digest").agg(F.count(F.lit(1)).alias("__copies"))
    scored = scored.join(copies, "__digest").select("__digest", F.expr("__pairs div __copies").alias("n_tokens"), "loss")
    found = marked.drop("__text").join(scored, "__digest", "left").drop("__digest")
    return found.withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0).cast("bigint")))


def perplexity(df: DataFrame, loss: str = "loss", weight: str | None = None) -> DataFrame:
    """``exp(sum(loss * weight) / sum(weight))``; null over no rows.

    Without a weight each row counts once. That is also the value of batch means weighted by batch rows, whatever the
    batches, so rows need no batches here. Give a batch's row count as the weight if the losses are per batch already.
    """
    w = F.lit(1.0) if weight is None else F.when(F.col(loss).isNotNull(), F.col(weight).cast("double"))
    known: Column = F.sum(F.col(loss) * w) / F.sum(F.when(F.col(loss).isNotNull(), w))
    return df.agg(F.count(loss).alias("n_rows"), F.exp(known).alias("perplexity"))


def perplexities(df: DataFrame, weights: dict[str, str | None], loss: str = "loss") -> DataFrame:
    """``(weighted_by, n_rows, perplexity)`` for several weights in one pass."""
    parts = []
    for name, weight in weights.items():
        w = F.when(F.col(loss).isNotNull(), F.lit(1.0) if weight is None else F.col(weight).cast("double"))
        parts.append(F.struct(F.lit(name).alias("weighted_by"), F.exp(F.sum(F.col(loss) * w) / F.sum(w)).alias("perplexity")))
    return df.agg(F.count(loss).alias("n_rows"), F.array(*parts).alias("p")).select("n_rows", F.inline("p"))


def batch_losses(df: DataFrame, key: str, loss: str = "loss", batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """Mean loss and rows of each consecutive batch."""
    batched = assign_batches(df.select(key, loss), key, batch_size)
    return batched.groupBy("batch_id").agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n_rows"))
