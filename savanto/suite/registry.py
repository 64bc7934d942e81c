"""Registration of queries and the table bindings they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savanto.session import tune


@dataclass(frozen=True)
class Case:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its SQL counterpart if there is one."""

    def keep(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        CASES[name] = Case(name, run, sql)
        return fn

    return keep


class Tables:
    """The given tables and the domain views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def profiles(self) -> DataFrame:
        listed = self.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
        joined = self.customer.join(listed, F.col("o_custkey") == F.col("c_custkey"), "left")
        return joined.select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("screen_name"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("description"),
            (F.col("c_acctbal") > 5000).alias("verified"),
            F.coalesce("n", F.lit(0)).alias("listed_count"),
        )

    def lists(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("list_id"),
            F.col("p_name").alias("name"),
            F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        )

    def member_of(self) -> DataFrame:
        # not broadcast: of a small file of orders the two keys are many times its share
        pairs = self.orders.hint("merge").join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        return pairs.select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("list_id")
        ).distinct()

    def follows(self) -> DataFrame:
        pairs = self.orders.join(self.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
        return pairs.select(
            F.col("o_custkey").alias("follower"), (F.col("l_suppkey") + 1000000).alias("followee")
        ).distinct()

    def _topic_experts(self, network: str, topic, score: str) -> DataFrame:
        # summed by key first, so that only the small totals meet the names
        totals = self.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.sum(score).alias("score"))
        rows = totals.join(self.part, F.col("p_partkey") == F.col("l_partkey")).join(
            self.supplier, F.col("s_suppkey") == F.col("l_suppkey")
        )
        return rows.groupBy(
            F.lit(network).alias("network"), topic.alias("topic"), F.col("s_name").alias("expert")
        ).agg(F.sum("score").alias("score"))

    def se_topic_experts(self) -> DataFrame:
        return self._topic_experts("stackexchange", F.col("p_name"), "l_quantity")

    def q_topic_experts(self) -> DataFrame:
        words = F.split("p_name", " ")
        flipped = F.concat_ws(" ", words[1], words[0])
        return self._topic_experts("quora", flipped, "l_extendedprice")

    def crosswalk(self) -> DataFrame:
        """Expert name to screen name, one row per linked account."""
        rows = self.supplier.join(self.customer, F.col("s_suppkey") == F.col("c_custkey"))
        return rows.select(
            F.col("s_name").alias("expert"),
            F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("screen_name"),
        )

    def items(self) -> DataFrame:
        return self.conversations.select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "conv_id", "turn", "role", "text"
        )


# The same views as SQL bodies, in dependency order.
VIEWS = {
    "profiles": """select c_custkey as user_id, 'user_' || c_custkey as screen_name, c_name as name,
        c_mktsegment as description, c_acctbal > 5000 as verified, coalesce(o.n, 0) as listed_count
        from customer left join (select o_custkey, count(*) as n from orders group by 1) o
        on o.o_custkey = c_custkey""",
    "lists": "select p_partkey as list_id, p_name as name, p_type || ' ' || p_brand as description from part",
    "member_of": """select distinct o_custkey as user_id, l_partkey as list_id
        from orders join lineitem on o_orderkey = l_orderkey""",
    "follows": """select distinct o_custkey as follower, 1000000 + l_suppkey as followee
        from orders join lineitem on o_orderkey = l_orderkey""",
    "se_topic_experts": """select 'stackexchange' as network, p_name as topic, s_name as expert,
        sum(l_quantity) as score from lineitem join part on p_partkey = l_partkey
        join supplier on s_suppkey = l_suppkey group by all""",
    "q_topic_experts": """select 'quora' as network,
        split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) as topic, s_name as expert,
        sum(l_extendedprice) as score from lineitem join part on p_partkey = l_partkey
        join supplier on s_suppkey = l_suppkey group by all""",
    "crosswalk": """select s_name as expert, 'user_' || c_custkey as screen_name
        from supplier join customer on s_suppkey = c_custkey""",
    "items": "select conv_id * 1000 + turn as item_id, conv_id, turn, role, text from conversations",
}


def with_views(body: str, *extra: tuple[str, str]) -> str:
    """Prefix a query with every shared view it names, then the given extra ones."""
    text = body + " ".join(sql for _, sql in extra)
    parts = [f"{n} as ({sql})" for n, sql in VIEWS.items() if n in text]
    parts += [f"{n} as ({sql})" for n, sql in extra]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
