"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow and each document a packet of as many units as it has words. In a
pseudo-random but fixed order a document's virtual finish time is the number of its source's words
up to and including it, divided by the source's target. Sources below their target go round again
(up to ``most`` passes), each pass adding the source's size. Sorting all packets by finish time and
cutting at the total budget serves every source in proportion: each reaches its target at time 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosodia.llm.shared import materialize, running_sums, words_column

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.size(words_column(text)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, fraction: float = 1.0) -> DataFrame:
    """source, source_size -> with weight and target, one row a source.

    Sources by code point, null last, take the weights in turn. Targets share ``fraction`` of all
    words by weight; none exceeds ``most`` times its source, and what that leaves over is shared by
    weight among the others. With sources in order of most * size / weight, the stopped ones are a
    prefix, so prefix sums find the level that the others rise to without a loop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    w = w.withColumn("__stop", F.col("source_size") * float(most)).withColumn("__level", F.col("__stop") / F.col("weight"))
    up = Window.orderBy("__level", F.col("source").isNull(), "source")
    before, onward = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * fraction - F.coalesce(F.sum("__stop").over(before), F.lit(0.0))
    w = w.withColumn("__rise", left / F.sum("weight").over(onward))
    # the first source that the level does not fill fixes the level for all after it
    open_ = F.col("__rise") < F.col("__level")
    w = w.withColumn("__final", F.min(F.when(open_, F.struct(F.col("__level").alias("at"), F.col("__rise").alias("rise")))).over(everything)["rise"])
    target = F.when(F.col("__final").isNull(), F.col("__stop")).otherwise(F.least(F.col("__stop"), F.col("__final") * F.col("weight")))
    return w.select("source", "source_size", "weight", target.alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("__key"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("__crc"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, fraction: float = 1.0) -> DataFrame:
    """doc_id, source, __crc, size, source_size, target, taken, copies for every row; copies is taken / size.

    Order within a source: md5 of the doc_id's digits, then doc_id, then the text's checksum, so
    reruns agree and only rows equal in all three are interchangeable. Null text has size 0 and is
    never taken; null is a source like any other. An empty table gives no rows. Sources may be any
    number; only the table of their sizes is ordered in one place.
    """
    sized = materialize(_sized(docs), "sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, fraction)
    goal = materialize(goal.withColumnRenamed("source", "__source"), "targets")
    flow = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    queued = running_sums(sized.withColumn("__flow", flow), ["__flow", "__key", "doc_id", "__crc"], {"__cum": "size"}, group="__flow")
    queued = queued.join(goal, queued["source"].eqNullSafe(goal["__source"])).drop("__source")
    # passes that begin below the target can finish near it; later ones cannot be reached
    passes = F.filter(F.array(*[F.lit(p).cast("long") for p in range(most)]), lambda p: p * F.col("source_size") < F.col("target"))
    packets = queued.filter("size > 0").select("*", F.explode(passes).alias("__pass"))
    packets = packets.withColumn("__finish", (F.col("__cum") + F.col("__pass") * F.col("source_size")) / F.col("target"))
    # a source's running sum names its row: it grows with every row that has words
    packets = packets.select("__finish", "__key", "doc_id", "__crc", "__pass", "__flow", "__cum", "size")
    served = running_sums(packets, ["__finish", "__key", "doc_id", "__crc", "__pass"], {"__served": "size"})
    budget = goal.agg(F.round(F.sum("target")).cast("long").alias("__budget"))
    served = served.crossJoin(F.broadcast(budget)).filter("__served <= __budget")  # one row by construction
    times = served.groupBy(F.col("__flow").alias("__of"), F.col("__cum").alias("__at")).agg(F.count("*").alias("__times"))
    out = queued.join(times, (F.col("__flow") == F.col("__of")) & (F.col("__cum") == F.col("__at")) & (F.col("size") > 0), "left")
    copies = F.coalesce("__times", F.lit(0))
    return out.select("doc_id", "source", "__crc", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    Rows equal in doc_id, source and text are one row that is taken as often as they are together. Rows without
    words, null texts among them, fill no share and are not taken; null ids and sources are values like others;
    an empty table gives no rows. Columns __d, __s, __c, __copies, __rows and __copy are its own while it works.
    """
    taken = mix(docs, weights, most).filter("copies > 0").groupBy(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__crc").alias("__c")).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows"))
    taken = materialize(taken, "taken")
    crc = F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    # a row a document: as large a side as the texts' ids, so it is never a side to broadcast
    out = docs.join(taken.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__d")) & docs["source"].eqNullSafe(F.col("__s")) & (crc == F.col("__c")))
    # only rows of a group that has repeated ones need to meet
    once = out.filter("__rows = 1").unionByName(out.filter("__rows > 1").dropDuplicates(["__d", "__s", "__c"]))
    repeated = once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
