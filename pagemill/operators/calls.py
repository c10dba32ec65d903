"""Calls of a model: a log of what was asked, from which a stopped run goes on, in waves between which the run may stop.

Every prompt is a row. What it says (key, system and user text) is its digest; the log keeps a row for each prompt that was
asked, in files that a task adds as soon as it ends, so that a run that is killed loses what its unfinished tasks had
asked and no more. A run reads the log first and asks only for prompts without a reply in it.

Prompts go out in waves of a bounded number, the first one small. After each wave the driver looks at how it ended: once so
many calls in a row have failed, over all tasks and waves and steps that share a breaker, nothing is asked any more. A
budget of calls a minute is split among the tasks of a wave.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.providers import guarded
from ..sources.bucket_table import names_in
from ..sources.scratch import scratch_path, written

CALL_RETRIES, MAX_API_ERRORS = 2, 5
#: Prompts of the first wave, of each further wave, and of a task.
FIRST_WAVE, WAVE, TASK_ROWS = 8, 256, 16
STOPPED = "stopped"
LOG = "digest string, reply string, error string, calls long, chars long, answered boolean, part int, turn int, at long"


class Breaker:
    """How many calls in a row have failed by now in a run; open once they are too many. For the driver."""

    def __init__(self, most_errors: int = MAX_API_ERRORS):
        self.most_errors, self.streak, self.open = most_errors, 0, False

    def see(self, outcomes: list[tuple[bool, int]]) -> None:
        """Outcomes (whether the provider answered in the end, calls) of a wave, in their order."""
        for answered, calls in outcomes:
            self.streak = 0 if answered else self.streak + calls
            self.open = self.open or self.streak >= self.most_errors


def prompt_digest(*columns: str) -> Column:
    """A digest of a prompt; a null is not the empty text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def paced(chat: Callable[[str, str], str], interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, str], str]:
    """chat, called no sooner than interval seconds after the call before."""
    last = None

    def call(system: str, user: str) -> str:
        nonlocal last
        if last is not None and interval > 0:
            sleep(max(0.0, last + interval - clock()))
        last = clock()
        return chat(system, user)

    return call


def _log_of(prompts: DataFrame, path: str) -> DataFrame | None:
    spark = prompts.sparkSession
    # a part that was cut off may be there as an empty folder
    folders = [f"{path}/log/{n}" for n in names_in(spark, f"{path}/log") if any(f.endswith(".parquet") for f in names_in(spark, f"{path}/log/{n}"))]
    return spark.read.schema(LOG).parquet(*folders) if folders else None


def called(prompts: DataFrame, chat: Callable[[str, str], str], path: str, retries: int = CALL_RETRIES, most_errors: int = MAX_API_ERRORS, breaker: Breaker | None = None, wave: int = WAVE, per_minute: float | None = None, task_rows: int | None = None) -> DataFrame:
    """prompts (key, system, user) -> (key, reply, error, calls, chars), a row for each row of prompts.

    chat(system, user) gives a text; it is tried again up to retries times. The log under path is read first and added to;
    a prompt with a reply in it is not asked again, one with an error is. Once most_errors calls in a row have failed
    (breaker: shared by several steps of a run) nothing is asked any more, and prompts without a reply in the log have the
    error "stopped". calls and chars count what this prompt has cost over all runs. per_minute bounds the calls a minute
    over all tasks; wave and task_rows are for models that are so fast that a wave's job costs more than its calls. A key may be repeated; rows equal in key and texts share a reply.
    """
    spark = prompts.sparkSession
    breaker = breaker or Breaker(most_errors)
    asked = written(prompts.select("key", F.coalesce("system", F.lit("")).alias("system"), F.coalesce("user", F.lit("")).alias("user")).withColumn("digest", prompt_digest("key", "system", "user")), "prompts")
    log = _log_of(prompts, path)
    left = asked.dropDuplicates(["digest"])
    if log is not None:
        left = left.join(log.where("reply is not null").select("digest").distinct(), "digest", "left_anti")
    count = left.count()
    if count and not breaker.open:
        # waves by a hash: about FIRST_WAVE prompts, then about `wave` in each
        share = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / float(1 << 30) * count
        number = F.when(share < FIRST_WAVE, 0).otherwise(1 + F.floor((share - FIRST_WAVE) / wave)).cast("int")
        queue = scratch_path(spark, "queue")
        left.withColumn("wave", number).repartition("wave").write.partitionBy("wave").parquet(queue)
        for n in sorted(int(x.removeprefix("wave=")) for x in names_in(spark, queue) if x.startswith("wave=")):
            if breaker.open:
                break
            rows = spark.read.schema(asked.schema).parquet(f"{queue}/wave={n}")
            tasks = -(-(FIRST_WAVE if n == 0 else wave) // (task_rows or TASK_ROWS))
            part = f"{path}/log/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            asked_now = _asked(rows.repartition(tasks), chat, retries, most_errors, 60 * tasks / per_minute if per_minute else 0.0)
            # version 2: what a task has written stays, whatever becomes of the job
            asked_now.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(part)
            if names := names_in(spark, part):
                told = spark.read.schema(LOG).parquet(part).select("part", "turn", "answered", "calls") if any(x.endswith(".parquet") for x in names) else None
                breaker.see([(r["answered"], r["calls"]) for r in told.orderBy("part", "turn").collect()] if told is not None else [])  # a wave
        log = _log_of(prompts, path)
    replies = asked.select("key", "digest")
    if log is None:
        none = F.lit(None).cast("string")
        return replies.select("key", none.alias("reply"), F.lit(STOPPED).alias("error"), F.lit(0).cast("long").alias("calls"), F.lit(0).cast("long").alias("chars"))
    best = F.max_by(F.struct("reply", "error"), F.struct(F.col("reply").isNotNull(), "at"))
    known = log.groupBy("digest").agg(best.alias("r"), F.sum("calls").alias("calls"), F.sum("chars").alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    error = F.when(F.col("r").isNull(), STOPPED).otherwise(F.col("r.error"))
    return replies.join(known, "digest", "left").select("key", F.col("r.reply").alias("reply"), error.alias("error"), zero("calls"), zero("chars"))


def _asked(rows: DataFrame, chat: Callable[[str, str], str], retries: int, most_errors: int, interval: float) -> DataFrame:
    """rows (digest, system, user) as rows of the log; those that a task's own breaker kept from being asked are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, part, turn = guarded(paced(chat, interval), retries, most_errors), TaskContext.get().partitionId(), 0
        for b in batches:
            out = []
            for digest, system, user in zip(b["digest"], b["system"], b["user"], strict=True):
                reply, error, calls = ask(system, user)
                if calls:
                    answered = reply is not None or error.startswith("ValueError")
                    out.append((digest, reply, error, calls, calls * (len(system) + len(user)), answered, part, turn, time.time_ns()))
                turn += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")], dtype=object)

    return rows.select("digest", "system", "user").mapInPandas(run, LOG)
