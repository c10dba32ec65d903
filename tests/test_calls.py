"""Calls of a model: stopped runs go on, dead providers are left alone, and calls keep to a budget."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pagemill.operators import calls, trial


def prompts(spark, n, start=0):
    return spark.createDataFrame([(f"k{i}", "s", f"prompt {i}") for i in range(start, start + n)], "key string, system string, user string").repartition(4)


def logging(path, answer):
    """A provider that writes down every call that it gets; made here, so that it travels to the workers by value."""

    def chat(system, user):
        with open(path, "a") as f:
            f.write(user + "\n")
        return answer(user)

    return chat


def asked(path):
    return open(path).read().splitlines() if os.path.exists(path) else []  # noqa: SIM115


def test_a_second_run_asks_nothing_twice(spark, tmp_path):
    log, path = f"{tmp_path}/asked", f"file://{tmp_path}/run"
    chat = logging(log, lambda u: u.upper())
    first = {r["key"]: r for r in calls.called(prompts(spark, 30), chat, path).collect()}
    assert len(asked(log)) == 30 and first["k7"]["reply"] == "PROMPT 7" and first["k7"]["calls"] == 1 and first["k7"]["chars"] == 9 and first["k7"]["error"] is None
    again = {r["key"]: r for r in calls.called(prompts(spark, 40), chat, path).collect()}
    assert len(again) == 40 and sorted(asked(log)) == sorted(f"prompt {i}" for i in range(40)) and again["k7"] == first["k7"]
    # a key with another text is another prompt
    other = prompts(spark, 1).withColumn("user", F.lit("other"))
    assert calls.called(other, chat, path).first()["reply"] == "OTHER" and len(asked(log)) == 41
    assert calls.called(prompts(spark, 0), chat, f"{path}-none").count() == 0


def test_a_killed_run_keeps_what_its_finished_tasks_asked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "TASK_ROWS", 4)
    log, path = f"{tmp_path}/asked", f"file://{tmp_path}/run"

    def dies(user):
        if user == "prompt 17":
            import time

            time.sleep(6)
            os._exit(1)  # as if the executor were lost, again and again
        return "fine"

    with pytest.raises(Exception, match="(?i)job aborted|failed|crashed"):
        calls.called(prompts(spark, 60), logging(log, dies), path).collect()
    before = asked(log)
    rows = {r["key"]: r["reply"] for r in calls.called(prompts(spark, 60), logging(log, lambda u: "later"), path).collect()}
    assert len(rows) == 60 and set(rows.values()) == {"fine", "later"}
    repeated = [u for u in set(asked(log)) if asked(log).count(u) > 1]
    assert "prompt 17" in repeated and len(repeated) <= 4 * 4  # at most the tasks that were at work
    assert len(before) > len(repeated)


def test_a_dead_provider_gets_few_calls(spark, tmp_path):
    log, path = f"{tmp_path}/asked", f"file://{tmp_path}/run"

    def down(user):
        raise RuntimeError("down")

    rows = calls.called(prompts(spark, 400), logging(log, down), path, most_errors=5).collect()
    assert len(rows) == 400 and all(r["reply"] is None and r["error"] for r in rows)
    assert 5 <= len(asked(log)) <= 5 + 2 * calls.FIRST_WAVE
    assert sum(r["error"] == "stopped" for r in rows) >= 380 and sum(r["calls"] for r in rows) == len(asked(log))
    # what failed is asked again by a later run
    after = calls.called(prompts(spark, 400), logging(log, lambda u: "up"), path).collect()
    assert all(r["reply"] == "up" and r["error"] is None for r in after)


def test_a_provider_that_dies_later_is_left_after_a_wave(spark, tmp_path):
    log = f"{tmp_path}/asked"

    def tires(user):
        if len(open(log).readlines()) > 60:  # noqa: SIM115
            raise RuntimeError("down")
        return "up"

    calls.called(prompts(spark, 500), logging(log, tires), f"file://{tmp_path}/run", wave=40).count()
    assert len(asked(log)) <= 60 + 5 + 2 * 60  # the wave it died in, and one more


def test_steps_share_a_breaker(spark, tmp_path):
    log, breaker = f"{tmp_path}/asked", calls.Breaker(3)

    def down(user):
        raise RuntimeError("down")

    for step in range(3):
        calls.called(prompts(spark, 50, 100 * step), logging(log, down), f"file://{tmp_path}/{step}", most_errors=3, breaker=breaker).count()
    assert breaker.open and len(asked(log)) <= 3 + 2 * calls.FIRST_WAVE
    fresh = calls.Breaker(4)
    fresh.see([(False, 2), (True, 1), (False, 2), (False, 1)])
    assert not fresh.open and fresh.streak == 3
    fresh.see([(False, 1), (True, 1)])
    assert fresh.open and fresh.streak == 0


def test_calls_keep_to_a_budget(spark, tmp_path):
    waits, now = [], [0.0]

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    call = calls.paced(lambda s, u: u, 0.5, clock=lambda: now[0], sleep=sleep)
    assert [call("", str(k)) for k in range(4)] == ["0", "1", "2", "3"] and waits == [0.5, 0.5, 0.5]
    log = f"{tmp_path}/asked"
    stamps = logging(log, lambda u: "x")

    def chat(system, user):
        import time

        return stamps(system, f"{time.time()}")

    calls.called(prompts(spark, 30), chat, f"file://{tmp_path}/run", per_minute=1200, wave=64).count()
    times = sorted(map(float, asked(log)))
    assert len(times) == 30
    most = max(sum(a <= t < a + 1 for t in times) for a in times)
    assert most <= 1200 / 60 + 5  # a second's share, and the first calls of the tasks


def test_replies_that_cannot_be_read_show_that_the_provider_lives(spark, tmp_path):
    log = f"{tmp_path}/asked"

    def odd(user):
        raise ValueError("no JSON")

    rows = calls.called(prompts(spark, 40), logging(log, odd), f"file://{tmp_path}/run", retries=0).collect()
    assert all(r["error"] == "ValueError: no JSON" and r["calls"] == 1 for r in rows) and len(asked(log)) == 40


def test_an_evaluation_run_goes_on_in_its_folder(spark, tmp_path):
    import json

    log, path = f"{tmp_path}/asked", f"file://{tmp_path}/run"
    text = "리스트는 순서가 있는 자료형이다. 여러 값을 담는다."

    def model(user):
        if user.startswith("[문제]"):
            return json.dumps({"determinable": True, "answer": "리스트"}, ensure_ascii=False)
        return json.dumps({"reject_reason": "없음", "question": "____는 순서가 있는 자료형이다.", "answer": "리스트"}, ensure_ascii=False)

    cases = spark.createDataFrame([(k, k % 2, f"c{k}") for k in range(5)], "id long, book_id long, concept string")

    def find(now, used):
        left = now.crossJoin(spark.range(3).select((F.col("id") + 1).cast("int").alias("rank"))).withColumn("unit_id", F.concat_ws("-", "book_id", "rank"))
        left = left.join(used, ["book_id", "unit_id"], "left_anti")
        return left.select("id", "rank", "unit_id", F.lit(text).alias("text"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("context"))

    first = sorted(map(tuple, trial.run_cases(cases, find, logging(log, model), path).select("id", "status", "unit_id", "calls").collect()))
    n = len(asked(log))
    assert n and all(r[1] == "출제" for r in first) and len({(k % 2, u) for k, _, u, _ in first}) == 5
    again = sorted(map(tuple, trial.run_cases(cases, find, logging(log, model), path).select("id", "status", "unit_id", "calls").collect()))
    assert again == first and len(asked(log)) == n
