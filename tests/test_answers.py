import collections
import os
import threading

import pytest
from pyspark.errors import PySparkException

from loomset.operators import batch, captioning
from loomset.operators.answers import AnswerLog


def counting(folder, dies_at=()):
    """A backend that notes each call in a file of its own before it answers."""

    def opened(model, options):
        def answer(x):
            if x in dies_at:
                os._exit(3)
            os.close(os.open(f"{folder}/{x}-{os.getpid()}-{os.urandom(4).hex()}", os.O_CREAT | os.O_EXCL))
            if x == "bad":
                raise ValueError("no image")
            return f"{x} seen"

        return answer

    return captioning.Backend("cloud", opened, "m")


def calls(folder):
    return collections.Counter(name.split("-")[0] for name in os.listdir(folder))


def images(spark, n, parts=4):
    return spark.createDataFrame([(i, f"x{i}", "") for i in range(n)], "ord long, content string, caption string").repartition(parts)


def test_each_image_is_asked_once_in_order(spark, tmp_path):
    rows = images(spark, 20)
    done = captioning.caption_images(rows.unionByName(rows), counting(tmp_path))
    assert [r.ord for r in done.collect()] == list(range(20)) and done.count() == 20 and done.where("ord > 10").count() == 9
    assert calls(tmp_path) == {f"x{i}": 1 for i in range(20)}


@pytest.mark.parametrize("journal", [True, False])
def test_a_killed_run_is_taken_up(spark, tmp_path, journal):
    asked, log = tmp_path / "asked", AnswerLog(str(tmp_path / "log"), str(tmp_path / "journal") if journal else "", parallel=1, each=4)
    asked.mkdir()
    rows = images(spark, 15, 1)
    with pytest.raises(PySparkException):
        captioning.caption_images(rows, counting(asked, dies_at=("x10",)), log=log)
    assert set(calls(asked)) == {f"x{i}" for i in range(10)}
    done = captioning.caption_images(rows, counting(asked), log=log).collect()
    assert [(r.ord, r.output) for r in done] == [(i, f"x{i} seen") for i in range(15)]
    # Without a journal the answers of the batch that wasn't done are asked for again, x8 and x9 here.
    assert calls(asked) == {f"x{i}": 1 if journal or i not in (8, 9) else 2 for i in range(15)}
    assert not journal or not list((tmp_path / "journal").iterdir())


def test_failures_are_asked_again_and_answers_are_not(spark, tmp_path):
    asked, log = tmp_path / "asked", AnswerLog(str(tmp_path / "log"))
    asked.mkdir()
    rows = spark.createDataFrame([(1, "ok", ""), (2, "bad", ""), (3, None, ""), (None, "lost", "")], "ord long, content string, caption string")
    for n in (1, 2):
        done = captioning.caption_images(rows, counting(asked), log=log).collect()
        assert [(r.ord, r.output, r.error) for r in done] == [(1, "ok seen", ""), (2, None, "no image"), (3, None, "there is nothing to send")]
        assert calls(asked) == {"ok": 1, "bad": n}
    done = captioning.caption_images(rows.replace({"bad": "good"}, subset="content"), counting(asked), log=log).collect()
    assert done[1].output == "good seen" and calls(asked)["ok"] == 1
    assert captioning.caption_images(rows.limit(0), counting(asked), log=log).collect() == []


def test_a_torn_line_of_the_journal_is_no_answer(spark, tmp_path):
    journal = batch.Journal(str(tmp_path))
    journal.note("1.0", 3, 7, "seven\nlines")
    with open(tmp_path / "1.0-3.jsonl", "a") as out:
        out.write('{"key": 8, "outp')
    journal.note("1.1", 0, 9, "nine")
    assert journal.told("1.0") == {7: "seven\nlines"}
    assert sorted(map(tuple, journal.answers(spark, "ord", "long").collect())) == [(7, "seven\nlines"), (9, "nine")]


def test_calls_of_eight_tasks_keep_the_spacing(tmp_path):
    """Eight tasks on their own clocks: one slot for a call, never nearer than the spacing."""
    pace, made, held = batch.Pace(str(tmp_path / "slots"), 3.0), [], threading.Lock()

    def task(k):
        clock = [1000.0 + k / 7]

        def step():
            with held:
                made.append(clock[0])
            clock[0] += (k * 5) % 11

        for _ in range(12):
            batch.call(step, batch.Retries(), pace, lambda s: clock.__setitem__(0, clock[0] + s), lambda: clock[0])

    tasks = [threading.Thread(target=task, args=(k,)) for k in range(8)]
    for t in tasks:
        t.start()
    for t in tasks:
        t.join()
    made.sort()
    assert len(made) == 96 and min(b - a for a, b in zip(made, made[1:], strict=False)) >= 3.0 - 1e-6


def test_processes_share_the_slots(spark, tmp_path):
    pace = batch.Pace(str(tmp_path / "slots"), 10.0)
    slots = spark.sparkContext.parallelize(range(40), 8).map(lambda _: pace.claim(5000.0)).collect()
    assert sorted(slots) == [5000.0 + 10 * i for i in range(40)]


def test_too_many_requests_put_off_everyone(tmp_path):
    class Busy(Exception):
        def __init__(self, code):
            self.code = code

    clock, slept, said = [0.0], [], iter([429, 429, 503, 429, None])

    def sleep(s):
        slept.append(s)
        clock[0] += s

    def step():
        if code := next(said):
            raise Busy(code)
        return "done"

    pace = batch.Pace(str(tmp_path / "slots"), 1.0)
    with pytest.raises(Busy):
        batch.call(step, batch.Retries(), pace, sleep, lambda: clock[0])
    assert slept == [5.0, 10.0] and clock[0] == 15.0  # the third failure was no 429, and the third try
    assert batch.call(step, batch.Retries(tries=9, limited_tries=9), pace, sleep, lambda: clock[0]) == "done"
    assert pace.claim(0.0) >= clock[0]
    assert [batch.Retries().after(429, k) for k in (1, 2, 3, 4)] == [5.0, 10.0, 15.0, None]
    assert [batch.Retries().after(503, k) for k in (1, 2, 3)] == [2.0, 4.0, None] and batch.Retries().after(400, 1) is None
