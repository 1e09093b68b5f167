import collections
import os
from dataclasses import dataclass

from loomset.streaming import remote_jobs as rj


@dataclass(frozen=True)
class Service:
    """A service that keeps its books in a folder, so that all tasks see the same one."""

    home: str
    waiting: int = 0

    def _note(self, kind, name):
        os.close(os.open(f"{self.home}/{kind}-{name}-{os.urandom(4).hex()}", os.O_CREAT | os.O_EXCL))

    def count(self, kind):
        return collections.Counter(n.split("-")[1] for n in os.listdir(self.home) if n.startswith(f"{kind}-"))

    def backlog(self):
        return self.waiting

    def submit(self, request):
        if request == "turned down":
            raise ValueError("no such node")
        self._note("submit", request)
        return request

    def status(self, ticket):
        self._note("status", ticket)
        if ticket == "breaks":
            return "error", "node 7: out of memory"
        if ticket == "nothing":
            return "done", ""
        if ticket == "away" and self.count("status")[ticket] < 2:
            raise ConnectionError("gone for a moment")
        if ticket == "never" or ticket == "slow" and self.count("status")[ticket] < 3:
            return "waiting", ""
        return "done", f"{ticket}.png"


def ask(spark, folder, jobs):
    spark.createDataFrame(jobs, "job string, request string").coalesce(1).write.mode("append").parquet(folder)


def test_jobs_end_once_and_survive_a_restart(spark, tmp_path):
    home = tmp_path / "service"
    home.mkdir()
    service, source, sink, state = Service(str(home)), str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    patience = rj.Patience(timeout_s=30, poll_s=0.5)
    ask(spark, source, [("a", "quick"), ("b", "slow"), ("c", "breaks"), ("d", "nothing"), ("e", "turned down"), ("f", "away"), ("g", "never"), (None, "lost")])
    query = rj.run_jobs(spark, source, service, sink, state, patience)
    try:
        rj.wait_for(spark, query, sink, 6, 120)
    finally:
        query.stop()
    ask(spark, source, [("h", "late"), ("g", "never")])
    query = rj.run_jobs(spark, source, service, sink, state, patience)
    try:
        got = {r.job: r for r in rj.wait_for(spark, query, sink, 8, 120).collect()}
    finally:
        query.stop()
    assert {k: r.state for k, r in got.items()} == {"a": "done", "b": "done", "c": "failed", "d": "failed", "e": "failed", "f": "done", "g": "lost", "h": "done"}
    assert got["b"].output == "slow.png" and got["b"].polls == 3 and got["c"].message == "node 7: out of memory" and got["e"].message == "no such node" and "30 s" in got["g"].message
    assert service.count("submit") == {k: 1 for k in ("quick", "slow", "breaks", "nothing", "away", "never", "late")}


def test_a_busy_service_gets_no_jobs_but_at_the_front(spark, tmp_path):
    for front, state in ((False, "refused"), (True, "done")):
        home = tmp_path / f"service-{front}"
        home.mkdir()
        service, at = Service(str(home), waiting=11), str(tmp_path / f"run-{front}")
        ask(spark, f"{at}-in", [("a", "quick")])
        query = rj.run_jobs(spark, f"{at}-in", service, f"{at}-out", f"{at}-state", rj.Patience(poll_s=0.5, front=front))
        try:
            [r] = rj.wait_for(spark, query, f"{at}-out", 1, 120).collect()
        finally:
            query.stop()
        assert r.state == state and bool(service.count("submit")) == front
