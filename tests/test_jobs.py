from tidewater.sources.jobs import Breaker, Job


def test_breaker_states():
    b = Breaker(most=2, recovery_s=10)
    b.record(False, 0)
    assert b.state(0) == "closed"
    b.record(False, 1)
    assert b.state(5) == "open" and b.state(11) == "half_open"
    b.record(True, 12)
    assert b.state(12) == "closed"


def test_job_retries_then_reports():
    waits, calls, kept = [], [], []

    def fetch():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return "frame"

    job = Job("j", fetch, kept.append, sleep=waits.append, clock=lambda: 0.0)
    assert job.run_once() == {"name": "j", "status": "ok", "attempts": 3} and kept == ["frame"] and waits == [0.5, 1.0]
    bad = Job("b", lambda: 1 / 0, kept.append, retries=0, breaker=Breaker(most=1), sleep=waits.append, clock=lambda: 0.0)
    assert bad.run_once()["status"] == "failed" and bad.run_once()["status"] == "breaker_open"
    shut = Job("s", fetch, kept.append, gate=lambda now: False)
    assert shut.run_once()["status"] == "closed_market" and shut.run_once(force=True)["status"] == "ok"
