"""Progress of long runs: lines, remaining time, and wrappers around an action or a command."""

from __future__ import annotations

import os
import subprocess
import sys
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TextIO

# Statuses, and how lines, remaining times and durations are written; the columns of functions/text.py write the same.
STATUSES = ("START", "RUNNING", "DONE", "RETRY", "WARNING", "ERROR")
LINE, DETAIL = "[PROGRESS] {current}/{total} {stage} | {status}", " | {detail}"
ETA, ELAPSED = "elapsed={elapsed} eta={rest} progress={percent}%", "elapsed={elapsed}"
SHORT, LONG = "{seconds}s", "{minutes}m{seconds:02d}s"


def spelled(duration: float) -> str:
    minutes, seconds = divmod(int(duration) if duration > 0 else 0, 60)
    return (LONG if minutes else SHORT).format(minutes=minutes, seconds=seconds)


def line(current: int, total: int, stage: str, status: str, detail: str = "") -> str:
    if status not in STATUSES or current < 1 or current > total:
        raise ValueError(f"current is between 1 and total, status one of {', '.join(STATUSES)}")
    template = LINE + DETAIL if detail else LINE
    return template.format(current=current, total=total, stage=stage, status=status, detail=detail)


def eta(elapsed: int, expected: int) -> str:
    if elapsed < 0 or expected <= 0:
        raise ValueError("elapsed is at least 0 and expected above 0")
    return ETA.format(elapsed=spelled(elapsed), rest=spelled(expected - elapsed), percent=min(100, elapsed * 100 // expected))


@contextmanager
def watched(
    current: int, total: int, stage: str, expected: int = 0, heartbeat: float = 20.0, warning_after: float = 120.0,
    out: TextIO | None = None, detail: Callable[[], str] | None = None,
) -> Iterator[None]:
    """Lines while a Spark action runs: START, RUNNING at every heartbeat, WARNING once when it takes long, DONE or ERROR.

    ``detail`` may add to the running lines, such as active stages of the status tracker.
    """
    if heartbeat <= 0:
        raise ValueError("heartbeat is above 0")
    to, began, done = out or sys.stdout, time.monotonic(), threading.Event()

    def say(status: str, *parts: str) -> None:
        print(line(current, total, stage, status, " ".join(p for p in parts if p)), file=to, flush=True)

    def elapsed() -> str:
        return ELAPSED.format(elapsed=spelled(time.monotonic() - began))

    def beat() -> None:
        warnings = iter([warning_after])
        due = next(warnings)
        while not done.wait(heartbeat):
            spent = time.monotonic() - began
            if due is not None and spent >= due:
                due = next(warnings, None)
                say("WARNING", elapsed())
            say("RUNNING", eta(int(spent), expected) if expected else elapsed(), detail() if detail else "")

    say("START")
    thread = threading.Thread(target=beat, daemon=True)
    thread.start()
    status, said = "DONE", ""
    try:
        yield
    except BaseException as e:
        status, said = "ERROR", type(e).__name__
        raise
    finally:
        done.set()
        thread.join()
        say(status, said, elapsed())


def run(command: list[str], current: int, total: int, stage: str, out: TextIO | None = None, **settings) -> int:
    """A command under watch; its output, errors included, passes through line by line as it comes. Fails as the command does."""
    to = out or sys.stdout
    with watched(current, total, stage, out=to, **settings):
        unbuffered = {**os.environ, "PYTHONUNBUFFERED": "1"}
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, env=unbuffered) as process:
            for said in process.stdout:
                to.write(said)
                to.flush()
        if process.returncode:
            raise subprocess.CalledProcessError(process.returncode, command)
    return process.returncode


def active_stages(spark) -> str:
    """Active stages and their tasks, for the running lines."""
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return " ".join(f"stage={s.stageId} tasks={s.numCompletedTasks}/{s.numTasks}" for s in found if s)
