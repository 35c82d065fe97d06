import os

import numpy as np

from noteloom.llm.common import tidy, tidy_group, tidy_groups


def held_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_workers_give_back_what_they_freed():
    """What a task has freed below something that it keeps goes back to the system at its end."""
    kept = []

    def run(*_):
        parts = [np.ones(12_000) for _ in range(2500)]
        kept.append(np.ones(1000))
        kept.extend(parts[::100])
        return iter(["done"])

    for call in (lambda: list(tidy(run)(iter([]))), lambda: list(tidy_group(run)(None)), lambda: list(tidy_groups(run)(None, None))):
        before = held_mb()
        assert call() == ["done"]
        assert held_mb() - before < 60
