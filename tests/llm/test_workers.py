"""What a worker drops between operators."""

from __future__ import annotations

from spokeframe.llm.workers import forget, remembered


def test_forget_drops_all_but_what_is_named():
    made = []

    @remembered(maxsize=2)
    def one(x):
        made.append(("one", x))
        return x

    @remembered(maxsize=2)
    def two(x):
        made.append(("two", x))
        return x

    one(1), two(1)
    forget(two)
    one(1), two(1)
    assert made == [("one", 1), ("two", 1), ("one", 1)]
    forget()
    one(1), two(1)
    assert len(made) == 5
