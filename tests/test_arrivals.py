"""State of the balance rule over a stream: what is read and written of it."""

from pyspark.sql import Row

from tallyspark.streaming.statements import ChainKeeper

IN = Row("idx", "amount_cents", "balance_cents")


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


class Map:
    def __init__(self):
        self.values, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {"exists": lambda: bool(self.values), "containsKey": self.values.__contains__, "getValue": self.values.__getitem__, "removeKey": self.values.pop, "updateValue": self.values.__setitem__}[name]


def keeper():
    k = ChainKeeper(1, None)
    k.last, k.waiting = Value(), Map()
    return k


def test_rows_that_complete_each_other_leave_the_state_alone():
    k = keeper()
    out = list(k.handleInputRows((7,), iter([IN(n, 1, 10 + n) for n in (5, 3, 1, 4, 2, 6, 8)]), None))
    assert [(r.idx, r.previous, r.agrees, r.late) for r in out] == [(1, None, None, False), *[(n, 9 + n, True, False) for n in range(2, 7)]]
    assert k.waiting.values == {(8,): (1, 18)} and k.last.value == (6, 16) and k.last.calls + k.waiting.calls <= 4


def test_a_row_that_waited_is_given_out_if_another_of_its_number_comes_with_the_missing_one():
    k = keeper()
    assert list(k.handleInputRows((7,), iter([IN(2, 1, 11), IN(3, 1, 12)]), None)) == []
    out = list(k.handleInputRows((7,), iter([IN(1, 0, 10), IN(2, 5, 99), IN(4, 1, 13)]), None))
    assert sorted((r.idx, r.balance_cents, r.late) for r in out) == [(1, 10, False), (2, 11, False), (2, 99, True), (3, 12, False), (4, 13, False)]
    assert k.waiting.values == {} and k.last.value == (4, 13)
