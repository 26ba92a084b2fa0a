"""Every operator id of the blueprint has a query."""

from gridspark.queries import QUERIES

#: Operators of each group, numbered from 1.
GROUPS = {"s": 15, "f": 13, "t": 21, "g": 14, "m": 11, "j": 12, "a": 27, "w": 19, "h": 6, "d": 13, "n": 9, "r": 10, "k": 11, "q": 7, "u": 6, "x": 6, "c": 10, "st": 1, "ud": 1}


def test_every_operator_has_a_query():
    have = {name.split("_")[0] for name in QUERIES}
    assert [f"{g}{i:02d}" for g, n in GROUPS.items() for i in range(1, n + 1) if f"{g}{i:02d}" not in have] == []
