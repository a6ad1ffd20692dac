"""Components of alike names without all of their pairs."""

import random

from laddersmith.operators import aliases


def _names(spark, names):
    return spark.createDataFrame([(x, 1) for x in sorted(set(names))], "name string, n long")


def test_linking_leaves_the_components_as_they_are(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 8)))
    base = [f"{word()} {word()}" for _ in range(25)]
    names = base + [x[:-1] for x in base[:8]] + [x.replace("a", "b", 1) for x in base[5:15]] + [x.upper() for x in base[:4]] + [f"{word()} {x.split()[1]}" for x in base[10:18]]
    n = _names(spark, names)
    want = sorted(map(tuple, aliases.canonical(n, aliases.candidates(n)).collect()))
    assert want and sorted(map(tuple, aliases.canonical(n, aliases.linking(n)).collect())) == want


def test_names_of_one_family_are_linked_by_few_pairs(spark):
    n = _names(spark, [f"team supplier {i}" for i in range(1, 300)] + ["team supplier"])
    assert aliases.linking(n).count() < 10 * 300 < aliases.candidates(n).count()
