"""Similar names meet on their remains: no pair is lost, and few pairs meet that are not similar."""

import random

from ledgerloom.config import Config
from ledgerloom.functions.similarity import score
from ledgerloom.operators import similar

CFG = Config()


def _name(rng, n, letters="ABCDEFGHIJKLMNOP"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_short_and_long_names_lose_no_pair(spark):
    rng = random.Random(3)
    base = [_name(rng, rng.randint(1, 16), "ABC") for _ in range(60)] + [_name(rng, 10) for _ in range(20)]
    other = [n[:i] + rng.choice(["", "A", "XB"]) + n[i + 1:] for n in base for i in (0, len(n) // 2)]
    other += ["ZZ" + n for n in base if len(n) > 9] + [n[:-2] for n in base if len(n) > 4]
    other = [n for n in other if n]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.left_name, r.right_name) for r in similar.similar_names(frame(other), frame(base), CFG).collect()}
    assert got == {(a, b) for a in other for b in base if score(a, b) >= CFG.similarity_threshold}


def test_pairs_that_meet_follow_the_names(spark):
    rng = random.Random(4)
    names = spark.createDataFrame([(_name(rng, 10),) for _ in range(3000)], "name string")
    met = similar._met(names, names, similar.meeting_plan(CFG.similarity_threshold))
    assert met.count() < 2 * 3000


def test_many_remains_are_left_to_letter_pairs():
    t = CFG.similarity_threshold
    assert max(similar.meeting_plan(t)) == 11
    assert similar.meetings(12, t) is None and similar.meetings(40, t) is None


def test_pieces_of_names_are_never_broadcast(spark):
    t = CFG.similarity_threshold
    names = spark.createDataFrame([("ACMETRADING",), ("ACMETRADNG",), ("GLOBALINDUSTRIALHOLDINGS",)], "name string")
    names = similar.written(similar._names(names), "names")  # a file this small promises a small join
    for pairs in (similar._met(names, names, similar.meeting_plan(t)), similar._candidates(names, names, t)):
        plan = pairs._jdf.queryExecution().sparkPlan().toString()
        pieces = [line for line in plan.split("\n") if "Join [m#" in line or "Join [mark#" in line and "Inner" in line]
        assert pieces and all("SortMergeJoin" in line for line in pieces)
        assert ("ACMETRADNG", "ACMETRADING") in {(r.short, r.long) for r in pairs.collect()}
