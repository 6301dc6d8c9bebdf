"""Postings are many times the fingerprints that Spark sizes them by, so they must not be broadcast."""
import random

from doppel.llm import simhash


def test_postings_are_not_broadcast_however_few_the_fingerprints_seem(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(63) for _ in range(300)]
    fps += [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for x in fps[:100]]
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = {tuple(r) for r in found.collect()}
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= simhash.MAX_BITS}
    assert got == want and want
    plan = found._jdf.queryExecution().executedPlan().toString()  # the final one, as adaptive execution made it
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
