"""The Markov models of operator 5, held against identifiers and random strings that they have not learned from."""

import keyword
import math
import random
import re
import string

import pytest

from siftline.llm import secrets

SF = "/root/testdata/sf0.01"
# Words of identifiers, none of which the operator has among its own.
OTHER = """
abstract affinity allocate ancestor archive asynchronous audit barrier bootstrap broadcast checkpoint collation compile
compress coordinate credential cursor deadline decimal delegate dependency descriptor destroy diagnostic digest dispatch
driver eligible embed evaluate evict executor fallback fetch fingerprint flush fragment gateway garbage heartbeat
hierarchy ignore immutable inherit iterator journal latency lazy linear literal logger lookup marshal metric migrate
namespace nested nullable observe optimistic overflow partition payload pending persist physical pipeline planner
predicate preserve projection quorum rebalance reconcile recursive reducer relation replica resolve retry rollback
sampler scatter semaphore shard shuffle signature skip snapshot socket speculative spill stale statistics subscribe
supplier suspend synchronize telemetry tenant timeout timestamp truncate unpack upstream validate vectorized viewport
watermark wildcard workflow wrapper yield
""".split()
A, D = string.ascii_lowercase, string.digits
ALPHABETS = {
    "lower": A, "upper": A.upper(), "lower_digits": A + D, "upper_digits": A.upper() + D, "letters": A + A.upper(),
    "letters_digits": A + A.upper() + D, "base64": A + A.upper() + D + "+/", "base64url": A + A.upper() + D + "_-",
    "hex": "abcdef" + D, "HEX": "ABCDEF" + D, "base32": A.upper() + "234567",
}


def identifiers(rng, n=300):
    """Runs of 20 letters or more of each shape, from words that the operator does not know."""
    made = {k: [] for k in ("snake", "camel", "constant", "path", "dashed", "url", "numbered")}
    while min(map(len, made.values())) < n:
        low = [rng.choice(OTHER + keyword.kwlist[3:]).lower() for _ in range(rng.randint(2, 5))]
        high = [w.capitalize() for w in low]
        for kind, t in (
            ("snake", "_".join(low)), ("camel", "".join(high)), ("constant", "_".join(low).upper()), ("path", "/".join(low)),
            ("dashed", "-".join(low)), ("url", "//www/" + "/".join(low) + "?".replace("?", "=") + low[0]), ("numbered", "_".join(low) + str(rng.randint(1, 99))),
        ):
            if len(t) >= 20 and len(made[kind]) < n:
                made[kind].append(t)
    return made


def flagged(spark, model, strings):
    table = spark.createDataFrame(list(enumerate(strings)), "doc_id long, text string")
    return {strings[r.doc_id] for r in secrets.scan(table, model).where("spans <> ''").select("doc_id").collect()}


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_words():
    assert not set(OTHER) & set(secrets.WORDS) and len(set(secrets.WORDS)) == len(secrets.WORDS) <= 200


def test_false_alarms(spark, model):
    kinds = identifiers(random.Random(3))
    bad = flagged(spark, model, sorted({t for v in kinds.values() for t in v}))
    shares = {k: sum(t in bad for t in v) / len(v) for k, v in kinds.items()}
    print(shares)
    assert max(shares.values()) <= 0.02, shares


def test_recall(spark, model):
    rng = random.Random(4)
    kinds = {(k, n): ["".join(rng.choices(a, k=n)) for _ in range(200)] for k, a in ALPHABETS.items() for n in (20, 32, 40)}
    found = flagged(spark, model, sorted({t for v in kinds.values() for t in v}))
    shares = {k: sum(t in found for t in v) / len(v) for k, v in kinds.items()}
    print(shares)
    assert min(shares.values()) >= 0.95, shares


def test_random_parts_of_ordinary_runs(spark, model):
    """A random string inside a path is found, and the rest of the path is kept."""
    rng = random.Random(5)
    keys = ["".join(rng.choices(A + A.upper() + D, k=24)) for _ in range(20)]
    texts = [f"see abstract/gateway/compile_{k}/coordinate/descriptor/diagnostic/statistics/subscribe/hierarchy/workflow now" for k in keys]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secrets.redact(table, model).collect()}
    for r in secrets.scan(table, model).collect():
        _, a, b = r.spans.split(":")
        assert r.n_model == 1 and keys[r.doc_id] in texts[r.doc_id][int(a) : int(b)]
        assert keys[r.doc_id] not in clean[r.doc_id] and clean[r.doc_id].startswith("see ")


def test_ratio_by_brute_force(spark, model):
    rng = random.Random(6)
    strings = [t for v in identifiers(rng, 20).values() for t in v] + ["".join(rng.choices(secrets.LETTERS, k=rng.randint(1, 60))) for _ in range(200)] + ["", "a", "-" * 30]
    table = spark.createDataFrame([(t,) for t in strings], "t string")
    for r in table.select("t", secrets._ratio(table.t, model).alias("got")).collect():
        place = [secrets.LETTERS.index(c) + 1 for c in r.t]
        pairs = [a * secrets.SIDE + b for a, b in zip(place, place[1:]) if a != b]
        size = sum(n for k, n in secrets.KINDS if re.search(k, r.t)) + len(set(r.t) & set("+/_=-"))
        likely = max(sum(round(model[1][p], 6) for p in pairs), -math.log(max(2, size)) * len(pairs))
        want = (likely - sum(round(model[0][p], 6) for p in pairs)) / max(1, len(r.t) - 1)
        assert abs(r.got - want) < 1e-9
