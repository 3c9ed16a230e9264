"""The one form of free-form JSON against a plain serialiser."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from recordloom.functions import canon


def number(x):
    """ECMAScript's form of a double, from Python's shortest digits."""
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, n = (whole + part).lstrip("0"), len(whole) + int(exponent or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= n <= 21:
        out = digits + "0" * (n - k)
    elif 0 < n <= 21:
        out = f"{digits[:n]}.{digits[n:]}"
    elif -6 < n <= 0:
        out = "0." + "0" * -n + digits
    else:
        out = digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{'+' if n > 0 else '-'}{abs(n - 1)}"
    return ("-" if x < 0 else "") + out


def plain(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{plain(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return number(float(v))
    return json.dumps(v, ensure_ascii=False)


def shuffled(r, v):
    if isinstance(v, dict):
        items = list(v.items())
        r.shuffle(items)
        return {k: shuffled(r, x) for k, x in items}
    return [shuffled(r, x) for x in v] if isinstance(v, list) else v


def document(r, depth):
    kind = r.random()
    if depth and kind < 0.5:
        return {r.choice(["a", "b", "Z", "é", "k k", "10", "9", '"', "\n", "中", "_"]) + str(r.randint(0, 3)): document(r, depth - 1) for _ in range(r.randint(0, 5))}
    if depth and kind < 0.7:
        return [document(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, "", 'x"y\\', "tab\tline\n\x01\x1f/", "é中", 0, -0.0, 1, -1, 1.5, 100, 1e21, 1e20, 123456789012, 0.001, 1e-6, 1e-7, 12.25e-9, -2.5e30, 0.1, 1 / 3, 2**53, r.random(), r.randint(-(10**6), 10**6)])


def test_documents_of_any_depth_hash_alike(spark):
    r = random.Random(6)
    docs = [document(r, 5) for _ in range(250)]
    rows = [(i, json.dumps(shuffled(r, d), indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)) for i, d in enumerate(docs) for _ in range(2)]
    found = spark.createDataFrame(rows, "i int, j string").select("i", canon.canonical_text(F.col("j")).alias("t"), canon.canonical_hash(F.col("j")).alias("h")).collect()
    hashes = {}
    for x in found:
        assert x.t == plain(docs[x.i])
        assert hashes.setdefault(x.i, x.h) == x.h


def test_numbers(spark):
    r = random.Random(2)
    texts = ["0", "-0", "0.0", "-0.0e5", "1.50", "1e2", "100", "1E-7", "0.000001", "123456789012345678901", "1e21", "12345678901234567890123", "1.7976931348623157e308", "-1.0", "0.1", "100000000000000000000"]
    texts += [repr(x) for x in (struct.unpack("<d", r.randbytes(8))[0] for _ in range(200)) if x == x and abs(x) != float("inf")]
    texts += [f"{r.uniform(-1e6, 1e6):.{r.randint(0, 9)}f}" for _ in range(100)]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", canon.json_number(F.col("t")).alias("n")).collect()
    for x in found:
        assert float(x.n) == float(x.t) and len(x.n) <= len(number(float(x.t))) + 2, (x.t, x.n)
    assert [x.n for x in sorted(found)[:16]] == [number(float(t)) for t in texts[:16]]


@pytest.mark.parametrize("bad", ["{", '{"a":1,"a":2}', "1e999", '[1, -2e400]', "NaN", "x"])
def test_what_has_no_form_is_an_error(spark, bad):
    with pytest.raises(Exception):
        spark.createDataFrame([(bad,)], "j string").select(canon.canonical_text(F.col("j"))).collect()
    assert spark.createDataFrame([(None,)], "j string").select(canon.canonical_text(F.col("j"))).first()[0] is None
