"""A guard lets every text pass in which its pattern can be found."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patchlight.functions import vocabulary as v
from patchlight.functions.guards import NEEDED, WHOLE_WORDS, folded, may_hold
from patchlight.functions.text import rx, rx_guarded

NAMES = {getattr(v, n): n for n in dir(v) if n.isupper() and isinstance(getattr(v, n), str)}


def plain_guard(text, pattern):
    for letter, plain in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = text.replace(letter, plain)
    low = text.lower()
    return any(w in low for w in NEEDED[pattern]) or any(re.search(rf"(?<![a-z0-9_]){w}", low) for w in WHOLE_WORDS.get(pattern, []))


@pytest.mark.parametrize("pattern", list(NEEDED), ids=NAMES.get)
def test_what_matches_passes(pattern):
    @settings(max_examples=1500, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.IGNORECASE)))
    def check(text):
        assert plain_guard(text, pattern)

    check()


def test_guarded_patterns_find_what_plain_ones_do(spark):
    words = ["a", "source", "RCE", "rce", "xrce", "forced", "Heap Overflow", "overflowing", "CVE-2024-12345", "cve-x", "Fi\u017fx", "\u017fecurity", "SECUR\u0130TY", "buffer  overflow", "hac\u212aerone.com", "d\u0130sclosure responsibly", "Respons\u0131bly Disclosed", "crafted", "length check", "", "\u00e9rce", "_rce", "../x"]
    texts = words + [f"{a} {b}" for a in words for b in words]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", folded(F.col("t")))
    t = F.col("t")
    differ = [F.count_if((rx(t, p) != rx_guarded(t, low, p))).alias(f"{n} {k}") for p, n in ((p, NAMES[p]) for p in NEEDED) for k, low in enumerate((F.col("low"), "low"))]
    assert set(rows.agg(*differ).first()) == {0}
    assert rows.filter(~may_hold(F.col("low"), v.VULN_CLASS)).count() > 100
