import math

import pytest
from pyspark.sql import functions as F

from matchlake.llm import urls


@pytest.mark.parametrize("a, b, top", [(2, 5, 0.3), (0.4, 3.1, 0.05), (0.4, 3.1, 0.9), (30, 4, 0.8), (1400, 8600, 0.13), (1400, 8600, 0.15), (1, 1, 0.25), (9, 90.5, 0.2)])
def test_beta_distribution(spark, a, b, top):
    """Against sums over thin slices."""
    got = spark.range(1).select(urls.beta_below(F.lit(float(a)), F.lit(float(b)), F.lit(float(top)))).first()[0]
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    n = 200_000
    # t = top * u^4 takes the edge off at 0
    want = sum(math.exp(log + (a - 1) * math.log(t) + (b - 1) * math.log(1 - t)) * 4 * top * u**3 for u in ((k + 0.5) / n for k in range(n)) if (t := top * u**4) > 0) / n
    assert got == pytest.approx(want, abs=2e-6)


def test_registered_domains(spark):
    want = {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "w.example.com": ("example.com", "com"), "10.0.1.2": ("10.0.1.2", "10.0.1.2"), "10.9.1.2": ("10.9.1.2", "10.9.1.2"), "lone": ("lone", "lone"), "": ("", ""), "[::1]": ("[::1]", "[::1]")}
    out = urls.reputation(spark.createDataFrame([(h, 1, 0) for h in want], "host string, n bigint, x bigint")).collect()
    assert {r.host: (r.domain, r.suffix) for r in out} == want


def test_ports_share_a_reputation(spark):
    pages = spark.createDataFrame([(k, f"http://example.de{':8080' if k % 2 else ''}/p") for k in range(20)], "page_id bigint, url string")
    bad = spark.createDataFrame([(k, k % 4 // 2) for k in range(20)], "page_id bigint, bad int")
    out = urls.judged(pages, bad).collect()
    assert {r.host for r in out} == {"example.de", "example.de:8080"} and len({r.mean for r in out}) == 1
