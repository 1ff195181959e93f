"""Quotes of unknown pages against a comparison of every quote with every text."""

from folioscan.operators import evidence

TEXTS = [
    'He wrote: "Coal plants retire early in most plans."', "(Coal plants retire early in most plans)", "pre-Coal plants retire\n early in most plans, they say", "the sum of coal retirement costs.", "batteries, wind and pumps", "Batteries", "", None,
    "coal  retirement\u00a0costs", "a wind and pumps", "wind and", "no such words",
]
QUOTES = ["Coal plants retire early in most plans", "coal retirement costs", "retirement costs", "batteries", "wind and pumps", "atteries, wind", "d", " ", "", None, "plants retire early", "plants plants retire", "retire early in most", "wind and  pumps"]


def brute(quotes, texts):
    flat = lambda s: " ".join(s.split())
    return sorted((i, k, "exact" if q in t else "normalised") for i, q in enumerate(quotes) if q is not None and flat(q) for k, t in enumerate(texts) if t is not None and flat(q) in flat(t))


def found(spark, quotes, texts):
    q, d = spark.createDataFrame(list(enumerate(quotes)), "quote_id bigint, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return sorted(tuple(r) for r in evidence.find_quotes(q, d).collect())


def test_find_quotes_against_every_pair(spark):
    want = brute(QUOTES, TEXTS)
    assert len(want) > 20 and found(spark, QUOTES, TEXTS) == want


def test_find_quotes_of_one_length(spark):
    for quotes in (["d"], ["coal retirement costs"], [" ", None], []):
        assert found(spark, quotes, TEXTS) == brute(quotes, TEXTS)
