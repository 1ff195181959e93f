"""PII redaction: held-out accuracy of the trees, boosting on a known rule, and the defined cases."""

import math

import numpy as np
import pytest

from folioscan.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.fit()


def test_held_out_accuracy(model):
    rows = pii.examples(3000, seed=77)
    x, y = np.array([pii.features(*r[:4]) for r in rows]), np.array([r[4] for r in rows])
    p = model.trees.probability(x)
    limit = np.array([model.thresholds[r[1]] for r in rows])
    chosen = p >= limit
    assert y[chosen].mean() > 0.97  # precision
    assert chosen[y == 1].mean() > 0.95  # recall


PERSONAL = [
    "Write to jane.doe42@mail.example.com, please",
    "call (212) 555-0147 today",
    "tel. +49 301 234 5678",
    "from host 203.0.113.77 at night",
    "card 4111 1111 1111 1111 was used",
    "ssn 123-45-6789",
    "iban DE44500105175407324931",
    'api_key="ghp_a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"',
]
PLAIN = ["The year 1998 was warm.", "version 1.2.3.4 is out", "order 12345678 has left", "isbn 978-3-1616-1484-0", "pages 12-15, 3.14159265", "no digits here @ all", "commit da39a3ee5e6b4b0d3255bfef95601890afd80709"]


def test_planted_cases(model):
    for text in PERSONAL:
        assert len(pii.spans(model, text)) == 1, text
    assert sum(len(pii.spans(model, t)) for t in PLAIN) == 0, [(t, pii.spans(model, t)) for t in PLAIN]


FURTHER = [
    ("secret", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", 'key = "{}"'),
    ("secret", "dGhpcyBpcyBh+IHNlY3Jl/dCB0b2tlbiBmb3I=", "token = \"{}\""),
    ("secret", "qLmXzRtWvKpYdHsNbGcJfTaQ", 'password "{}"'),
    ("secret", "qLmXzRtWvKpYdHsNbGcJfTaQ", 'api_key="{}" and no more'),
    ("ip", "2001:db8:85a3:8d3:1319:8a2e:370:7348", "from host {} at night"),
    ("ip", "fe80::1ff:fe23:4567:890a", "server {}, again"),
    ("ip", "2001:db8::1", "login from ip {}."),
]
FURTHER_PLAIN = ["at 12:34:56 it began", "see /usr/local/lib/python/packages/numerics", "the internationalisation-of-long-words there", "a" + "-" * 60 + " line", "name std::vector of it", "class AbstractSingletonProxyFactoryBean is", "device 0a:1b:2c:3d:4e:5f there", "f :: g"]


def test_long_secrets_of_other_signs_and_longer_addresses(model):
    for kind, value, text in FURTHER:
        text = text.format(value)
        assert [(k, text[a:b]) for k, a, b, _ in pii.spans(model, text)] == [(kind, value)], text
    for text in FURTHER_PLAIN:
        assert pii.spans(model, text) == [], text


def test_held_out_accuracy_of_each_new_class(model):
    rows = pii.examples(12000, seed=78)
    for new in (lambda k, s: k == "ip" and ":" in s, lambda k, s: k == "secret" and ("/" in s or "+" in s), lambda k, s: k == "secret" and s.isalpha()):
        mine = [x for x in rows if new(x[1], x[0][x[2] : x[3]])]
        chosen = model.trees.probability(np.array([pii.features(*x[:4]) for x in mine])) >= np.array([model.thresholds[x[1]] for x in mine])
        y = np.array([x[4] for x in mine])
        assert y.sum() > 50 and (y == 0).sum() > 20
        assert y[chosen].mean() > 0.95 and chosen[y == 1].mean() > 0.9


def test_spans_do_not_overlap_and_are_best_first(model):
    text = " and ".join(PERSONAL * 5)
    found = pii.spans(model, text)
    assert len(found) == 5 * len(PERSONAL)
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))
    out = pii.redacted(text, found)
    assert "jane" not in out and out.count("[EMAIL]") == 5


def test_every_proposal_is_judged_alike_whatever_its_batch(model):
    found = [(t, *s) for t in PERSONAL + PLAIN for s in pii.proposals(t)]
    x = np.array([pii.features(*f) for f in found])
    one = np.concatenate([model.trees.probability(x[i : i + 1]) for i in range(len(x))])
    assert np.allclose(one, model.trees.probability(x))
    assert model.trees.probability(x[:0]).shape == (0,)


def test_boosting_learns_a_rule_of_two_features():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.2) != (x[:, 2] > -0.3)).astype(float)
    trees = pii.boost(x[:1500], y[:1500], rounds=40)
    assert ((trees.probability(x[1500:]) > 0.5) == (y[1500:] == 1)).mean() > 0.95


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_defined_cases(docs, clashing, model):
    long = "words and more " * 150_000 + "mail a.person@mail.example.com now"
    df = clashing(docs([None, "", "plain", PERSONAL[0], PERSONAL[0], long], [1, 2, 3, 4, 4, 5]))
    rows = pii.redactions(df, model).collect()
    assert sorted(r["doc_id"] for r in rows) == [4, 4, 5]
    assert len({r["redacted"] for r in rows if r["doc_id"] == 4}) == 1
    last = next(r for r in rows if r["doc_id"] == 5)
    assert last["redacted"].endswith("mail [EMAIL] now") and last["spans"][0]["start"] == 15 * 150_000 + 5
    out = pii.redact(df, model)
    assert out.columns == df.columns
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert (1, None) in texts and (2, "") in texts and (3, "plain") in texts and len(texts) == 6
    assert pii.redactions(docs([]), model).count() == 0 and pii.redact(docs([]), model).count() == 0


def test_offsets_count_code_points(model):
    text = "🙂 Grüße: an.na@mail.example.org!"
    (kind, a, b, _), = pii.spans(model, text)
    assert (kind, text[a:b]) == ("email", "an.na@mail.example.org")


def test_whole_table(spark, sf, model):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in pii.redactions(df, model).collect()}
    for r in df.select("doc_id", "text").collect():
        assert (r["doc_id"] in rows) == bool(pii.spans(model, r["text"]))


def test_local_parts_and_domains_of_any_length(model):
    text = "mail " + "abcdefghij" * 12 + "@" + "longlabel" * 6 + "." + ".".join(["part"] * 60) + ".org now"
    (kind, a, b, _), = pii.spans(model, text) or [(None, 0, 0, 0)]
    assert [(k, s, e) for k, s, e in pii.proposals(text) if k == "email"] == [("email", 5, len(text) - 4)]
    if kind:
        assert (a, b) == (5, len(text) - 4)
    assert len(pii.proposals("@".join(["a" * 300] * 2000))) < 5000  # each sign is looked at once


def test_short_phones_and_long_runs_are_proposed():
    assert ("phone", 5, 13) in pii.proposals("call 555-0134 now")
    assert ("secret", 6, 31) in pii.proposals("token " + "1234567890123456789012345" + " end")


def tree_probability(trees, x):
    """The sum over the trees, each walked from its root."""
    z = trees.base
    for feature, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > bound[at] else 1)
        z += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-z))


def brute_spans(model, text):
    """All proposals, the best taken again and again until none that is good enough is free."""
    left = []
    for kind, a, b in pii.proposals(text):
        p = tree_probability(model.trees, pii.features(text, kind, a, b))
        if p >= model.thresholds[kind]:
            left.append((round(p, 6), b - a, -a, kind))
    out = []
    while left:
        best = max(left, key=lambda s: (s[0], s[1], s[2], [-ord(c) for c in s[3]]))
        start, end = -best[2], -best[2] + best[1]
        out.append((best[3], start, end, best[0]))
        left = [s for s in left if -s[2] >= end or -s[2] + s[1] <= start]
    return sorted(out, key=lambda s: s[1])


def test_query_against_brute_force(spark, sf, model):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.redactions(df, model).collect()}
    found = 0
    for i, text in df.select("doc_id", "text").collect():
        want = brute_spans(model, text) if text else []
        assert (i in got) == bool(want)
        if want:
            assert [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]] == [s[:3] for s in want]
            assert [s["probability"] for s in got[i]["spans"]] == pytest.approx([s[3] for s in want], abs=2e-6)
            redacted = text
            for kind, a, b, _ in reversed(want):
                redacted = redacted[:a] + f"[{kind.upper()}]" + redacted[b:]
            assert got[i]["redacted"] == redacted and got[i]["n_spans"] == len(want)
            found += len(want)
    assert found > 5


def test_equal_probabilities_go_to_the_longer_then_the_earlier_span(monkeypatch):
    model = pii.Model(pii.Trees(np.empty((0, 0)), np.empty((0, 0)), np.empty((0, 0)), 3.0), dict.fromkeys(pii.KINDS, 0.5))
    monkeypatch.setattr(pii, "proposals", lambda t: [("phone", 0, 5), ("card", 3, 9), ("ip", 9, 12), ("iban", 11, 14), ("secret", 9, 12)])
    assert [(k, a, b) for k, a, b, _ in pii.spans(model, "x" * 20)] == [("card", 3, 9), ("ip", 9, 12)]
