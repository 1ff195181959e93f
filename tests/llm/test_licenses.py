"""License scan against backtracking over the template's parts."""

import random
import re

import pytest

from folioscan.llm import licenses

SMALL = {
    "plain": "alpha beta gamma",
    "optional": "alpha <<opt>>beta<<end>> gamma delta",
    "replaced": "start <<var:x:1-3>> middle part end",
    "nested": "one <<opt>>two <<opt>>three<<end>><<end>> four <<var:y:0-2>> five",
}


def brute(markup, words):
    """Leftmost, longest, non-overlapping matches by trying every way."""
    pieces = [p for p in re.split(r"(<<opt>>|<<end>>|<<var:\w+:\d+-\d+>>)|\s+", markup) if p]

    def closing(i):
        deep = 0
        for j in range(i, len(pieces)):
            deep += (pieces[j] == "<<opt>>") - (pieces[j] == "<<end>>")
            if not deep:
                return j

    def ends(i, at):
        if i == len(pieces):
            return {at}
        p = pieces[i]
        if p == "<<opt>>":
            return ends(i + 1, at) | ends(closing(i) + 1, at)
        if p == "<<end>>":
            return ends(i + 1, at)
        if p.startswith("<<var"):
            low, high = map(int, p[2:-2].rsplit(":", 1)[1].split("-"))
            return set().union(*[ends(i + 1, at + k) for k in range(low, high + 1) if at + k <= len(words)])
        return ends(i + 1, at + 1) if at < len(words) and words[at] == p else set()

    out, at = [], 0
    while at < len(words):
        e = max(ends(0, at), default=0)
        if e > at:
            out.append((at, e))
            at = e
        else:
            at += 1
    return out


def test_against_backtracking():
    r = random.Random(8)
    scan = licenses.scanner(SMALL)
    vocabulary = sorted(set(re.findall(r"[a-z]+", re.sub(r"<<.*?>>", " ", " ".join(SMALL.values())))))
    texts = []
    for _ in range(400):
        t = r.choices(vocabulary + ["other"], k=r.randint(0, 12))
        m = re.sub(r"<<var:.*?>>", lambda _: " ".join(r.choices(["other", "end", "x"], k=r.randint(0, 3))), r.choice(list(SMALL.values())))
        m = re.sub(r"<<opt>>|<<end>>", " ", m).split()
        texts.append(" ".join(t + [w for w in m if r.random() > 0.06] + t[:3]))
    hits = 0
    for t, found in zip(texts, scan(texts)):
        want = sorted((n, a, b) for n, m in SMALL.items() for a, b in brute(m, t.split()))
        assert sorted(found) == want, t
        hits += len(want)
    assert hits > 150


def plain(name, **said):
    """A template's text with all of its optional wording."""
    text = re.sub(r"<<var:(\w+):(\d+)-\d+>>", lambda m: said.get(m.group(1), " ".join(["word"] * max(1, int(m.group(2))))), licenses.TEMPLATES[name])
    return re.sub(r"<<(?:opt|end)>>", " ", text)


MIT = plain("MIT", what="this software and associated documentation files", holders="THE AUTHORS OR COPYRIGHT HOLDERS")


def found(df):
    return sorted((r["doc_id"], r["license"]) for r in df.collect())


def test_wrapping_case_and_comments_do_not_count(docs):
    wrapped = "\n".join("// " + line for line in re.findall(r".{1,40}(?:\s|$)", MIT.upper()))
    changed = MIT.replace("free of charge", "for a small charge")
    assert found(licenses.license_matches(docs([MIT, wrapped, changed, MIT.replace("sublicense", "sublicence")]))) == [(0, "MIT"), (1, "MIT"), (3, "MIT")]


def test_each_template_matches_its_own_wording(docs):
    for name, markup in licenses.TEMPLATES.items():
        text = re.sub(r"<<var:\w+:(\d+)-\d+>>", lambda m: " ".join(["word"] * max(1, int(m.group(1)))), markup)
        text = re.sub(r"<<(?:opt|end)>>", " ", text)
        scan = licenses.scanner({name: markup})
        assert [m[0] for m in scan([f"before it. {text} after it"])[0]] == [name]


def test_defined_cases(docs, clashing):
    long = "pad " * 300_000 + MIT
    df = clashing(docs([None, "", "nothing here", MIT, MIT, long], [1, 2, 3, 4, 4, 5]))
    assert found(licenses.license_matches(df)) == [(4, "MIT"), (4, "MIT"), (5, "MIT")]
    assert licenses.license_matches(docs([])).count() == 0
    last = licenses.license_matches(df).filter("doc_id = 5").first()
    assert last["start_word"] == 300_000


def test_bad_templates_raise():
    for markup in ("<<opt>>only optional<<end>>", "<<opt>>open words here", "<<var:x:1-2>>"):
        with pytest.raises(ValueError):
            licenses.compile_template("bad", markup)


def test_tags_and_notices_that_follow_each_other():
    scan = licenses.scanner(licenses.TEMPLATES)
    tag = "SPDX-License-Identifier:"
    assert scan([f"{tag} GPL-2.0\n{tag} MIT\n"])[0] == [("SPDX tag", 0, 6), ("SPDX tag", 6, 10)]
    assert [m[1:] for m in scan([f"{tag} {tag} MIT {tag} Apache-2.0"])[0]] == [(3, 7), (7, 13)]
    assert len(scan([f"{tag} MIT " * 2000])[0]) == 2000
    cc = scan(["Licensed under CC BY-SA Licensed under CC BY 4.0"])[0]
    assert cc == [("CC (notice)", 0, 5), ("CC (notice)", 5, 11)]


def test_gpl_notice_without_lead_in():
    scan = licenses.scanner(licenses.TEMPLATES)
    assert scan(["Licensed under the GNU General Public License, version 3"])[0] == [("GPL (notice)", 0, 9)]
    assert scan(["This small program is licensed under the terms of the GNU General Public License"])[0] == [("GPL (notice)", 0, 14)]
    assert scan(["Licensed under the GNU Lesser General Public License, version 3"])[0] == [("LGPL (notice)", 0, 10)]


WHOLE = [p.stem for p in licenses.TEXTS.glob("*.txt")]


def test_whole_texts_to_their_last_word(docs):
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(WHOLE)
    texts = [f"intro. {plain(n)} outro." for n in WHOLE]
    got = found(licenses.license_matches(docs(texts)))
    assert [x for x in got if x[1] in WHOLE] == sorted((i, n) for i, n in enumerate(WHOLE))


def test_an_altered_text_is_not_accepted(docs):
    texts = []
    for n in WHOLE:
        bare = re.sub(r"(?s)<<opt>>.*?<<end>>", " ", licenses.TEMPLATES[n])
        words = [w for w in re.sub(r"<<var.*?>>", " variable variable ", bare).split() if re.search("[a-zA-Z]", w)]
        for at in (len(words) // 4, len(words) // 2, len(words) - 3):
            at = next(i for i in range(at, -1, -1) if words[i] != "variable")  # what is replaceable may be anything
            texts.append(" ".join([*words[:at], "zzzz", *words[at + 1 :]]))
        texts.append(" ".join(words[:-12]) + " But you owe the author ten dollars for each copy.")
    assert [x for x in found(licenses.license_matches(docs(texts))) if x[1] in WHOLE] == []


def test_a_text_without_its_notice_sentence_is_not_mit(docs):
    cut = re.sub(r"(?s)The above\s+copyright notice.*?portions of the\s+Software\.", "", MIT)
    assert cut != MIT and found(licenses.license_matches(docs([cut]))) == []


def test_bsd_3_is_not_bsd_2(docs):
    assert found(licenses.license_matches(docs([plain("BSD-3-Clause"), plain("BSD-2-Clause")]))) == [(0, "BSD-3-Clause"), (1, "BSD-2-Clause")]


def test_all_templates_against_backtracking_of_short_ones():
    r = random.Random(3)
    short = {n: re.sub(r"(?i)[^a-z0-9<>:_\-]+", " ", " ".join(licenses.words_of(" ")) or m).lower() for n, m in licenses.NOTICES.items() if len(m) < 200 and "var" not in m}
    short = {n: re.sub(r"(?<!:)-(?!\d)", " ", m) for n, m in short.items()}
    scan = licenses.scanner(short)
    texts = []
    for m in short.values():
        for _ in range(15):
            words = re.sub(r"<<opt>>(.*?)<<end>>", lambda x: x.group(1) if r.random() < 0.5 else "", m).split()
            texts.append(" ".join(w for w in r.choices(["a", "under", "the"], k=3) + words + ["end"] if r.random() > 0.02))
    for t, got in zip(texts, scan(texts)):
        words = licenses.words_of(t)
        assert sorted(got) == sorted((n, a, b) for n, m in short.items() for a, b in brute(" ".join(x if x.startswith("<<") else " ".join(licenses.words_of(x)) for x in re.split(r"(<<.*?>>)", m)), words)), t
