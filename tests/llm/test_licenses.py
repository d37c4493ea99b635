"""License scans against plain searches."""

import random
import re

from groundloom.llm import licenses

WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def base(text):
    w = words(text)
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(200):
        templates = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(3)]
        automaton = licenses.SuffixAutomaton(templates)
        text = "".join(rng.choice("abcd") for _ in range(40))
        runs = {t[i:j] for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max((n for n in range(end + 1) if text[end - n : end] in runs), default=0) if end else 0 for end in range(len(text) + 1)]
        want = [(end, n) for end, n in enumerate(longest) if n and (end == len(text) or longest[end + 1] != n + 1)]
        got = list(automaton.matches(text))
        assert [(end, n) for end, n, _ in got] == want
        for end, n, state in got:
            run = text[end - n : end]
            assert automaton.places[state] == {(k, i + n) for k, t in enumerate(templates) for i in range(len(t)) if t[i : i + n] == run}


def test_scan(spark):
    rng = random.Random(4)
    pool = sorted({w for p in licenses.PHRASES for w in p.split()}) + ["über", "Under", "THE", "x1", "\n", "--"]
    texts = [None, "", " .,;", "Released under the MIT License.", "UNDER, the-MIT_license", "x" * 100_000, "under the mit license " * 5000]
    texts += [" ".join(rng.choice(pool) for _ in range(300)) for _ in range(100)]
    texts += ["foo " + " ".join(dict(licenses.TEMPLATES)["gpl-3"].split()[5:]) + " bar", "This work is licensed under the GNU General Public License, version 3."]
    data = [(i if i % 7 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(5, texts[5], "a", "b")]
    got = licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string, labels string, spans string")).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(k, *base(t or "")) for k, t, *_ in data], key=key)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[len(texts) - 1].labels == "gpl-3" and by[len(texts) - 2].labels == "gpl-3"


def test_every_template_gives_its_label(spark):
    """Each wording, cut at its ends and with a word lost inside, is found, whichever paragraph of a license it is."""
    data = []
    for n, (_, text) in enumerate(licenses.TEMPLATES):
        w = text.split()
        data += [(3 * n, "x y z " + text + " and more"), (3 * n + 1, " ".join(w[len(w) // 8 :])), (3 * n + 2, " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :]) if len(w) > 24 else text)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for n, (label, _) in enumerate(licenses.TEMPLATES):
        assert all(label in got[3 * n + k].labels.split(",") and got[3 * n + k].score >= licenses.LEAST_COVERAGE for k in range(3)), label
    plain = spark.createDataFrame([(1, "The river is provided with stones, and any person may use it without fee.")], "doc_id long, text string")
    assert licenses.scan_licenses(plain).first().labels == ""


def test_templates_of_a_table(spark):
    own = spark.createDataFrame([("house", "You may use this house for one night, and leave the key."), ("house", None), (None, "x"), ("empty", " ;")], "label string, text string")
    docs = spark.createDataFrame([(1, "Guests: you may use this house for one night and leave the KEY!"), (2, "released under the mit license"), (3, "by house rules")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.n_base) for r in licenses.scan_licenses(docs, templates=licenses.templates_of(own), phrases={"House rules": "rules"}).collect()}
    assert got == {1: ("house", 0), 2: ("", 0), 3: ("rules", 1)}


def test_empty(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
