import itertools
import random
import re

import pytest

from statloom.llm import licenses

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lowered)
    places = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def longest_ending(words, texts):
    out = []
    for end in range(1, len(words) + 1):
        best = 0
        for k in range(1, end + 1):
            piece = words[end - k : end]
            if any(t[i : i + k] == piece for t in texts for i in range(len(t) - k + 1)):
                best = k
            else:
                break
        out.append(best)
    return out


def test_matching_statistics_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        machine = licenses.Automaton(texts)
        words = [rng.randrange(1, 5) for _ in range(40)]
        assert [n for _, n in machine.statistics(words)] == longest_ending(words, texts)
        for state, length in machine.statistics(words):
            assert machine.length[machine.link[state]] < length <= machine.length[state] or not state
        for i, t in enumerate(texts):
            assert (i, len(t) - 1) in machine.ends[machine.read(t)]


def test_base_columns_equal_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["base_labels"] or not r["labels"]


def scan(text):
    return licenses.scan_row(licenses.scanner(), text.encode())


def test_whole_and_damaged_templates_are_found_where_they_are():
    label, template = licenses.TEMPLATES[0]
    words = template.split()
    padding = "plain words without any meaning here " * 30
    row = scan(padding + template + " " + padding)
    span = row[-1][0]
    assert (row[5], span[0], span[1], span[3]) == (label, label, 180, 1.0) and row[6] == 1.0
    damaged = words[:20] + ["changed", "zzz"] + words[22:60] + words[64:]
    row = scan(padding + " ".join(damaged))
    assert row[5] == label and 0.8 < row[6] < 1 and len(row[-1]) == 1
    twice = scan(template + " " + padding + template)
    assert [s[1] for s in twice[-1]] == [0, len(licenses.words_of(template.encode())) + 180]
    assert scan(" ".join(words[:12]))[5] == ""


def test_phrases_next_to_each_other_and_overlapping():
    for text in ["mit license mit license", "the apache license apache MIT License cc by cc by-nc", "gnu general public gnu general public license", "CC\nBY, cc_by ccby cc", "MIT\x00license", "émit license", "mit licensé", ""]:
        assert scan(text)[:5] == slow_base(text), text
    rng = random.Random(9)
    pool = ["mit", "license", "apache", "cc", "by", "gnu", "general", "public", "the", "zzz", "under"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 25)))
        assert scan(text)[:5] == slow_base(text), text


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "MIT License " * 40_000, "x"), (2, "MIT License " * 40_000, "x")], "doc_id bigint, text string, labels string")
    rows = sorted(licenses.license_scan(docs).collect(), key=lambda r: r["n_words"])
    assert [(r["n_words"], r["n_base"], r["labels"]) for r in rows] == [(0, 0, "")] * 2 + [(80_000, 40_000, "mit")] * 2
    assert licenses.license_scan(docs.limit(0)).collect() == []


def every_chain(matches):
    """All chains as (last match, first word, covered words), by trying every sequence."""
    found = []

    def go(chain, covered):
        j = chain[-1]
        found.append((j, matches[chain[0]][0], covered))
        end, reached = matches[j][0] + matches[j][2], matches[j][1] + matches[j][2]
        for k, (at, place, length) in enumerate(matches):
            gain = length - max(0, end - at, reached - place)
            if at > matches[j][0] and at - end <= licenses.MAX_GAP and gain > 0:
                go([*chain, k], covered + gain)

    for j, (_, _, length) in enumerate(matches):
        go([j], length)
    return found


def test_chains_equal_an_exhaustive_search():
    rng = random.Random(12)
    for _ in range(300):
        matches = sorted({(rng.randrange(0, 60), rng.randrange(0, 30), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 9))})
        best = {}
        for j, first, covered in every_chain(matches):
            best[j] = max(best.get(j, (0, 0)), (covered, first))
        assert [(c, f) for f, _, c in licenses.best_chains(matches)] == [best[j] for j in range(len(matches))]
        chains = licenses.best_chains(matches)
        taken = licenses.apart(chains)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))
        most = max(sum(c[2] for c in some) for n in range(len(chains) + 1) for some in itertools.combinations(sorted(set(chains), key=lambda c: c[1]), n) if all(a[1] <= b[0] for a, b in zip(some, some[1:])))
        assert sum(c[2] for c in taken) == most


def slow_labels(text):
    """Labels and score from all common runs of words and all chains of them."""
    words, found = licenses.words_of(text.encode()), []
    for label, template in licenses.TEMPLATES:
        t = licenses.words_of(template.encode())
        runs = set()
        for i, j in itertools.product(range(len(words)), range(len(t))):
            if words[i] == t[j] and (not i or not j or words[i - 1] != t[j - 1]):
                n = 0
                while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                    n += 1
                if n >= licenses.LEAST_MATCH:
                    runs.add((i, j, n))
        chains = licenses.apart([c for c in licenses.best_chains(sorted(runs)) if c[2] >= licenses.LEAST_COVERAGE * len(t)])
        found += [(label, c[2] / len(t)) for c in chains]
    return {label for label, _ in found}, max((min(1.0, c) for _, c in found), default=0.0)


def test_labels_of_damaged_and_mixed_licences_equal_a_plain_search():
    rng = random.Random(21)
    for _ in range(60):
        pieces = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            a = rng.randrange(0, max(1, len(words) // 3))
            part = [w if rng.random() > 0.04 else rng.choice(["zzz", "the", "software"]) for w in words[a : a + rng.randrange(8, 90)]]
            pieces += [*part, *["filler"] * rng.choice([0, 3, 30])]
        text = " ".join(pieces)
        labels, score = slow_labels(text)
        row = scan(text)
        base = set(filter(None, row[4].split(",")))
        assert set(filter(None, row[5].split(","))) == base | labels and row[6] == (1.0 if base else pytest.approx(score))


def test_no_label_for_a_disclaimer_alone():
    text = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY'
    assert scan(text)[5] == ""


def test_repeated_licences_are_scanned_in_time():
    text = (licenses.TEMPLATES[0][1] + " ") * 1500
    row = scan(text)
    assert len(row[-1]) == 1500 and row[6] == 1.0
