import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from statloom.llm import divergence

SF = "/root/testdata/sf0.01"


def slow_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_base_counts_equal_a_plain_loop():
    rng = random.Random(1)
    texts = ["", " ", "a b", "a b c a b c", "x\n\nx\nx \n", "é\xa0ü \x1c ##<", "a a a a a"]
    texts += [rng.choice([" ", "\n"]).join(rng.choice(["a", "b", "c#", "dé"]) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    for text in texts:
        data = text.encode()
        assert divergence.base_counts(data, data.split()) == slow_base(text), text


def test_jensen_shannon_bounds():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert divergence.jensen_shannon(p, p * 7) == 0 and divergence.jensen_shannon(p, q) == pytest.approx(1)
    half = divergence.jensen_shannon(np.array([1.0, 1]), np.array([1.0, 0]))
    assert half**2 == pytest.approx(0.5 * (0.5 * np.log2(0.5 / 0.75) + 0.5 * np.log2(0.5 / 0.25)) + 0.5 * np.log2(1 / 0.75))


def lower_words(text):
    return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


CATEGORIES = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter", "Z": "blank", "N": "digit", "P": "stop", "S": "symbol"}


def slow_classes(text):
    out = dict.fromkeys(divergence.CLASS_NAMES, 0)
    for c in text:
        kind = unicodedata.category(c)
        name = CATEGORIES.get(kind) or CATEGORIES.get(kind[0], "other")
        name = "blank" if c in " \t\n\x0b\x0c\r" else "stop" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else name
        out[name] += 1
    return np.array([out[n] for n in divergence.CLASS_NAMES], float)


def slow_references(rows):
    """classes, common words and word counts of every language, drawn towards those of all."""
    words, classes = {}, {}
    for lang, text in rows:
        if lang is not None:
            words.setdefault(lang, Counter()).update(lower_words(text))
            classes[lang] = classes.get(lang, 0) + slow_classes(text)
    common = {lang: sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: divergence.COMMON_WORDS] for lang, c in words.items()}
    n_words, n_chars = sum(sum(c.values()) for c in words.values()), sum(c.sum() for c in classes.values())
    ranks = [divergence.PRIOR * sum(c[i][1] for c in common.values() if len(c) > i) / n_words for i in range(divergence.COMMON_WORDS)]
    prior = divergence.PRIOR * sum(classes.values()) / n_chars
    out = {}
    for lang, found in common.items():
        if found:
            counts = [n + ranks[i] for i, (_, n) in enumerate(found)]
            out[lang] = classes[lang] + prior, [w for w, _ in found], np.array([*counts, sum(words[lang].values()) + divergence.PRIOR - sum(counts)])
    return out


def slow_distances(reference, text):
    classes, words, shares = reference
    counted = Counter(lower_words(text))
    counts = [counted[w] for w in words]
    return divergence.jensen_shannon(slow_classes(text), classes), divergence.jensen_shannon(np.array([*counts, sum(counted.values()) - sum(counts)], float), shares)


def check(rows, found):
    refs = slow_references([(lang, text) for _, lang, text in rows])
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for i, lang, text in rows:
        r, base = by_id[i], slow_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        names = ([lang] if lang in refs else []) if lang is not None else sorted(refs)
        judged = [(*slow_distances(refs[n], text), n) for n in names] if base[0] else []
        a, b, name = min(judged, key=lambda x: (round(x[0] + x[1], 12), x[2])) if judged else (None, None, None)
        assert r["reference"] == name and (a is None or (r["class_distance"] == pytest.approx(a, abs=1e-9) and r["word_distance"] == pytest.approx(b, abs=1e-9)))
        odd = a is not None and (base[1] >= divergence.CLASS_LEAST_CHARS and a > divergence.CLASS_LIMIT or base[0] >= divergence.WORD_LEAST_WORDS and b > divergence.WORD_LIMIT)
        assert r["kept"] == (not r["base_failed"] and not odd)


def test_whole_table_against_references_counted_in_one_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check([(r["doc_id"], r["lang"], r["text"] or "") for r in docs.collect()], divergence.rule_rows(docs).collect())


def test_other_scripts_are_classed_and_folded(spark):
    rng = random.Random(6)
    pools = {"ru": "Привет Мир это и в не на я быть он с", "zh": "日本 中文 的 是 了 我 不 在", "el": "ΚΑΙ και το Του ΣΑΣ σας", "en": "The the of and To in a is"}
    rows = []
    for i in range(80):
        lang = rng.choice([*pools, None])
        pool = pools[lang or rng.choice([*pools])].split()
        rows.append((i, lang, " ".join(rng.choice(pool) + rng.choice(["", "", ".", "，", " ١٢", "—", "\u0301"]) for _ in range(rng.randrange(0, 160)))))
    found = divergence.rule_rows(spark.createDataFrame(rows, "doc_id bigint, lang string, text string")).collect()
    check(rows, found)
    assert slow_classes("日本").tolist() == divergence.class_counts("日本".encode()).tolist() and divergence.folded_words("ПРИВЕТ Мир".encode()) == ["привет".encode(), "мир".encode()]
    # a document in capitals of another alphabet is as odd as one in Latin capitals
    loud = [(i, "ru", "привет мир это и в не на я быть он с " * 12) for i in range(20)] + [(99, "ru", "ПРИВЕТ МИР ЭТО И В НЕ НА Я БЫТЬ ОН С " * 12)]
    got = {r["doc_id"]: r for r in divergence.rule_rows(spark.createDataFrame(loud, "doc_id bigint, lang string, text string")).collect()}
    assert got[99]["class_distance"] > divergence.CLASS_LIMIT > got[0]["class_distance"] and got[99]["word_distance"] < 0.1


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = divergence.rule_rows(docs).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert all(clean) and sum(junk) < 0.2 * len(junk)


def test_odd_rows_and_tables(spark):
    schema = "doc_id bigint, text string, lang string, n_words int, kept string"
    docs = spark.createDataFrame([(1, None, None, 1, "x"), (None, "", "zz", 1, "x"), (3, "word " * 60_000, "en", 1, "x"), (3, "word " * 60_000, "en", 1, "x")], schema)
    rows = sorted(divergence.rule_rows(docs).collect(), key=lambda r: r["n_words"])
    assert [(r["n_words"], r["base_failed"], r["kept"]) for r in rows] == [(0, True, False)] * 2 + [(60_000, True, False)] * 2
    assert divergence.rule_rows(docs.limit(0)).collect() == []


def test_every_language_has_a_reference_whatever_its_size(spark):
    rng = random.Random(4)

    def text(lang, n):
        return " ".join(f"{lang}{rng.choice('abcdefghij')}{rng.choice('klm')}" for _ in range(n))

    names = [f"l{i}x" for i in range(300)]
    rows = [(2 * i + k, text(lang, 120), lang) for i, lang in enumerate(names) for k in range(2)]
    rows += [(1000, text("rare", 120), "rare"), (1001, text("l7x", 120), None)]
    got = {r["doc_id"]: r for r in divergence.rule_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert len(got) == len(rows)
    for i, _, lang in [*rows[:600], rows[600]]:
        assert got[i]["reference"] == lang and got[i]["word_distance"] < divergence.WORD_LIMIT and got[i]["class_distance"] < divergence.CLASS_LIMIT
    # the nearest of 301 references, five groups of them
    assert got[1001]["reference"] == "l7x" and got[1001]["word_distance"] < 0.5


def test_a_verdict_hardly_depends_on_how_many_share_the_language(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["un", "deux", "trois", "quatre", "cinq", "mot", "autre", "chose"]) + rng.choice(["", "s", "e"]) for _ in range(n))
    own, others = text(150), [text(150) for _ in range(60)]
    for count in (0, 1, 5, 60):
        rows = [(1, own, "fr"), *((10 + i, t, "fr") for i, t in enumerate(others[:count])), *((200 + i, f"en{i % 7} of the word list " * 30, "en") for i in range(5))]
        got = {r["doc_id"]: r for r in divergence.rule_rows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
        assert got[1]["kept"] and got[1]["reference"] == "fr"
