"""Quality rules from the distance between a document's histograms and those of its language.

References are counted over all documents: per language the shares of character
classes and of its ``COMMON_WORDS`` most frequent words (all other words are one
more bin).  Word counts are summed in the map tasks before they are shuffled.
Every language has a reference, however many there are and however few words it
has: its counts are drawn towards the shares of all languages (for words: of the
words of the same rank) as if ``PRIOR`` characters and words of those had been seen
too, which tells in small languages and vanishes in large ones.  A join on the
language brings the reference to its documents.  A document is compared with it by
the Jensen-Shannon distance (square root of the divergence to base 2).  A distance
counts only from a minimum length of the document on: short texts scatter too much
to be judged by it.

Characters are classed by their Unicode category: lower and upper case letters,
letters without case, digits, blanks, stops, symbols and the rest.  Words are
compared in lower case, in every script.

Nulls and edge cases: a null text has no words and fails the base rule; a null
language is compared with the nearest reference, taken in groups of ``NEAREST_GROUP``
languages; repeated rows are judged one by one and all count for the references;
bytes that are no UTF-8 count as the replacement character; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from statloom.llm.common import stored, text_bytes

COMMON_WORDS = 50
#: Characters and words that every reference is drawn towards the shares of all languages with.
PRIOR = 200
#: References that a document of no language meets at once.
NEAREST_GROUP = 64
#: Distances beyond which a document fails, and the length from which on they count.
CLASS_LIMIT, CLASS_LEAST_CHARS = 0.25, 200
WORD_LIMIT, WORD_LEAST_WORDS = 0.5, 100
#: A map task hands its word counts on when it holds this many.
HELD_WORDS = 500_000
SYMBOLS = b"#*$%&|<>"
CLASS_NAMES = ["lower", "upper", "letter", "digit", "blank", "stop", "symbol", "other"]
RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "class_distance double, word_distance double, reference string"
)


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point, by its Unicode category; once per worker."""
    number = {name: i for i, name in enumerate(CLASS_NAMES)}
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter", "Z": "blank", "N": "digit", "P": "stop", "S": "symbol"}
    table = np.full(0x110000, number["other"], np.int8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        name = kinds.get(kind) or kinds.get(kind[0])
        if name:
            table[point] = number[name]
    for name, characters in (("blank", b" \t\n\x0b\x0c\r"), ("stop", b".,;:!?'\"()-"), ("symbol", SYMBOLS)):
        table[list(characters)] = number[name]
    return table


def class_counts(text: bytes) -> np.ndarray:
    points = np.frombuffer(text, np.uint8) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    per_point = np.bincount(points, minlength=1)
    return np.bincount(_class_table()[: len(per_point)], weights=per_point, minlength=len(CLASS_NAMES))[: len(CLASS_NAMES)]


def folded_words(text: bytes) -> list[bytes]:
    """Words in lower case, letters outside ASCII too."""
    return (text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()).split()


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance between two histograms, 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(x):
        on = x > 0
        return float((x[on] * np.log2(x[on] / m[on])).sum())

    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found at least twice in the text."""
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    window = codes[: n - width + 1]
    for k in range(1, width):
        _, window = np.unique(window, return_inverse=True)
        window = window * len(numbers) + codes[k : n - width + 1 + k]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = (counts > 1)[inverse]
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= twice
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    blank = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            repeats += line in seen
            seen.add(line)
    return len(words), points - blank, symbols, repeats, repeated_words(words)


class Reference:
    """Histograms of one language, from its row as JSON."""

    def __init__(self, row: str):
        fields = json.loads(row)
        self.lang = fields["lang"]
        self.classes, self.word_counts = np.array(fields["classes"], float), np.array(fields["word_counts"], float)
        self.words = {base64.b64decode(w): i for i, w in enumerate(fields["words"])}

    def distances(self, classes: np.ndarray, words: Counter, n_words: int) -> tuple[float, float]:
        counts = np.zeros(len(self.words) + 1)
        for word, place in self.words.items():
            counts[place] = words.get(word, 0)
        counts[-1] = n_words - counts[:-1].sum()
        return jensen_shannon(classes, self.classes), jensen_shannon(counts, self.word_counts)


def corpus_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, kind ('word' or 'class'), key, n summed over all documents."""

    def count(frames):
        words, classes = defaultdict(Counter), defaultdict(lambda: np.zeros(len(CLASS_NAMES)))

        def rows():
            out = [(lang, "word", w, n) for lang, c in words.items() for w, n in c.items()]
            out += [(lang, "class", name.encode(), int(n)) for lang, c in classes.items() for name, n in zip(CLASS_NAMES, c)]
            words.clear()
            classes.clear()
            return pd.DataFrame(out, columns=["lang", "kind", "key", "n"])

        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                words[lang].update(folded_words(text))
                classes[lang] += class_counts(text)
            if sum(map(len, words.values())) > HELD_WORDS:
                yield rows()
        yield rows()

    texts = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), text_bytes(text_col).alias("text")).where(F.col("lang").isNotNull())
    counted = texts.mapInPandas(count, "lang string, kind string, key binary, n bigint")
    return counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def reference_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Stored (lang, classes, words, word_counts) of every language: at most COMMON_WORDS words and 1 + 8 more numbers."""
    counts = corpus_counts(docs, text_col, lang_col)
    best = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    ranked = counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= COMMON_WORDS)
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("kind") == "word", F.col("n"))).alias("n_words"), F.sum(F.when(F.col("kind") == "class", F.col("n"))).alias("n_chars"))
    top = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "key", "n"))).alias("rows"))
    kept = stored(top.join(totals, "lang"), "language-counts")

    # shares of all languages: by class, and by the rank of a word
    number = F.when(F.col("r.kind") == "class", F.col("r.key").cast("string")).otherwise(F.col("r.place").cast("string"))
    pooled = kept.select(F.explode("rows").alias("r")).groupBy(F.col("r.kind").alias("kind"), number.alias("name")).agg(F.sum("r.n").alias("n"))
    whole = kept.agg(F.sum("n_words"), F.sum("n_chars")).first()
    every = {(r["kind"], r["name"]): r["n"] for r in pooled.collect()}  # one row a class and rank
    all_words, all_chars = whole[0] or 0, whole[1] or 0
    class_prior = [PRIOR * every.get(("class", name), 0) / max(all_chars, 1) for name in CLASS_NAMES]
    rank_prior = [PRIOR * every.get(("word", str(i + 1)), 0) / max(all_words, 1) for i in range(COMMON_WORDS)]

    words = F.filter("rows", lambda r: r["kind"] == "word")
    own = F.map_from_entries(F.transform(F.filter("rows", lambda r: r["kind"] == "class"), lambda r: F.struct(r["key"].cast("string").alias("k"), r["n"].alias("v"))))
    classes = F.array(*[F.coalesce(F.try_element_at(own, F.lit(name)), F.lit(0)) + F.lit(prior) for name, prior in zip(CLASS_NAMES, class_prior)])
    ranks = F.array(*[F.lit(p) for p in rank_prior])
    found = kept.select("lang", classes.alias("classes"), F.transform(words, lambda r: r["key"]).alias("words"), F.transform(words, lambda r: r["n"]).alias("n"), "n_words")
    drawn = F.transform("n", lambda n, i: n.cast("double") + F.element_at(ranks, i + 1))
    used = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, b: a + b)
    spent = F.aggregate(F.slice(ranks, F.lit(1), F.size("n")), F.lit(0.0), lambda a, b: a + b)
    rest = (F.coalesce("n_words", F.lit(0)) - used).cast("double") + F.lit(float(PRIOR)) - spent
    return stored(found.where(F.size("n") > 0).select("lang", "classes", "words", F.concat(drawn, F.array(rest)).alias("word_counts")), "references")


def rule_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Base counts, distances and verdicts of every document.

    Without a hint on the join, Spark broadcasts the references while they are small.
    """
    found = reference_rows(docs, text_col, lang_col)
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))

    @pandas_udf(RESULT)
    def judge(texts: pd.Series, lang: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        rows, known = [], {}
        for text, own, some in zip(texts, lang, candidates):
            words = text.split()
            best = None, None, None
            if words and some is not None and len(some):
                counted, classes = Counter(folded_words(text)), class_counts(text)
                judged = []
                for row in some:
                    if row not in known:
                        if len(known) > 4 * NEAREST_GROUP:
                            known.clear()
                        known[row] = Reference(row)
                    judged.append((*known[row].distances(classes, counted, len(words)), known[row].lang))
                best = min(judged, key=lambda x: (x[0] + x[1], x[2]))
            rows.append((*base_counts(text, words), *best))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")]).astype({"class_distance": float, "word_distance": float, "reference": object})

    one = F.to_json(F.struct("lang", "classes", "words", "word_counts"))
    own = texts.where("lang IS NOT NULL").join(found.select("lang", F.array(one).alias("some")), "lang", "left").select("doc_id", judge("text", "lang", "some").alias("j"))
    # a document of no language meets all references, a group at a time, and keeps its nearest
    groups = max(1, -(-found.count() // NEAREST_GROUP))
    grouped = found.groupBy(F.pmod(F.xxhash64("lang"), F.lit(groups)).alias("g")).agg(F.collect_list(one).alias("some"))
    none = texts.where("lang IS NULL").withColumn("row", F.monotonically_increasing_id()).withColumn("g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    met = none.join(grouped, "g", "left").select("row", "doc_id", judge("text", "lang", "some").alias("j"))
    nearest = met.groupBy("row").agg(F.min_by(F.struct("doc_id", "j"), F.struct(F.coalesce(F.col("j.class_distance") + F.col("j.word_distance"), F.lit(9.0)), "j.reference")).alias("m"))
    flat = own.union(nearest.select("m.doc_id", "m.j")).select("doc_id", "j.*")
    flat = flat.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("class_distance", "word_distance")})
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd_classes = (F.col("word_chars") >= CLASS_LEAST_CHARS) & (F.col("class_distance") > CLASS_LIMIT)
    odd_words = (F.col("n_words") >= WORD_LEAST_WORDS) & (F.col("word_distance") > WORD_LIMIT)
    failed = F.coalesce(odd_classes, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
    return flat.withColumn("base_failed", base_failed).withColumn("kept", ~(F.col("base_failed") | failed))
