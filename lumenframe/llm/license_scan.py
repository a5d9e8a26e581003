"""License scans: a trained paragraph classifier over word n-grams, confirmed by templates.

Training (on the driver, from the fixed names and notices in license_texts): multinomial
logistic regression over the presence of n-grams of one to three words, with two more
classes: `unknown` for licences of no known family, and `none` for text that only sounds
like a licence, or is about something else.  Notices are learnt whole and in parts, with
ends, passages and single words left out.  Small weights are set to zero, and a
temperature for all classes is chosen on examples that the weights weren't fitted on.
Weights are whole thousandths.

Scanning uses Spark's own functions only.  A line that doesn't end a sentence is wrapped,
however short: the next one, if there is a letter or figure in it, goes on with its paragraph
(so lines of comment marks alone part paragraphs, and marks before words don't count).  A paragraph is cut into words and n-grams, these meet the vocabulary by a
broadcast join (the vocabulary is fixed, some thousand rows, whatever the table), and the
sums give the probability of each family.  Paragraphs that belong to some licence, known or not, with a
probability of REPORT or more are reported with their likeliest class but `none`; a family is confirmed if at least CONFIRM of the longest n-grams of one of its
names or notices are there.

Which texts are cut at all follows from the weights: evidence() holds one word of every
n-gram that speaks for some family, and without such an n-gram a paragraph stays below
REPORT (train() makes sure).  So nothing is lost by it, and the SQL does without.

A null or empty text has no paragraphs, and an empty table gives no rows.  Rows with null
or repeated ids are scanned each by itself.  Columns other than doc_id and text, of any
name, aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.license_texts import CARRIERS, NAMES, NO_LICENSE, NOTICES, OTHER_NAMES, OTHER_NOTICES, UNKNOWN

CONFIRM, REPORT = 0.6, 0.1
#: Thousandths.
LEAST_WEIGHT = 50
FAMILIES = (*sorted(NOTICES), "unknown", "none")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that ends a sentence, and one with words in it; for Java and RE2.
ENDS, FILLED = r"[.!?:][\"')\]>]*[ \t\r]*\z", r"[A-Za-z0-9]"
#: Words too common (in English and its neighbours) to say anything alone; no n-gram is made of these only.
COMMON = frozenset("a an and any are as at be been but by can for from had has have he her his if in into is it its la le los may me more mit no nor not of on one or our out s see shall she so that the their them there these they this to under up use used using was we were which who will with without you your".split())


def ngrams(text: str) -> list[str]:
    words = [w for w in re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans(UPPER, LOWER))).split(" ") if w]
    return list(dict.fromkeys(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)))


def _telling(gram: str) -> list[str]:
    """Its words that aren't common, nor numbers."""
    return [w for w in gram.split(" ") if w not in COMMON and not w.isdigit()]


@dataclass(frozen=True)
class Scanner:
    weights: dict[str, tuple[int, ...]]  # thousandths, by family
    bias: tuple[int, ...]
    temperature: float
    templates: tuple[tuple[str, frozenset[str]], ...]  # family, longest n-grams

    def vocabulary(self) -> dict[str, tuple[tuple[int, ...], list[int]]]:
        """n-gram -> weights, and the numbers of the templates that hold it."""
        zero = (0,) * len(FAMILIES)
        held = {g for _, grams in self.templates for g in grams}
        return {g: (self.weights.get(g, zero), [k for k, (_, grams) in enumerate(self.templates) if g in grams]) for g in sorted(held | self.weights.keys())}

    def evidence(self) -> list[str]:
        """A word of each n-gram that makes some class likelier against `none`."""
        return sorted({max(_telling(g), key=lambda w: (len(w), w)) for g, w in self.weights.items() if max(w[:-1]) > w[-1]})

    def probabilities(self, text: str) -> np.ndarray:
        """Of the families, for one paragraph."""
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in ngrams(text) if g in self.weights), np.zeros(len(FAMILIES)))
        return _softmax(z[None, :] / 1000 / self.temperature)[0]


def _examples(rng: np.random.Generator, times: int) -> tuple[list[str], np.ndarray]:
    """Names in sentences, notices and parts of them, alone and amid other words; what is no licence likewise."""
    loose = sorted({w for s in UNKNOWN for w in s.split()} | COMMON)
    noise = lambda most: [loose[int(j)] for j in rng.integers(0, len(loose), int(rng.integers(0, most)))]
    names = NAMES | {"unknown": OTHER_NAMES, "none": NO_LICENSE}
    notices = NOTICES | {"unknown": OTHER_NOTICES, "none": UNKNOWN}

    def parted(words: list[str]) -> list[str]:
        """A part of a notice: its ends cut, a passage or single words left out; a third of it stays at least."""
        cut = lambda: int(rng.integers(0, len(words) // 4 + 1))
        part = words[cut() : len(words) - cut()]
        how = int(rng.integers(0, 3))
        if how == 1:
            at, n = int(rng.integers(0, len(part))), int(rng.integers(1, len(part) // 3 + 2))
            part = part[:at] + part[at + n :]
        elif how == 2:
            part = [w for w, u in zip(part, rng.random(len(part))) if u >= 0.2]
        return part

    texts, classes = [], []
    for k, family in enumerate(FAMILIES):
        named = [c.format(n) for n in names[family] for c in CARRIERS]
        whole = list(notices[family])
        for i, source in enumerate([*named, *whole * times]):
            part = source.split()
            if i >= len(named) + len(whole) and len(part) > 6 and family != "none":
                part = parted(part)
            texts.append(" ".join((noise(30) if i % 3 == 2 else []) + part + (noise(30) if i % 3 else [])))
            classes.append(k)
    plain = [" ".join(noise(60)) for _ in range(480)] + [""] * 960  # most texts hold none of the n-grams at all
    return texts + plain, np.array(classes + [len(FAMILIES) - 1] * len(plain))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def train(seed: int = 5, steps: int = 250, l1: float = 1e-4, rate: float = 3.0) -> Scanner:
    rng = np.random.default_rng(seed)
    texts, y = _examples(rng, 30)
    known = [(f, s) for f in sorted(NOTICES) for s in (*NAMES[f], *NOTICES[f])]
    grams = sorted({g for s in [*(s for _, s in known), *OTHER_NAMES, *OTHER_NOTICES, *UNKNOWN, *NO_LICENSE, *(c.format("") for c in CARRIERS)] for g in ngrams(s) if _telling(g)})
    number = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(texts), len(grams)), np.float32)
    for r, t in enumerate(texts):
        x[r, [number[g] for g in ngrams(t) if g in number]] = 1
    fitted = rng.random(len(texts)) < 0.8
    xf, target = x[fitted], np.eye(len(FAMILIES), dtype=np.float32)[y[fitted]]
    w, b = np.zeros((len(grams), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES))
    m = np.zeros_like(w)
    for _ in range(steps):
        d = ((_softmax(xf @ w + b) - target) / len(xf)).astype(np.float32)
        m = 0.9 * m + xf.T @ d
        w -= rate * m
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
        b -= rate * d.sum(axis=0)
    whole, bias = np.round(w * 1000).astype(int), np.round(b * 1000).astype(int)
    spoken = {g for s in [*(s for _, s in known), *OTHER_NAMES, *OTHER_NOTICES, *(c.format("") for c in CARRIERS)] for g in ngrams(s)}
    for g, i in number.items():  # next to nothing, or by chance: no n-gram speaks for a family that its texts don't hold
        if g not in spoken or whole[i, :-1].max() - whole[i, -1] < LEAST_WEIGHT:
            whole[i, :-1] = np.minimum(whole[i, :-1], whole[i, -1])
    z = (x[~fitted] @ whole + bias) / 1000
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), y[~fitted]], 1e-12)).mean()
    temperature = float(min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss))
    weights = {g: tuple(int(v) for v in whole[i]) for g, i in number.items() if whole[i].any()}
    templates = []
    for family, text in known:
        own = ngrams(text)
        longest = max(g.count(" ") for g in own)
        templates.append((family, frozenset(g for g in own if g.count(" ") == longest)))
    scanner = Scanner(weights, tuple(int(v) for v in bias), temperature, tuple(templates))
    if 1 - scanner.probabilities("")[-1] >= REPORT:
        raise ValueError("a paragraph without evidence must stay below REPORT")
    return scanner


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _ngram_columns(words: Column) -> Column:
    """Its lambdas read nothing but their own arguments; a column read in one is made anew for each element."""
    after = lambda n: F.slice(words, F.lit(1 + n), F.greatest(F.size(words) - n, F.lit(0)))
    pairs = F.zip_with(words, after(1), lambda a, b: F.concat(a, F.lit(" "), b))
    threes = F.zip_with(pairs, after(2), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(F.concat(words, pairs, threes), lambda g: g.isNotNull()))  # beyond the last word there is null


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), text of all paragraphs, without a shuffle: wrapped lines are joined in their array."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n", -1).alias("lines"))
    prior = F.concat(F.array(F.lit(None).cast("string")), F.slice("lines", F.lit(1), F.size("lines") - 1))
    wrapped = lambda line, before: line.rlike(FILLED) & before.rlike(FILLED) & ~before.rlike(ENDS)
    lines = lines.withColumn("goes_on", F.zip_with("lines", prior, lambda line, before: F.coalesce(wrapped(line, before), F.lit(False))))
    joined = F.array_join(F.zip_with("lines", "goes_on", lambda line, g: F.concat(F.when(g, " ").otherwise("\n"), line)), "")
    starts = F.filter(F.transform("goes_on", lambda g, i: F.when(~g, i)), lambda i: i.isNotNull())
    both = lines.select("doc_id", F.arrays_zip(starts.alias("paragraph"), F.split(F.substr(joined, F.lit(2)), "\n", -1).alias("text")).alias("both"))
    # no text is without a paragraph; the plain explode would have Spark filter by the size of this array, and make it twice
    return both.select("doc_id", F.explode_outer("both").alias("b")).select("doc_id", "b.paragraph", "b.text")


def vocabulary_table(spark: SparkSession, scanner: Scanner) -> DataFrame:
    return spark.createDataFrame([(g, list(w), t) for g, (w, t) in scanner.vocabulary().items()], "ngram string, weights array<int>, held array<int>")


def scan(spark: SparkSession, docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, paragraph (its first line, from 0), family, probability, overlap, confirmed of every paragraph that may be a licence's."""
    scanner = scanner or train()
    n_f = len(FAMILIES)
    evidence = F.array(*map(F.lit, scanner.evidence()))
    some = docs.select("doc_id", "text").where(F.arrays_overlap(_words(F.col("text")), evidence))
    parts = paragraphs(some).select("doc_id", "paragraph", _words(F.col("text")).alias("words")).where(F.arrays_overlap("words", evidence))
    parts = parts.select("doc_id", "paragraph", F.monotonically_increasing_id().alias("row"), _ngram_columns(F.col("words")).alias("ngrams"))
    grams = parts.select("doc_id", "paragraph", "row", F.explode("ngrams").alias("ngram")).join(F.broadcast(vocabulary_table(spark, scanner)), "ngram")
    sums = grams.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("paragraph").alias("paragraph"), *(F.sum(F.get("weights", F.lit(i))).alias(f"w{i}") for i in range(n_f)), F.flatten(F.collect_list("held")).alias("held"))
    z = [(F.col(f"w{i}") + scanner.bias[i]).cast("double") / 1000 / scanner.temperature for i in range(n_f)]
    top, likeliest = F.greatest(*z), F.greatest(*z[:-1])
    best = F.lit(FAMILIES[-2])
    for i in reversed(range(n_f - 1)):
        best = F.when(z[i] == likeliest, F.lit(FAMILIES[i])).otherwise(best)
    whole = sum((F.exp(v - top) for v in z[1:]), F.exp(z[0] - top))
    found = sums.select("doc_id", "paragraph", "held", best.alias("family"), (F.exp(likeliest - top) / whole).alias("probability"), (F.exp(z[-1] - top) / whole).alias("other")).where(1 - F.col("other") >= REPORT)
    templates = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(f).alias("of"), F.lit(float(len(grams))).alias("size")) for k, (f, grams) in enumerate(scanner.templates)))
    shares = F.transform(F.filter(templates, lambda t: t["of"] == F.col("family")), lambda t: F.size(F.filter("held", lambda h: h == t["k"])) / t["size"])
    out = found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round(F.coalesce(F.array_max(shares), F.lit(0.0)), 6).alias("overlap"))
    return out.withColumn("confirmed", F.col("overlap") >= CONFIRM)


def sql(scanner: Scanner | None = None) -> str:
    """The same for DuckDB, from the same weights and templates, over all paragraphs."""
    scanner = scanner or train()
    n_f = len(FAMILIES)
    rows = ", ".join(f"('{g}', {list(w)}, {t}::INTEGER[])" for g, (w, t) in scanner.vocabulary().items())
    templates = ", ".join(f"({k}, '{f}', {len(g)})" for k, (f, g) in enumerate(scanner.templates))
    z = ", ".join(f"(w{i} + ({scanner.bias[i]}))::DOUBLE / 1000 / {scanner.temperature}::DOUBLE AS z{i}" for i in range(n_f))
    best = "CASE " + " ".join(f"WHEN z{i} = likeliest THEN '{FAMILIES[i]}'" for i in range(n_f - 1)) + " END"
    whole = " + ".join(f"exp(z{i} - top)" for i in range(n_f))
    ends, filled = ENDS.replace("'", "''"), FILLED
    return f"""
WITH vocabulary(ngram, weights, held) AS (VALUES {rows}),
templates(k, family, size) AS (VALUES {templates}),
lines AS (
  SELECT rid, doc_id, line, pos, lag(line) OVER (PARTITION BY rid ORDER BY pos) AS prior
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), numbered AS (
  SELECT *, sum(CASE WHEN prior IS NOT NULL AND regexp_matches(line, '{filled}') AND regexp_matches(prior, '{filled}') AND NOT regexp_matches(prior, '{ends}') THEN 0 ELSE 1 END)
    OVER (PARTITION BY rid ORDER BY pos) AS part FROM lines
), parts AS (
  SELECT row_number() OVER () AS row, any_value(doc_id) AS doc_id, min(pos) AS paragraph, string_agg(line, ' ' ORDER BY pos) AS text FROM numbered GROUP BY rid, part
), cut AS (
  SELECT row, list_filter(string_split(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM parts
), grams AS (
  SELECT DISTINCT row, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i+1], ' ')), list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')))) AS ngram FROM cut
), met AS (SELECT * FROM grams JOIN vocabulary USING (ngram)),
sums AS (SELECT row, {", ".join(f"sum(weights[{i + 1}]) AS w{i}" for i in range(n_f))} FROM met GROUP BY row),
scored AS (SELECT row, {z} FROM sums), topped AS (SELECT *, greatest({", ".join(f"z{i}" for i in range(n_f))}) AS top, greatest({", ".join(f"z{i}" for i in range(n_f - 1))}) AS likeliest FROM scored),
named AS (SELECT row, {best} AS family, exp(likeliest - top) / ({whole}) AS probability, exp(z{n_f - 1} - top) / ({whole}) AS other FROM topped),
shares AS (
  SELECT row, family, max(n / size) AS overlap FROM (SELECT row, k, count(*)::DOUBLE AS n FROM (SELECT row, unnest(held) AS k FROM met) GROUP BY row, k) JOIN templates USING (k) GROUP BY row, family
)
SELECT doc_id, CAST(paragraph AS INTEGER) AS paragraph, family, round(probability, 6) AS probability, round(coalesce(overlap, 0), 6) AS overlap, round(coalesce(overlap, 0), 6) >= {CONFIRM} AS confirmed
FROM named JOIN parts USING (row) LEFT JOIN shares USING (row, family) WHERE 1 - other >= {REPORT}
"""
