"""Quality rules: length and repetition rules, and Jensen-Shannon distance from language references. JVM-side only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import body, columns_named, words



@dataclass(frozen=True)
class Reference:
    """A language's histograms: occurrences per 1,000 words of its common words, and shares of letters, separators, digits, punctuation and other characters."""

    words: dict[str, float]
    classes: tuple[float, ...]


#: What ``fit_references`` gives for the labelled documents of sf0.1, 500 a language at most (321 of Spanish), rounded.
#: Of all its documents of good quality none of 100 words or more lies further than 0.24 by words, 0.24 by classes, or, from
#: 200 words on, 0.42 by common words; texts without a common word lie at 0.33, most of poor quality at 0.28 and more.
REFERENCES = {
    "en": Reference({"the": 50.1, "of": 26.9, "and": 21.3, "to": 15.4, "a": 12.5, "in": 10.9, "is": 9.6, "that": 8.3, "it": 7.1, "for": 6.9, "was": 6.2, "on": 6.1, "with": 5.5, "be": 4.5, "as": 4.5, "are": 4.2}, (0.8093, 0.1664, 0.0006, 0.0236, 0.0001)),
    "de": Reference({"der": 50.0, "die": 26.1, "und": 21.1, "in": 15.4, "den": 13.4, "von": 10.7, "zu": 9.1, "das": 8.8, "mit": 7.4, "sich": 7.1, "des": 5.9, "auf": 5.9, "für": 5.5, "ist": 4.8, "im": 4.5, "dem": 4.3}, (0.8232, 0.1546, 0.0004, 0.0218, 0.0)),
    "fr": Reference({"de": 50.9, "la": 27.3, "le": 20.0, "et": 15.6, "les": 12.9, "des": 11.1, "en": 9.8, "un": 8.7, "du": 7.1, "une": 6.6, "que": 6.0, "pour": 5.9, "est": 5.8, "dans": 4.7, "qui": 4.6, "par": 4.0}, (0.8087, 0.1667, 0.0008, 0.0238, 0.0)),
    "es": Reference({"de": 50.8, "la": 26.4, "que": 20.2, "el": 15.1, "en": 13.2, "y": 10.5, "los": 9.8, "se": 8.4, "las": 7.3, "del": 7.0, "por": 6.3, "un": 6.2, "con": 5.2, "no": 5.1, "una": 4.6, "para": 4.4}, (0.8145, 0.1616, 0.0008, 0.023, 0.0001)),
}
#: Classes of a text whose language is unknown: the mean over the languages.
ANY_CLASSES = tuple(round(sum(r.classes[i] for r in REFERENCES.values()) / len(REFERENCES), 4) for i in range(5))
#: Characters of punctuation; the other classes are letters, what separates words, digits, and the rest.
POINTS = r""".,;:!?'"()\-"""
#: Bits of a packed key that hold a position; a string has fewer words than this can count.
POSITION_BITS = 30


def js_distance(counts: Column, reference: Column, n: Column | None = None, m: Column | None = None) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of non-negative numbers; null when either sums to 0. ``n`` and ``m`` are the sums, where known."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m) / 2).otherwise(0.0)

    n, m = (F.nullif(total(a) if known is None else known, F.lit(0.0)) for a, known in ((counts, n), (reference, m)))
    terms = F.zip_with(counts, reference, lambda a, b: half(a / n, (a / n + b / m) / 2) + half(b / m, (a / n + b / m) / 2))
    return F.sqrt(F.greatest(total(terms), F.lit(0.0)))


def _left(text: Column, drop: str) -> Column:
    """How many characters stay when the pattern's are dropped."""
    return F.char_length(F.regexp_replace(text, drop, ""))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from the array ``_w``: words in 3-word windows found twice or more in the text.

    Per row and without a shuffle: window hashes packed with positions are sorted, neighbours with
    equal hashes become candidates, and only those are compared as text. So a hash collision costs
    a comparison and never changes a count; n log n for any length.
    """
    at = F.lit((1 << POSITION_BITS) - 1).cast("long")
    key = lambda v: F.shiftright(v, POSITION_BITS)
    twins = lambda a, f: F.flatten(F.filter(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), lambda x, y: F.when(f(x) == f(y), F.array(x, y))), lambda v: v.isNotNull()))
    w = F.col("_w")
    packed = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.shiftleft(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")))
    df = df.withColumn("_keys", F.sort_array(packed))
    df = df.withColumn("_maybe", F.array_distinct(twins(F.col("_keys"), key)))
    at_of = lambda v: v.bitwiseAND(at).cast("int")
    text = lambda v: F.concat_ws(" ", F.get(w, at_of(v)), F.get(w, at_of(v) + 1), F.get(w, at_of(v) + 2))
    df = df.withColumn("_same", F.sort_array(F.transform("_maybe", lambda v: F.struct(text(v).alias("t"), at_of(v).alias("i")))))
    sure = twins(F.col("_same"), lambda x: x["t"])
    covered = F.array_distinct(F.flatten(F.transform(sure, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("_keys", "_maybe", "_same")


def fit_references(docs: DataFrame, labels: DataFrame, per_language: int = 500, n_words: int = 16) -> dict[str, Reference]:
    """Histograms of each language from its documents of good quality.

    ``labels`` has doc_id and quality. The sample is bounded: of a language the ``per_language``
    documents whose doc_ids have the least digests. Its common words are the ``n_words`` most frequent of one to five
    small letters. What reaches the driver are these words and five sums a language.
    """
    good = docs.select("doc_id", "lang", body().alias("t")).filter("lang IS NOT NULL").join(labels.filter("quality = 1").select("doc_id").distinct(), "doc_id")
    first = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "t")
    sample = good.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).select("lang", "t", words(F.col("t")).alias("w"))
    left = lambda drop: F.sum(F.char_length(F.regexp_replace("t", drop, "")))
    sums = sample.groupBy("lang").agg(F.sum(F.size("w")).alias("words"), F.sum(F.char_length("t")).alias("n"), left(r"\P{L}+").alias("l"), left(r"[^\x20\x09-\x0D]+").alias("s"), left("[^0-9]+").alias("d"), left(f"[^{POINTS}]+").alias("p"))
    counts = sample.select("lang", F.explode("w").alias("w")).filter(F.col("w").rlike(r"\A\p{Ll}{1,5}\z")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "w"))).filter(F.col("r") <= n_words)
    out = {}
    for r in sums.collect():
        listed = {b["w"]: round(1000 * b["n"] / r["words"], 1) for b in best.filter(F.col("lang") == r["lang"]).orderBy("r").collect()}
        classes = (r["l"], r["s"], r["d"], r["p"], r["n"] - r["l"] - r["s"] - r["d"] - r["p"])
        out[r["lang"]] = Reference(listed, tuple(round(c / max(1, r["n"]), 4) for c in classes))
    return out


def score_quality(docs: DataFrame, min_words: int = 50, max_class_distance: float = 0.25, max_word_distance: float = 0.28, min_class_chars: int = 100, min_histogram_words: int = 100, max_common_distance: float = 0.55, min_common_words: int = 200, references: dict[str, Reference] | None = None) -> DataFrame:
    """Adds the measures, ``base_failed`` and ``kept`` to every document; a projection without shuffle.

    The base rule fails texts under ``min_words`` words and texts more than half of whose words lie
    in repeated 3-word windows. Of the rest, a text is dropped when a histogram of it lies further
    from its language's reference than allowed: ``class_distance`` by character classes,
    ``word_distance`` by the common words and all others as one, ``common_distance`` by the common
    words among themselves, 1 where there is none. Small counts scatter, so a distance counts only
    from ``min_class_chars`` characters, ``min_histogram_words`` and ``min_common_words`` words on. A null or
    unknown language has the mean of all classes and no distance by words. Null text reads as empty and fails the base rule.

    Columns with the names of results are replaced; all others pass through, whatever their names.
    Repeated rows each give a row; a very long text is measured whole, in its own row; an empty table gives no rows.
    """
    references = references or REFERENCES
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "common_distance", "base_failed", "kept"]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    others = columns_named([c for c in docs.columns if c not in made])
    df = docs.select(F.struct(*others).alias("_row"), lang.alias("_lang"), body().alias("_t")).withColumn("_w", words(F.col("_t")))
    df = df.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long")).withColumn("_n", F.char_length("_t"))
    # what is neither letter nor separator: a small part of a text, in which all other classes are counted
    df = df.withColumn("_odd", F.regexp_replace("_t", r"[\p{L}\x20\x09-\x0D]+", "")).withColumn("n_symbols", (F.char_length("_odd") - _left(F.col("_odd"), r"[#*$%&|<>]+")).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = with_repeats(df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines"))
    df = df.withColumn("_letters", F.col("word_chars") - F.char_length("_odd")).withColumn("_digits", _left(F.col("_odd"), "[^0-9]+")).withColumn("_points", _left(F.col("_odd"), f"[^{POINTS}]+"))
    spaces = F.col("_n") - F.col("word_chars")
    classes = F.array(*(c.cast("double") for c in (F.col("_letters"), spaces, F.col("_digits"), F.col("_points"), F.col("word_chars") - F.col("_letters") - F.col("_digits") - F.col("_points"))))

    def by_language(value, none: Column | None = None) -> Column:
        first, *rest = references
        chosen = reduce(lambda c, k: c.when(F.col("_lang") == k, value(references[k])), rest, F.when(F.col("_lang") == first, value(references[first])))
        return chosen if none is None else chosen.otherwise(none)

    numbers = lambda values: F.array(*(F.lit(float(v)) for v in values))
    shares = by_language(lambda r: numbers(r.classes), numbers(ANY_CLASSES))
    df = df.withColumn("class_distance", F.when(F.col("_n") >= min_class_chars, F.round(js_distance(classes, shares), 9)))
    df = df.withColumn("_listed", by_language(lambda r: F.array(*map(F.lit, r.words)))).withColumn("_hits", by_language(lambda r: F.filter("_w", lambda x: x.isin(*r.words))))
    df = df.withColumn("_found", F.transform("_listed", lambda r: (F.size("_hits") - F.size(F.array_remove("_hits", r))).cast("double")))
    common = by_language(lambda r: numbers(r.words.values()))
    whole = by_language(lambda r: numbers([*r.words.values(), round(1000 - sum(r.words.values()), 1)]))
    histogram = F.concat("_found", F.array((F.col("n_words") - F.size("_hits")).cast("double")))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= min_histogram_words, F.round(js_distance(histogram, whole, F.col("n_words").cast("double"), F.lit(1000.0)), 9)))
    n_hits = F.size("_hits").cast("double")
    apart = F.when(n_hits == 0, 1.0).otherwise(F.round(js_distance(F.col("_found"), common, n_hits, by_language(lambda r: F.lit(float(sum(r.words.values()))))), 9))
    df = df.withColumn("common_distance", F.when(F.col("_listed").isNotNull() & (F.col("n_words") >= min_common_words), apart))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = lambda c, most: F.coalesce(F.col(c), F.lit(0.0)) <= most
    near = within("class_distance", max_class_distance) & within("word_distance", max_word_distance) & within("common_distance", max_common_distance)
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near)
    # one row in, one row out: filters on the results stay above this and don't copy the expressions below it
    return df.select("_row", F.explode(F.array(F.struct(*made))).alias("_made")).select("_row.*", "_made.*")


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, lang, CAST(len(w.w) AS BIGINT) AS n_words, length(t) AS n,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS digits, length(regexp_replace(t, '[^.,;:!?''"()\-]+', '', 'g')) AS points, w.w AS w
  FROM d JOIN w USING (r) LEFT JOIN lines USING (r) LEFT JOIN cov USING (r)),
ref(lang, word, share) AS (VALUES @WORDS@),
cls(lang, a) AS (VALUES @CLASSES@),
refs AS (SELECT lang, word, share FROM ref UNION ALL SELECT lang, NULL, 1000 - sum(share) FROM ref GROUP BY lang),
sums AS (SELECT lang, sum(share) AS s FROM ref GROUP BY lang),
hit AS (SELECT r, x AS word, count(*) AS c FROM (SELECT r, lang, unnest(w) AS x FROM m) h WHERE EXISTS (SELECT 1 FROM ref WHERE ref.lang = h.lang AND ref.word = h.x) GROUP BY r, x),
hits AS (SELECT r, sum(c) AS c FROM hit GROUP BY r),
p AS (SELECT m.r, 'word' AS what, (CASE WHEN refs.word IS NULL THEN m.n_words - coalesce(hits.c, 0) ELSE coalesce(hit.c, 0) END) / CAST(n_words AS DOUBLE) AS a, share / 1000.0::DOUBLE AS b
  FROM m JOIN refs ON refs.lang = m.lang LEFT JOIN hit ON hit.r = m.r AND hit.word = refs.word LEFT JOIN hits ON hits.r = m.r WHERE m.n_words >= 100
  UNION ALL SELECT m.r, 'common', coalesce(hit.c, 0) / CAST(hits.c AS DOUBLE), share / s::DOUBLE
  FROM m JOIN ref ON ref.lang = m.lang JOIN sums ON sums.lang = m.lang JOIN hits ON hits.r = m.r LEFT JOIN hit ON hit.r = m.r AND hit.word = ref.word WHERE m.n_words >= 200
  UNION ALL SELECT r, 'class', unnest([letters, n - word_chars, digits, points, word_chars - letters - digits - points]) / CAST(n AS DOUBLE), unnest(coalesce(a, @ANY@)) / list_sum(coalesce(a, @ANY@)) FROM m LEFT JOIN cls ON cls.lang = m.lang WHERE n >= 100),
js AS (SELECT r, what, round(sqrt(greatest(sum(CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) / 2 ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) / 2 ELSE 0 END), 0)), 9) AS dist FROM p GROUP BY r, what),
d3 AS (SELECT m.*, c.dist AS class_distance, x.dist AS word_distance, CASE WHEN n_words >= 200 AND sums.s IS NOT NULL THEN coalesce(k.dist, 1) END AS common_distance
  FROM m LEFT JOIN js c ON c.r = m.r AND c.what = 'class' LEFT JOIN js x ON x.r = m.r AND x.what = 'word' LEFT JOIN js k ON k.r = m.r AND k.what = 'common' LEFT JOIN sums ON sums.lang = m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, common_distance,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_distance, 0) <= 0.25 AND coalesce(word_distance, 0) <= 0.28 AND coalesce(common_distance, 0) <= 0.55 AS kept
FROM d3
"""
QUALITY_SQL = QUALITY_SQL.replace("@WORDS@", ", ".join(f"('{k}', '{w}', {n}::DOUBLE)" for k, r in REFERENCES.items() for w, n in r.words.items()))
QUALITY_SQL = QUALITY_SQL.replace("@CLASSES@", ", ".join(f"('{k}', {list(r.classes)}::DOUBLE[])" for k, r in REFERENCES.items())).replace("@ANY@", f"{list(ANY_CLASSES)}::DOUBLE[]")
