"""Quality rules: how far a document's histograms are from those of its language.

Two histograms are taken of each text: characters by class, and words by a list of common words of
four languages (all other words are one bin). A language's reference is the mean histogram of its
documents that pass the base rules and are long enough. A document is kept if it passes the base
rules and each of its histograms is within a limit of Jensen-Shannon distance (base 2, so from 0 to 1) of the
reference of its language; where the language isn't one of the four, or has no reference, of the nearest one.
Short texts have ragged histograms, so each rule looks only at documents of a minimum length.

Everything is built-in expressions: the texts are read once, and what is written of them is counts.
References are one row for each of the four languages.

A null text is taken as empty; a text below 20 words fails the base rules; without any reference no
distance is known (null) and the base rules decide. Repeated rows count each. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymap.llm.tables import GAP, WORD, whole_text
from tallymap.session import write_stage

#: Common words by language. Fixed values.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on with as be at by this are or from".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine".split(),
    "fr": "de la le et les en un du une que est pour qui dans par sur pas au avec il".split(),
    "es": "el y los se del las por con no una su para es lo como más pero sus le al".split(),
}
WORDS = tuple(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))
#: One character for each common word.
_SIGNS = "".join(map(chr, range(33, 33 + len(WORDS))))

#: Character classes as expressions for runs of them; blanks and all else come besides.
CLASSES = {
    "lower": "[a-z]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "stop": "[.,;:!?'\"()-]+",
    "symbol": r"[#*$%&|<>@^_=+~/\\{}\[\]`]+",
}

LEAST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
#: Minimum length for a rule, and the largest distance it allows. A sample of n words from the reference itself is
#: about 2 / sqrt(n) away from it, so the limit for words falls with n.
LEAST_CHARS, CHAR_LIMIT = 200, 0.22
LEAST_COMMON, WORD_LIMIT, WORD_NOISE = 100, 0.12, 2.4


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the plan does with its column."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, runs: str) -> Column:
    return F.length(F.regexp_replace(text, runs, ""))


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more in the text."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(WINDOW)))
    )

    def covered(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1

        def own(x: Column, i: Column) -> Column:
            same_before = (i > 0) & (sorted_windows[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])
            same_after = (i < last) & (sorted_windows[F.least(i + 1, last)]["h"] == x["h"])
            return F.when(same_before | same_after, x["at"]).otherwise(-1)

        places = F.array_sort(F.filter(F.transform(sorted_windows, own), lambda at: at >= 0))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda acc, at: F.struct((acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n"), at.alias("last")),
            lambda acc: acc["n"],
        )

    def count(found: Column) -> Column:
        marked = F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), _bind(F.array_sort(marked), covered)).otherwise(0)

    return F.when(F.size(words) > WINDOW, _bind(windows, count)).otherwise(0)


def _common(words: Column) -> Column:
    """The common words among the words, in lower case, as one sign each."""
    listed = F.array(*map(F.lit, WORDS))
    known = F.filter(F.transform(words, F.lower), lambda w: w.isin(*WORDS))
    signs = F.transform(known, lambda w: F.substr(F.lit(_SIGNS), F.array_position(listed, w).cast("int"), F.lit(1)))
    return F.array_join(signs, "")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms (as counts) of every whole text."""
    text = F.col("text")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    words = F.filter(F.split(text, GAP, -1), lambda w: w != "")
    of_words = _bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"), _common(w).alias("common")
        ),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    dup_lines = _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    counted = given.select(
        "doc_id", "lang", of_words.alias("w"), dup_lines.alias("n_dup_lines"), F.length(text).alias("chars"),
        (F.length(text) - _without(text, "[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        _without(text, GAP).cast("long").alias("word_chars"),
        *((F.length(text) - _without(text, runs)).alias(f"c_{name}") for name, runs in CLASSES.items()),
    )
    classes = [F.col(f"c_{name}") for name in CLASSES]
    blank = F.col("chars") - F.col("word_chars").cast("int")
    rest = F.col("chars") - blank - sum(classes[1:], classes[0])
    common = F.transform(
        F.sequence(F.lit(1), F.lit(len(WORDS))),
        lambda k: F.length("w.common") - F.length(F.replace(F.col("w.common"), F.substr(F.lit(_SIGNS), k, F.lit(1)), F.lit(""))),
    )
    others = F.col("w.n_words").cast("int") - F.length("w.common")
    return counted.select(
        "doc_id", "lang", "chars", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words",
        F.array(*classes, blank, rest).alias("char_counts"), F.concat(common, F.array(others)).alias("word_counts"),
    )


def _shares(counts: str, total: Column) -> Column:
    return F.transform(counts, lambda n: n / F.greatest(total, F.lit(1)).cast("double"))


def references(counts: DataFrame) -> DataFrame:
    """lang, char_reference, word_reference: the mean shares over a language's passing documents."""

    def mean(column: str, size: int, least: Column) -> Column:
        return F.array(*(F.avg(F.when(least, F.col(column)[k])) for k in range(size)))

    rows = counts.where(~F.col("base_failed") & F.col("lang").isin(*COMMON_WORDS)).select(
        "lang", "chars", "n_words", _shares("char_counts", F.col("chars")).alias("c"), _shares("word_counts", F.col("n_words")).alias("w")
    )
    return rows.groupBy("lang").agg(
        mean("c", len(CLASSES) + 2, F.col("chars") >= LEAST_CHARS).alias("char_reference"),
        mean("w", len(WORDS) + 1, F.col("n_words") >= LEAST_COMMON).alias("word_reference"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null where q isn't known."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts, base_failed, kept and the two distances."""
    counts = text_counts(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    counts = write_stage(counts.withColumn("base_failed", failed), "text-counts")
    known = write_stage(references(counts), "references")
    # at most one row for each of the four languages, as one list
    listed = known.agg(F.array_sort(F.collect_list(F.struct("lang", "char_reference", "word_reference"))).alias("refs"))
    refs = listed.first()["refs"]
    given = counts.withColumns({"c": _shares("char_counts", F.col("chars")), "w": _shares("word_counts", F.col("n_words"))})

    def nearest(shares: str, reference: str) -> Column:
        by_lang = {r["lang"]: F.array(*map(F.lit, r[reference])) for r in refs if r[reference][0] is not None}
        if not by_lang:
            return F.lit(None).cast("double")
        distances = {lang: jensen_shannon(F.col(shares), q) for lang, q in by_lang.items()}
        least = F.least(*distances.values(), F.lit(2.0)) if len(distances) > 1 else next(iter(distances.values()))
        found = F.when(F.lit(False), F.lit(0.0))
        for lang, d in distances.items():
            found = found.when(F.col("lang") == lang, d)
        return found.otherwise(least)

    given = given.withColumns({"char_distance": nearest("c", "char_reference"), "word_distance": nearest("w", "word_reference")})
    far = ((F.col("chars") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_LIMIT)) | (
        (F.col("n_words") >= LEAST_COMMON) & (F.col("word_distance") > WORD_LIMIT + WORD_NOISE / F.sqrt("n_words"))
    )
    return given.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance",
    )
